"""Byte-level BPE ids, encoded once per distinct word.

The pre-tokenizer never joins text across a space that has no white space on its left, so a
text without white space before a space is the concatenation of its space-led words. Words
are looked up by a 64-bit fingerprint; new ones are encoded together and all are then gathered
from the pool of known ids. The bytes of every word are compared with those of the word
found, and a text with a word that only shares a fingerprint is encoded whole, as are other texts.
"""

from __future__ import annotations

import base64
import json
import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np

#: Bytes of words, ids and tables a worker remembers; then it starts anew.
POOL_BYTES = 64 << 20
#: Bytes of text that are split into words at a time.
STEP_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tiktoken(ranks_path: str):
    """A tiktoken encoding without special tokens from a file of ``base64 rank`` lines."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returned first in this process: Python workers live on from task to task."""
    held = sys.modules.setdefault("_quaylog_per_process", types.ModuleType("_quaylog_per_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def word_encoder(json_path: str, ranks_path: str) -> "WordEncoder":
    return per_process(("words", json_path, ranks_path), lambda: WordEncoder(json_path, ranks_path))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _open_before_space(body: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """Which spaces have (or, beyond ASCII, may have) white space on their left."""
    a, b, c = (np.where(spaces >= k, body[spaces - k], 0) for k in (1, 2, 3))
    ascii_white = (a == 32) | ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    three = ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE3) & (b == 0x80))
    return ascii_white | two | three


class WordEncoder:
    """Ids of texts as unsigned 32-bit arrays.

    ``json_path`` is the tokenizers file whose ids are wanted, ``ranks_path`` the same
    vocabulary as ranks. A text that spells one of the file's special tokens goes to the
    tokenizers library itself, so that it is read as that library reads it.
    """

    def __init__(self, json_path: str, ranks_path: str):
        # the same object that the secret scan has in this process
        self.fast = per_process(("ranks", ranks_path), lambda: load_tiktoken(ranks_path))
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.exact = None
        self.bytes_of = np.zeros(self.fast.n_vocab, np.int64)
        for token in self.fast.token_byte_values():
            self.bytes_of[self.fast.encode_single_token(token)] = len(token)
        self.up = self.down = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.offset, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.spelled, self.word, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.offset, self.length, self.pool, self.spelled, self.word, self.size))

    def _pieces(self, text: str) -> list[str]:
        """A long text in parts that are encoded apart: cut before spaces without white space on their left."""
        most = STEP_BYTES // 4
        if len(text) <= most or any(s in text for s in self.specials):
            return [text]
        out, at = [], 0
        while len(text) - at > most:
            cut = text.rfind(" ", at + 1, at + most)
            while cut > at and text[cut - 1].isspace():
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:  # no such space there: the next one after it
                cut = at + most
                while (cut := text.find(" ", cut)) > 0 and text[cut - 1].isspace():
                    cut += 1
                if cut < 0:
                    break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def whole(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.json_path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self._pieces(t) for t in texts]
        if all(len(p) == 1 for p in pieces):
            return self._encode_pieces(texts)
        found = iter(self._encode_pieces([x for p in pieces for x in p]))
        return [np.concatenate([next(found) for _ in p]) for p in pieces]

    def _encode_pieces(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            step, size = [], 0
            while at < len(texts) and (not step or size + len(texts[at]) <= STEP_BYTES):
                step.append(texts[at])
                size += len(texts[at])
                at += 1
            out += self._step(step)
        return out

    def _step(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > STEP_BYTES:  # one word, or nearly so
            return [self.whole(texts[0])]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"".join(raw)
        body = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        begins = np.append(0, ends[:-1])
        if not len(body):
            return [np.zeros(0, np.uint32) for _ in texts]
        spaces = np.flatnonzero(body == 32)
        text_of = np.searchsorted(ends, spaces, side="right")
        led = spaces > begins[text_of]
        alone = {int(i) for i in np.unique(text_of[led][_open_before_space(body, spaces[led])])}
        alone |= {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}

        edge = body == 32
        edge[begins[ends > begins]] = True
        starts = np.flatnonzero(edge)
        stops = np.append(starts[1:], len(body))
        where = self._known(joined, body, starts, stops)
        alone |= {int(i) for i in np.unique(np.searchsorted(ends, starts[self._misread(body, starts, stops, where)], side="right"))}
        length = self.length[where]
        before = np.append(0, np.cumsum(length))
        ids = self.pool[np.arange(before[-1]) + np.repeat(self.offset[where] - before[:-1], length)]
        cut = before[np.searchsorted(starts, np.append(begins, len(body)))].tolist()
        return [self.whole(texts[i]) if i in alone else ids[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def _known(self, joined: bytes, body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Places of words in the pool's tables; words that are new are encoded first."""
        sums = np.zeros(len(body) + 1, np.uint64)
        if len(self.up) < len(body):
            self.up, self.down = _powers(BASE, len(body)), _powers(pow(BASE, -1, 1 << 64), len(body))
        np.cumsum((body + np.uint64(1)) * self.down[: len(body)], out=sums[1:])
        key = (sums[stops] - sums[starts]) * self.up[starts]
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (stops - starts).astype(np.uint64)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if self._held() > POOL_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            ids, offsets, lengths = self._encode([joined[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
            offsets += len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            sizes = stops[first[new]] - starts[first[new]]
            words = np.cumsum(sizes) - sizes
            spelled = body[np.arange(int(sizes.sum())) + np.repeat(starts[first[new]] - words, sizes)]
            words += len(self.spelled)
            self.spelled = np.concatenate([self.spelled, spelled])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.offset = np.concatenate([self.offset, offsets])[order]
            self.length = np.concatenate([self.length, lengths])[order]
            self.word = np.concatenate([self.word, words])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            at = np.searchsorted(self.keys, distinct)
        return at[inverse]

    def _misread(self, body: np.ndarray, starts: np.ndarray, stops: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Words whose bytes aren't those of the pool's word."""
        size = stops - starts
        wrong = self.size[where] != size
        word = np.where(wrong, 0, self.word[where])
        there = np.repeat((word - starts).astype(np.int32), size) + np.arange(len(body), dtype=np.int32)
        differ = np.flatnonzero(self.spelled[np.minimum(there, len(self.spelled) - 1)] != body)
        wrong[np.searchsorted(starts, differ, side="right") - 1] = True
        return np.flatnonzero(wrong)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each word's offset and length there; space-led words in one call."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace()]
        single = sorted(set(range(len(words))).difference(plain))
        ids = np.array(self.fast.encode_ordinary("".join([texts[i] for i in plain])), np.uint32)
        ends = np.cumsum(np.fromiter((len(words[i]) for i in plain), np.int64, len(plain)))
        lengths = np.zeros(len(words), np.int64)
        if plain:
            lengths[plain] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1, prepend=0)
        others = [self.fast.encode_ordinary(texts[i]) for i in single]
        lengths[single] = [len(x) for x in others]
        ids = np.concatenate([ids, np.array([t for x in others for t in x], np.uint32)])
        offsets = np.zeros(len(words), np.int64)
        order = np.array([*plain, *single], np.int64)
        offsets[order] = np.cumsum(lengths[order]) - lengths[order]
        return ids, offsets, lengths
