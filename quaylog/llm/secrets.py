"""Secret scan: fixed patterns, and runs of characters that a tokenizer can't compress.

A BPE vocabulary holds the frequent strings of natural text and code, so ordinary runs take
three or more characters to a token and random ones about two or less. Runs that are known
digests or identifiers by their form, or for the most part repeats, are left out before the test.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import load_tiktoken, per_process, tokenizer_file

#: Patterns that the contract fixes; group 2 of ``assign`` is the value.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A hex run long enough to count; runs are maximal, so shorter ones needn't be visited.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters per token below which a run counts as random, and below which one that has the form of words does:
#: random letters have 1.7, words of natural languages 2.2 or more.
RATIO, WORDS_RATIO = 2.1, 1.9
UUID = re.compile(r"(?ai:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
DIGEST = re.compile(r"(?ai:[0-9a-f]+)")
#: Lengths in hex digits of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512). Fixed values.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
LABELLED = re.compile(r"(?ai:(?:md5|sha-?\d{1,3}|sha\d-\d{3}|blake\w*|integrity|checksum|digest|etag|commit|fingerprint|uuid|guid))[\"'\s]*[:=-]\s*[\"']?$")
REPEATED = re.compile(r"(.{1,8}?)\1{2,}")
#: Words in one case or with a capital, alone or joined by hyphens or underscores.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_]+(?:[A-Z]?[a-z]+|[A-Z]+))*")


def _tokens_of(ranks_path: str | None):
    """The encoder of a worker; the default vocabulary is the worker's own file."""
    path = ranks_path or tokenizer_file("byte_bpe_50k.tiktoken")
    return per_process(("ranks", path), lambda: load_tiktoken(path)).encode_ordinary


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return out


def known_form(run: str, before: str) -> bool:
    """Whether a run is repeats for the most part, or an identifier or digest by its form or the label before it."""
    return bool(
        UUID.fullmatch(run)
        or run.isdigit()
        or (DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS)
        or LABELLED.search(before)
        or 2 * sum(m.end() - m.start() for m in REPEATED.finditer(run)) > len(run)
        or run.startswith(("http", "www"))
    )


def covered(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """The stretches that spans cover, in order and apart from each other."""
    out: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def random_spans(text: str, tokens_of, taken: list[tuple[str, int, int]], ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """Runs of few characters per token that no base span overlaps."""
    out, stretches, at = [], covered(taken), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        # runs come in order, so the stretches that end before this one are done with
        while at < len(stretches) and stretches[at][1] <= start:
            at += 1
        run = m[0].strip("=-/_+")
        if len(run) < 20 or (at < len(stretches) and stretches[at][0] < end):
            continue
        limit = min(ratio, WORDS_RATIO) if WORDS.fullmatch(run) else ratio
        if not known_form(run, text[max(0, start - 24) : start]) and len(run) < limit * len(tokens_of(run)):
            first = text.index(run, start)
            out.append(("random", first, first + len(run)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, ratio: float = RATIO, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Offsets are code points of the whole text, ends exclusive. Null texts count as empty; a text
    without spans has empty ``spans`` and the hash of the empty string. Repeated rows get a row
    each; no rows give no rows; further columns are ignored.
    """

    def find(batches: Iterator) -> Iterator:
        tokens_of = _tokens_of(ranks_path)
        for batch in batches:
            ids, texts = batch.columns
            counts: dict[str, list] = {k: [] for k in KINDS}
            shas, spans = [], []
            for value in texts:
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, tokens_of, base, ratio)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in (*base, *more)))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(shas), pa.array(spans), pa.array(counts["random"], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )


def redact(docs: DataFrame, mask: str = "[secret]", ratio: float = RATIO, ranks_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mask``; null texts stay null.

    Each row by its text alone; no rows give no rows; further columns stay as they are.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        tokens_of = _tokens_of(ranks_path)

        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            out, at = [], 0
            for _, s, e in sorted(base + random_spans(text, tokens_of, base, ratio), key=lambda x: x[1:]):
                if s >= at:
                    out += [text[at:s], mask]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return pa.array((one(t.as_py()) for t in texts), pa.string(), size=len(texts))

    return docs.withColumn(text_col, clean(F.col(text_col)))
