"""Benchmark decontamination by spaced seeds.

A seed is a window of words under a fixed mask that ignores some places, so a hit survives
substituted words there. Seeds of all test items are matched with those of all documents, and
around each hit the item is laid over the document and word by word compared: a document is
contaminated where an overlap of enough words agrees in a large enough share.

The table of test seeds is sent to all tasks while its counted size is below a bound; beyond
it the same seeds are joined by a shuffle.
"""

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks over windows of words: 1 compares, 0 ignores. Weight 5 each; any two substituted words
#: that are three or more apart leave one of them whole in a window of 14.
MASKS = ("11111", "1101011", "110010101", "10010011001")
#: Test seeds that may be sent to every task.
BROADCAST_SEEDS = 2_000_000
MIN_WORDS, MIN_SHARE = 12, 0.8
BASE = 0x9E3779B97F4A7C15


def word_hashes(text: str | None):
    """64-bit hashes of a text's words: lower case, letters and digits only.

    General and CJK punctuation and Latin signs part words like ASCII ones; in Chinese, Japanese,
    Thai and Lao each character is a word.
    """
    import numpy as np

    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    body = np.frombuffer(raw, np.uint8)
    inside, alone = np.zeros(len(body) + 2, bool), None
    inside[1:-1] = body != 32
    if not raw.isascii():
        for lead, low, high, length in _SIGNS:
            at = _led(body, lead, low, high)
            for k in range(length):
                inside[1 + at + k] = False
        alone = np.concatenate([_led(body, *x) for x in _ALONE])
    if alone is None or not len(alone):
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edge[::2], edge[1::2]
    else:
        begins = inside[1:] & ~inside[:-1]
        begins[alone] = begins[alone] | inside[1 + alone]
        begins[alone + 3] |= inside[alone + 4]
        starts = np.flatnonzero(begins)
        ends = np.union1d(starts, np.flatnonzero(~inside[1:]))
        stops = ends[np.searchsorted(ends, starts, "right")]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(body))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body + np.uint64(1)) * down[: len(body)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * up[starts] + (stops - starts).astype(np.uint64))


def _led(body, lead: int, low: int, high: int):
    """Places of a lead byte that a byte from low to high follows."""
    import numpy as np

    at = np.flatnonzero(body[:-1] == lead)
    return at[(body[at + 1] >= low) & (body[at + 1] <= high)]


_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
#: UTF-8 lead byte, range of the byte after it, and length: Latin-1 signs but the ordinals and the
#: micro sign, general punctuation, CJK punctuation. Fixed values.
_SIGNS = ((0xC2, 0x80, 0xA9, 2), (0xC2, 0xAB, 0xB1, 2), (0xC2, 0xB4, 0xB4, 2), (0xC2, 0xB6, 0xB8, 2), (0xC2, 0xBB, 0xBB, 2), (0xC2, 0xBF, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3))
#: The same of characters that are words: Thai and Lao, kana and CJK. Fixed values.
_ALONE = ((0xE0, 0xB8, 0xBB), (0xE3, 0x81, 0xBF), *((lead, 0x80, 0xBF) for lead in range(0xE4, 0xEA)))
_held: dict = {}


def _powers(n: int):
    import numpy as np

    if n > len(_held.get("up", ())):
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _held[name] = np.multiply.accumulate(p)
    return _held["up"], _held["down"]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(words, mask: str, number: int):
    """Seed hash of every window of the mask's length."""
    import numpy as np

    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = out * np.uint64(BASE) + words[i : i + n]
    return _mix(out)


def _best_overlap(doc, item, shift: int, min_share: float = MIN_SHARE) -> tuple[int, int, int]:
    """(equal words, length, document place) of the longest overlap at one alignment.

    Place p of the document lies under place p - shift of the item. The longest run of places with
    a share of ``min_share`` or more of equal words, changed words at its ends included; of several
    the one of most equal words, then the first.
    """
    import numpy as np

    a, b = max(0, shift), min(len(doc), len(item) + shift)
    if b <= a:
        return 0, 0, 0
    same = doc[a:b] == item[a - shift : b - shift]
    part, whole = _ratio(min_share)
    gain = np.append(0, np.cumsum(np.where(same, whole - part, -part)))
    # the first begin whose gain isn't above the end's: running minima fall, so it is found by bisection
    begin = np.searchsorted(-np.minimum.accumulate(gain), -gain)
    length = np.arange(len(gain)) - begin
    equal = np.append(0, np.cumsum(same))
    equal = np.where(length == length.max(), equal - equal[begin], -1)
    end = int(np.argmax(equal))
    return int(equal[end]), int(length[end]), a + int(begin[end])


def _ratio(share: float) -> tuple[int, int]:
    """A share as a fraction of whole numbers, so that sums of gains are exact."""
    return Fraction(share).limit_denominator(1_000_000).as_integer_ratio()


class Items:
    """Test items as word hashes, with their seeds sorted."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        self.ids = [r[0] for r in rows]
        self.words = [word_hashes(r[1]) for r in rows]
        keys, item, place = [], [], []
        for i, w in enumerate(self.words):
            for k, mask in enumerate(MASKS):
                s = seeds(w, mask, k)
                keys.append(s)
                item.append(np.full(len(s), i))
                place.append(np.arange(len(s)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys >> np.uint64(42)] = True

    def alignments(self, doc) -> set[tuple[int, int]]:
        """(item, shift) of all hits in a document."""
        import numpy as np

        out: set[tuple[int, int]] = set()
        for k, mask in enumerate(MASKS):
            s = seeds(doc, mask, k)
            maybe = np.flatnonzero(self.filter[s >> np.uint64(42)])
            lo = np.searchsorted(self.keys, s[maybe], "left")
            hi = np.searchsorted(self.keys, s[maybe], "right")
            for at, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                out.update(zip(self.item[a:b].tolist(), (at - self.place[a:b]).tolist(), strict=True))
        return out


def verified(doc, item, shifts: list[int], min_words: int, min_share: float) -> tuple[int, int, int] | None:
    """The best overlap over a pair's alignments, if it is contamination.

    Items under ``min_words`` words must be found whole, to the same share.
    """
    need = min(min_words, len(item))
    part, whole = _ratio(min_share)
    found = (_best_overlap(doc, item, s, min_share) for s in shifts)
    enough = [x for x in found if x[1] >= need > 0 and whole * x[0] >= part * x[1] and x[0] >= min(need, 5)]
    return max(enough, key=lambda x: (x[0], -x[1], -x[2]), default=None)


_RESULT = "doc_id {kind}, item_id {item}, matched_words long, overlap_words long, first_word long"


def overlaps(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per document and test item it holds: doc_id, item_id, matched_words, overlap_words, first_word.

    The best overlap of the pair; ``first_word`` is its first word in the document. Null and
    empty texts match nothing, nor do items of fewer words than the shortest mask. Repeated
    documents get rows each, repeated items too. No rows on either side give no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    t = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    result = _RESULT.format(kind=d.schema["doc_id"].dataType.simpleString(), item=t.schema["item_id"].dataType.simpleString())
    if _sendable(t, broadcast_seeds):
        return _by_broadcast(d, t, result, min_words, min_share)
    return _by_join(d, t, min_words, min_share)


def _sendable(t: DataFrame, broadcast_seeds: int) -> bool:
    """Whether the items have no more seeds than may be sent to every task.

    Counted above what there are: words, and characters that may be words of their own.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.split(text, "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")) + F.length(F.regexp_replace(text, "[\\x{0}-\\x{DFF}]", ""))
    return (t.agg(F.sum(words)).first()[0] or 0) * len(MASKS) <= broadcast_seeds


def _by_broadcast(d: DataFrame, t: DataFrame, result: str, min_words: int, min_share: float) -> DataFrame:
    rows = d.sparkSession.sparkContext.broadcast([tuple(r) for r in t.collect()])  # bounded by the caller

    def find(batches: Iterator) -> Iterator:
        items = Items(rows.value)
        for batch in batches:
            ids, texts = batch.columns
            out: list[tuple] = []
            for i, text in enumerate(texts):
                words = word_hashes(text.as_py())
                by_item: dict[int, list[int]] = {}
                for item, shift in items.alignments(words):
                    by_item.setdefault(item, []).append(shift)
                for item, shifts in sorted(by_item.items()):
                    if best := verified(words, items.words[item], sorted(shifts), min_words, min_share):
                        out.append((i, items.ids[item], *best))
            yield _rows(out, ids)

    def _rows(out: list[tuple], ids):
        at = pa.array([x[0] for x in out], pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(at), pa.array([x[1] for x in out], kind), *(pa.array([x[k] for x in out], pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "matched_words", "overlap_words", "first_word"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(t.schema["item_id"].dataType)
    return d.mapInArrow(find, result)


def _by_join(d: DataFrame, t: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """The same by joins on digests of texts: seeds to pairs of texts, those verified, then the rows that have them.

    A text that many rows have is searched once. Null ids are rows like others.
    """
    d, t = (x.withColumn("digest", _digest(F.col("text"))) for x in (d, t))
    pairs = _verified_pairs(d, t, min_words, min_share)
    found = pairs.join(d.select("doc_id", F.col("digest").alias("doc")), "doc").join(t.select("item_id", F.col("digest").alias("item")), "item")
    return found.select("doc_id", "item_id", "matched_words", "overlap_words", "first_word")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _verified_pairs(d: DataFrame, t: DataFrame, min_words: int, min_share: float) -> DataFrame:
    """(doc, item, matched_words, overlap_words, first_word) of digests of texts with a hit.

    Spark's skew join splits a seed that very many texts have.
    """

    def all_seeds(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            digests, texts = batch.columns
            for i, text in enumerate(texts):
                words = word_hashes(text.as_py())
                keys = np.unique(np.concatenate([seeds(words, m, k) for k, m in enumerate(MASKS)])).view(np.int64)
                yield pa.RecordBatch.from_arrays([digests.take(pa.array([i] * len(keys), pa.int64())), pa.array(keys)], ["digest", "seed"])

    def verify(batches: Iterator) -> Iterator:
        for batch in batches:
            docs, items, texts, item_texts = batch.columns
            out = []
            for i, (a, b) in enumerate(zip(texts, item_texts, strict=True)):
                one = Items([(0, b.as_py())])
                words = word_hashes(a.as_py())
                if best := verified(words, one.words[0], sorted(s for _, s in one.alignments(words)), min_words, min_share):
                    out.append((i, *best))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(at), items.take(at), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], ["doc", "item", "matched_words", "overlap_words", "first_word"])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select("digest", "text").mapInArrow(all_seeds, "digest binary, seed long").distinct().withColumnRenamed("digest", name)

    def texts(df: DataFrame, name: str, text: str) -> DataFrame:
        return df.groupBy("digest").agg(F.first("text").alias(text)).withColumnRenamed("digest", name)

    pairs = keyed(d, "doc").join(keyed(t, "item"), "seed").select("doc", "item").distinct()
    both = pairs.join(texts(d, "doc", "text"), "doc").join(texts(t, "item", "item_text"), "item")
    return both.select("doc", "item", "text", "item_text").mapInArrow(verify, "doc binary, item binary, matched_words long, overlap_words long, first_word long")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id of every document that holds a test item, once each."""
    return overlaps(docs, items, **options).select("doc_id").distinct()


def without_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, text_col: str = "text", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item.

    Each row is judged by its text alone, so ids may be null or repeated. Null and empty texts stay.
    """
    t = items.select(F.col(item_text_col).alias("text"))
    if not _sendable(t, broadcast_seeds):
        rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("digest"))
        pairs = _verified_pairs(rows.select("text", "digest"), t.withColumn("digest", _digest(F.col("text"))), min_words, min_share)
        return rows.join(pairs.select(F.col("doc").alias("digest")), "digest", "left_anti").select("row.*")
    sent = docs.sparkSession.sparkContext.broadcast([(i, r["text"]) for i, r in enumerate(t.collect())])  # bounded by its counted seeds

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Items(sent.value)

        def one(text) -> bool:
            words = word_hashes(text)
            by_item: dict[int, list[int]] = {}
            for item, shift in known.alignments(words):
                by_item.setdefault(item, []).append(shift)
            return not any(verified(words, known.words[i], shifts, min_words, min_share) for i, shifts in by_item.items())

        for texts in batches:
            yield pa.array((one(t.as_py()) for t in texts), pa.bool_(), size=len(texts))

    return docs.where(clean(F.coalesce(F.col(text_col), F.lit(""))))
