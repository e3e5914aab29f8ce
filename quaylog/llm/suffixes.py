"""Removal of repeated byte strings by a distributed difference-cover algorithm.

Only the order of suffixes up to ``window`` bytes matters here, so the difference cover is
one of a large period v and names end the recursion after one level:

1. sample: positions whose residue mod v lies in a perfect difference cover D. Any two starts
   i, j have a shift below v that takes both to sampled positions, so two equal windows hold
   two equal sampled tuples of window - v + 1 bytes.
2. sort the sampled tuples by name (a fingerprint in place of a rank: equality is all
   that is asked of the order) in ranges of names, and keep the positions whose name isn't alone.
3. merge the remaining suffixes: the starts up to v - 1 before a kept position are the only
   candidates. Their windows are named and sorted in the same way, and adjacent names that
   are equal are repeated windows.

Names are polynomials modulo the prime 2**61 - 1 at a base drawn anew for each run: two windows
of n bytes, whatever they are, share a name for at most n of the 2**61 bases. Windows have a
second name at a base of its own, of 16 bits, or of 61 for more than 8 GB of text, so of 1e9
different windows two are taken for equal once in 1,000 runs at the most.

Textbook recursion would sort two thirds of all suffixes in every round; here about one
position in nine is sorted, then the candidates. Texts are held as chunks of some MB in a table
bucketed by chunk; tasks send sorted arrays of names by range and get back one bit for each.
A string that occurs in a third of all texts is sent once by each chunk.

Equal texts are collapsed first: a text with copies is removed whole, and one stands for all
in the search.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import salted_join
from .staging import Stage, release, shared_dir, staged

#: Perfect difference sets: every residue other than 0 is a difference exactly once. Fixed values.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
CHUNK_BYTES = 4 << 20
#: Chunks that a bucket of the chunk table should hold at most.
BUCKET_CHUNKS = 16
#: Names that one range of the sort should hold.
RANGE_NAMES = 1 << 20
#: Bytes of text beyond which second names of windows are whole.
WIDE_FROM = 1 << 33
PRIME = (1 << 61) - 1
#: Starts that are named at a time.
NAMED_BYTES = 1 << 16


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period of at most half the window; (1, (0,)) for windows under 14."""
    fit = [v for v in COVERS if 2 * v <= window]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _times(a, b):
    """Products modulo PRIME of arrays below it, from halves of 32 bits: 2**61 is 1 there."""
    import numpy as np

    low, three, p = np.uint64(0xFFFFFFFF), np.uint64(3), np.uint64(PRIME)
    a1, a0, b1, b0 = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    middle, least = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << three) + _shifted(middle) + (least & p) + (least >> np.uint64(61)))


def _shifted(x):
    """x * 2**32 modulo PRIME, not fully reduced."""
    import numpy as np

    return (x >> np.uint64(29)) + ((x & np.uint64((1 << 29) - 1)) << np.uint64(32))


def _reduced(x):
    import numpy as np

    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


class Names:
    """Names of byte strings of one body: polynomials in a base modulo PRIME, mixed to 64 bits."""

    powers: dict = {}

    @classmethod
    def _powers(cls, base: int, n: int):
        """Powers of the base as halves, and of its inverse."""
        import numpy as np

        have = cls.powers.get(base)
        if have is None or len(have[0]) < n:
            out = []
            for b in (base, pow(base, -1, PRIME)):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    p = np.concatenate([p, _times(p, np.full(len(p), pow(b, len(p), PRIME), np.uint64))])
                out.append(p)
            cls.powers.clear() if len(cls.powers) > 1 else None
            have = cls.powers[base] = (out[0] >> np.uint64(32), out[0] & np.uint64(0xFFFFFFFF), out[1])
        return have

    def __init__(self, body, base: int):
        self.body, self.base = body, base

    def of(self, starts, length: int):
        """Names of the strings at ``starts``, in order."""
        import numpy as np

        high, low, inverse = self._powers(self.base, NAMED_BYTES + length)
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(self.body) + NAMED_BYTES, NAMED_BYTES))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a == b:
                continue
            at = k * NAMED_BYTES
            part = self.body[at : at + NAMED_BYTES + length].astype(np.uint64) + np.uint64(1)
            own = starts[a:b] - at
            sums = []
            for half in (high, low):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * half[: len(part)], out=total[1:])
                sums.append(total[own + length] - total[own])
            out[a:b] = _times(_reduced(_shifted(sums[0]) + sums[1]), inverse[own])
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(by)
        return out ^ (out >> np.uint64(31))


class Chunk:
    """Texts of one chunk laid end to end, and what is known of their positions."""

    def __init__(self, body: bytes, lengths, window: int, bases: tuple[int, int]):
        import numpy as np

        self.body = np.frombuffer(body, np.uint8)
        self.lengths = np.asarray(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.window = window
        self.names = [Names(self.body, b) for b in bases]
        self.period, self.cover = cover_for(window)

    def sampled(self):
        """Starts of sampled tuples, in order; none crosses the end of a text."""
        import numpy as np

        span = self.window - self.period + 1
        out = []
        for b, n in zip(self.begins.tolist(), self.lengths.tolist(), strict=True):
            if n >= self.window:
                rows = np.arange(b, b + n - span + 1, self.period)
                at = (rows[:, None] + np.array(self.cover)).ravel()
                out.append(at[at <= b + n - span])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, kept):
        """Starts of windows that hold a kept tuple at a shift below the period."""
        import numpy as np

        edge = np.zeros(len(self.body) + 1, np.int32)
        begin = self.begins[np.searchsorted(self.ends, kept, side="right")]
        np.add.at(edge, np.maximum(kept - self.period + 1, begin), 1)
        np.add.at(edge, kept + 1, -1)
        ok = np.cumsum(edge[:-1]) > 0
        for e, n in zip(self.ends.tolist(), self.lengths.tolist(), strict=True):
            ok[max(e - self.window + 1, e - n) : e] = False
        return np.nonzero(ok)[0]

    def named(self, starts, length: int, extra: int):
        """(distinct names in order, place of each start's name, names that occur twice here).

        With ``extra`` bytes of the second name behind the first.
        """
        import numpy as np

        names = [self.names[0].of(starts, length)]
        if extra:
            names.append(self.names[1].of(starts, length).astype(f"<u{extra}"))
        order = np.argsort(names[0]) if len(names) == 1 else np.lexsort(names[::-1])
        ordered = [n[order] for n in names]
        new = np.ones(len(starts), bool)
        if len(starts):
            new[1:] = np.any([o[1:] != o[:-1] for o in ordered], axis=0)
        place = np.empty(len(starts), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        return [o[first] for o in ordered], place, np.diff(np.append(first, len(starts))) > 1


def _ranges(names, bits: int):
    """(range, begin, end) of the runs of distinct sorted names by their first bits."""
    import numpy as np

    key = names[0] >> np.uint64(64 - bits)
    if not len(key):
        return
    cut = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
        yield int(key[a]), a, b


def _repeated(chunk: Chunk, starts, length: int, extra: int, hits: dict[int, bytes], bits: int):
    """Starts whose name occurs twice, here or by the bits that came back for each range."""
    import numpy as np

    names, place, found = chunk.named(starts, length, extra)
    for r, a, b in _ranges(names, bits):
        if r in hits:
            found[a:b] |= np.unpackbits(np.frombuffer(hits[r], np.uint8), count=b - a).astype(bool)
    return starts[found[place]]


class Level:
    """A round of the sort: bits of a name that are its range, bytes of second names, tasks."""

    def __init__(self, number: int, names: int, extra: int, least_tasks: int):
        self.number, self.extra = number, extra
        self.bits = max(8, min(40, (names // RANGE_NAMES).bit_length()))
        self.tasks = min(1 << self.bits, max(least_tasks, -(-names // RANGE_NAMES)))


def _chunked(pool: DataFrame, chunk_bytes: int) -> DataFrame:
    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base, n, ids, lengths, parts = TaskContext.get().partitionId() << 32, 0, [], [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["chunk", "digests", "lengths", "body"],
            )

        for batch in batches:
            for digest, text in zip(*batch.columns, strict=True):
                body = text.as_buffer().to_pybytes()
                if parts and sum(lengths) + len(body) > chunk_bytes:
                    yield row()
                    n, ids, lengths, parts = n + 1, [], [], []
                ids.append(digest.as_py())
                lengths.append(len(body))
                parts.append(body)
        if parts:
            yield row()

    return pool.select("digest", "text").mapInArrow(pack, "chunk long, digests array<string>, lengths array<long>, body binary")


def _send(rows: DataFrame, levels: list[Level], window: int, bases: tuple[int, int]) -> DataFrame:
    """(range, chunk, names): each chunk's distinct names of the last of ``levels``, sorted, by range.

    The bytes that the range already gives aren't sent.
    """
    level = levels[-1]

    def send(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width = 8 - level.bits // 8
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                chunk = Chunk(cols["body"][i].as_buffer(), cols["lengths"][i].as_py(), window, bases)
                span = window - chunk.period + 1
                starts, length = chunk.sampled(), span
                if level.number:
                    hits = {h["range"]: h["bits"] for h in cols["hits"][i].as_py() if h["level"] == 0}
                    starts, length = chunk.candidates(_repeated(chunk, starts, span, 0, hits, levels[0].bits)), window
                names, _, _ = chunk.named(starts, length, level.extra)
                first = names[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                out = [(r, first[a:b].tobytes() + b"".join(n[a:b].tobytes() for n in names[1:])) for r, a, b in _ranges(names, level.bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in out], pa.int64()), pa.array([cols["chunk"][i].as_py()] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())],
                    ["range", "chunk", "names"],
                )

    return rows.mapInArrow(send, "range long, chunk long, names binary")


def _compare(sent: DataFrame, level: Level) -> DataFrame:
    """(level, range, chunk, found, bits): which, and how many, of a chunk's names another chunk has too."""
    number, bits, extra = level.number, level.bits, level.extra

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width = 8 - bits // 8

        def unpack(r: int, blob: bytes):
            n = len(blob) // (width + extra)
            raw = np.zeros((n, 8), np.uint8)
            raw[:, :width] = np.frombuffer(blob, np.uint8, n * width).reshape(n, width)
            first = raw.view("<u8").ravel() | (np.uint64(r >> (bits % 8)) << np.uint64(64 - 8 * (bits // 8)))
            return (first, np.frombuffer(blob, f"<u{extra}", n, n * width)) if extra else (first,)

        def answer(r: int, held: list) -> pa.RecordBatch:
            arrays = [unpack(r, blob) for _, blob in held]
            every = [np.concatenate(x) for x in zip(*arrays, strict=True)]
            order = np.argsort(every[0], kind="stable") if not extra else np.lexsort(every[::-1])
            same = np.ones(max(0, len(order) - 1), bool)
            for x in every:
                y = x[order]
                same &= y[1:] == y[:-1]
            found = np.zeros(len(order), bool)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            cuts = np.cumsum([len(a[0]) for a in arrays])[:-1]
            out = [(c, int(f.sum()), np.packbits(f).tobytes()) for (c, _), f in zip(held, np.split(found, cuts), strict=True) if f.any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * len(out), pa.int32()), pa.array([r] * len(out), pa.int64()), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))],
                ["level", "range", "chunk", "found", "bits"],
            )

        now, held = None, []
        for batch in batches:
            for r, c, blob in zip(*batch.columns, strict=True):
                if r.as_py() != now and held:
                    yield answer(now, held)
                    held = []
                now = r.as_py()
                held.append((c.as_py(), blob.as_py()))
        if held:
            yield answer(now, held)

    return sent.repartition(level.tasks, "range").sortWithinPartitions("range").mapInArrow(compare, "level int, range long, chunk long, found long, bits binary")


def removed_spans(lengths, repeated, window: int):
    """By text of a chunk: (n_removed, n_spans, kept mask) from the starts of repeated windows."""
    import numpy as np

    edge = np.zeros(int(sum(lengths)) + 1, np.int32)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    at = 0
    for n in lengths:
        mine = gone[at : at + n]
        yield int(mine.sum()), int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()), ~mine
        at += n


def _digests(rows: DataFrame, levels: list[Level], window: int, bases: tuple[int, int]) -> DataFrame:
    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                lengths = cols["lengths"][i].as_py()
                chunk = Chunk(cols["body"][i].as_buffer(), lengths, window, bases)
                span = window - chunk.period + 1
                by: tuple[dict, dict] = ({}, {})
                for h in cols["hits"][i].as_py() or ():
                    by[h["level"]][h["range"]] = h["bits"]
                starts = chunk.candidates(_repeated(chunk, chunk.sampled(), span, 0, by[0], levels[0].bits))
                starts = _repeated(chunk, starts, window, levels[1].extra, by[1], levels[1].bits)
                out = list(removed_spans(lengths, starts, window))
                shas = [hashlib.sha256(chunk.body[b : b + n][kept].tobytes()).hexdigest() for b, n, (_, _, kept) in zip(chunk.begins.tolist(), lengths, out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["digests"][i].as_py(), pa.string()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(shas, pa.string())],
                    ["digest", "n_removed", "n_spans", "kept_sha256"],
                )

    return rows.mapInArrow(digest, "digest string, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed where it lies in a string of ``window`` bytes that also starts anywhere
    else, in the same document or another, overlapping itself or not; all is judged on the
    input. Null texts count as empty. Texts under ``window`` bytes lose nothing. Repeated rows
    are copies of each other and are removed whole. Null ids get rows. No rows give no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    slim = Stage(keyed.select("doc_id", "digest", "n_bytes"), "texts").df
    groups = slim.where(F.col("n_bytes") >= window).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    period, cover = cover_for(window)
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bases = (1 + secrets.randbelow(PRIME - 1), 1 + secrets.randbelow(PRIME - 1))
    levels = [Level(0, total * len(cover) // period, 0, least_tasks)]

    pool = keyed.where(F.col("n_bytes") >= window).alias("d").join(groups.alias("g"), (F.col("d.digest") == F.col("g.digest")) & F.col("d.doc_id").eqNullSafe(F.col("g.one")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (BUCKET_CHUNKS * chunk_bytes)))
    table, path = f"quaylog_chunks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/quaylog/chunks-{uuid.uuid4().hex}"
    chunked = _chunked(pool.select("d.digest", "d.text"), chunk_bytes)
    chunked.repartition(n, "chunk").write.option("compression", "zstd").option("path", path).bucketBy(n, "chunk").saveAsTable(table)
    release(spark)
    chunks = spark.table(table)

    def with_hits(hits: DataFrame, how: str) -> DataFrame:
        listed = hits.groupBy("chunk").agg(F.collect_list(F.struct("level", "range", "bits")).alias("hits"))
        return chunks.join(listed.hint("shuffle_hash"), "chunk", how).select("chunk", "digests", "lengths", "body", "hits")

    names = Stage(_compare(_send(chunks.select("chunk", "lengths", "body"), levels, window, bases), levels[0]), "names")
    release(spark)
    # a repeated stretch has a candidate at each byte and kept tuples in the cover's share of them, a tuple alone
    # has a period's candidates: a third of that is between
    kept = names.df.agg(F.sum("found")).first()[0] or 0
    levels.append(Level(1, min(total, kept * max(1, period // 3)), 8 if total > WIDE_FROM else 2, least_tasks))
    windows = Stage(_compare(_send(with_hits(names.df, "inner"), levels, window, bases), levels[1]), "windows")
    release(spark)
    found = Stage(_digests(with_hits(names.df.unionByName(windows.df), "left"), levels, window, bases).dropDuplicates(["digest"]), "removed")
    names.drop()
    windows.drop()
    spark.sql(f"DROP TABLE {table}")
    chunk_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    chunk_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(chunk_path, True)

    answer = staged(groups.join(found.df, "digest").select("digest", "copies", "n_removed", "n_spans", "kept_sha256"), "answer")
    copied = F.col("copies") > 1
    return salted_join(slim, answer, "digest", "copies", rows, "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
