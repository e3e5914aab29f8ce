"""Links between texts whose sets of word shingles resemble each other (Jaccard).

A 64-bit fingerprint can't tell a pair of similarity 0.8 from a looser one: such pairs differ
in 5 to 14 bits. Here texts of the same three least shingles under one of 16 hash orders meet
in a cell: at similarity s a pair of long texts misses all cells with probability
(1 - s^3)^16, 1e-5 at 0.8 (3e-4 for sets of five). There is no exact way for pairs that share
no cell: links are found with that probability only, so a group may rarely stay in two.

Within a cell the whole sets are compared and nothing but a spanning forest leaves the task,
so a group of copies never gives all its pairs. Cells of the same members are compared once,
and cells whose members are joined already not at all. A cell beyond a bound is split: first
every block compares its members with each other and with the cell's first set, which joins
nearly all of a group of copies in linear work; then the members outside the cell's largest
group are compared with each other and with that group, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import fingerprint_of
from .staging import Stage

BANDS = 16
LEAST = 3
#: Bands of the first round; what it joins needs no comparison in the second.
FIRST_BANDS = 6
#: Sets, and hashes of sets, that one block should hold; a task compares two blocks at most.
BLOCK, BLOCK_HASHES = 512, 1 << 20
#: Columns of the incidence matrix that are multiplied at a time.
STRIP = 4096


def shingle_set(text: str | None, words: int = 5):
    """The distinct shingle hashes of a text, sorted; none without words."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(tokens[i : i + words]), 42) for i in range(n)), np.uint64, n))


def _set_key(hashes) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import numpy as np
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist())


def _mixed(hashes, order: int):
    """The hashes under another hash order."""
    import numpy as np

    x = (hashes ^ np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _cells_of(hashes) -> list[int]:
    import numpy as np
    import xxhash

    out = []
    for band in range(BANDS):
        mixed = _mixed(hashes, band + 1)
        least = np.sort(np.partition(mixed, LEAST - 1)[:LEAST] if len(mixed) > LEAST else mixed)
        out.append(xxhash.xxh64_intdigest(least.tobytes(), band))
    return np.array(out, np.uint64).view(np.int64).tolist()


def profiles(docs: DataFrame, fingerprint_words: int, words: int) -> DataFrame:
    """Of docs(doc_id, digest, text): doc_id, digest, fp (as ``fingerprints`` has it), and of the shingle set k0, k1, n, cells.

    Texts without words have no set: null in all columns of it.
    """

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for t in batch.column(2):
                text = t.as_py()
                fp, found = fingerprint_of(text, fingerprint_words), shingle_set(text, words)
                fp = fp - (1 << 64) if fp >> 63 else fp
                rows.append((fp, *_set_key(found), len(found), _cells_of(found)) if len(found) else (fp, *[None] * 4))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "digest", "fp", "k0", "k1", "n", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "digest", "text").mapInArrow(compute, f"doc_id {kind}, digest binary, fp long, k0 long, k1 long, n long, cells array<long>")


def alike(sets: list, similarity: float):
    """Which of the sets resemble each other, as a boolean matrix.

    Counts of common hashes are products of an incidence matrix with itself, in strips of
    columns; hashes of one set only have no part in them.
    """
    import numpy as np

    size = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        common = np.array([[size[0], len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        common[1] = common[1, 1], size[1]
    else:
        owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        column = np.cumsum(new) - 1
        shared = (np.bincount(column) > 1)[column]
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        kind = np.float32 if size.max(initial=0) < 1 << 24 else np.float64
        common = np.zeros((len(sets), len(sets)))
        cuts = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + STRIP, STRIP))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            strip = np.zeros((len(sets), STRIP), kind)
            strip[owner[a:b], column[a:b] - i * STRIP] = 1
            common += strip @ strip.T
        np.fill_diagonal(common, size)
    return common >= similarity * (size[:, None] + size - common) - 1e-9


def forest(linked, groups) -> list[tuple[int, int]]:
    """Edges between ``groups`` (a label for each row) that join what the links of the matrix join."""
    import numpy as np

    _, label = np.unique(groups, return_inverse=True)
    edges: list[tuple[int, int]] = []
    for x in range(len(linked)):
        others = np.unique(label[linked[x]])
        others = others[others != label[x]]
        if len(others):
            edges += [(x, int(np.argmax(label == o))) for o in others]
            label[np.isin(label, others)] = label[x]
    return edges


def _compared(similarity: float):
    """Of rows sorted by band, cell and block: edges (a, b) between roots whose sets resemble each other."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def edges(rows: list[tuple]) -> list[tuple[int, int]]:
            if len(rows) < 2 or len({g for _, g, _ in rows}) == 1:
                return []
            sets = [np.frombuffer(h, np.uint64) for _, _, h in rows]
            return [(rows[x][0], rows[y][0]) for x, y in forest(alike(sets, similarity), np.array([g for _, g, _ in rows]))]

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        now, held, found = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, root, group, hashes in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if key != now:
                    found += edges(held)
                    now, held = key, []
                held.append((root, group, hashes.as_py()))
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        yield batch_of(found + edges(held))

    return run


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """k0, k1, hashes (8 bytes each, sorted) of every text with words."""

    def compute(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def batch_of(sets: list) -> pa.RecordBatch:
            keys = np.array([_set_key(x) for x in sets], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())], ["k0", "k1", "hashes"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                found = shingle_set(t.as_py(), words)
                if len(found):
                    held.append(found)
                    size += len(found)
                if size > 500_000:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return docs.select("text").mapInArrow(compute, "k0 long, k1 long, hashes binary")


def _groups(rows: str, hashes: str, block: int):
    """Blocks that so many sets with so many hashes in all are dealt to."""
    return F.ceil(F.greatest(F.col(rows) / F.lit(block), F.col(hashes) / F.lit(BLOCK_HASHES))).cast("long")


def _dealt(parts, first):
    """The block of a set; ``first`` is shown to all."""
    own = F.pmod(F.xxhash64("k0", "k1"), parts)
    return F.explode(F.when(first & (parts > 1), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))).alias("block")


def _first_meetings(rows: DataFrame, block: int) -> DataFrame:
    """Each cell's rows by block, its first set in all of its blocks."""
    first = (F.col("k0") == F.col("first.k0")) & (F.col("k1") == F.col("first.k1"))
    return rows.select("band", "cell", _dealt(_groups("m", "hashed", block), first), "k0", "k1", "root", "component")


def last_meetings(rows: DataFrame, block: int) -> DataFrame:
    """Of cells of several blocks: the sets outside the largest group meet each other and that group.

    With r sets outside in one block a cell's rows grow by r for each block of the largest group.
    """
    by_group = rows.groupBy("band", "cell", "component").agg(F.count("*").alias("c"), F.sum("n").alias("h"), F.first("m").alias("m"), F.first("hashed").alias("hashed"))
    largest = by_group.groupBy("band", "cell").agg(F.max(F.struct("c", "component", "h")).alias("x"), F.first("m").alias("m"), F.first("hashed").alias("hashed"))
    sized = largest.select("band", "cell", F.col("x.component").alias("core"), F.col("x.c").alias("in_core"), F.col("x.h").alias("core_hashes"), (F.col("m") - F.col("x.c")).alias("outside"), (F.col("hashed") - F.col("x.h")).alias("outside_hashes"))
    deal = sized.select("band", "cell", "core", _groups("in_core", "core_hashes", block).alias("inner"), _groups("outside", "outside_hashes", block).alias("outer"))
    both = rows.drop("m", "hashed", "first").join(deal, ["band", "cell"])
    inner, outer, own = F.col("inner"), F.col("outer"), F.xxhash64("k0", "k1")
    zero = F.lit(0).cast("long")
    i, o = F.pmod(own, inner), F.pmod(own, outer)
    # block (o, i) with i < inner: a block outside meets one of the largest group; (o, inner + p) with o <= p: two blocks outside
    of_core = F.transform(F.sequence(zero, outer - 1), lambda q: q * (inner + outer) + i)
    with_core = F.transform(F.sequence(zero, inner - 1), lambda q: o * (inner + outer) + q)
    outside = F.transform(F.sequence(zero, outer - 1), lambda q: F.least(o, q) * (inner + outer) + inner + F.greatest(o, q))
    blocks = F.when(F.col("component") == F.col("core"), of_core).otherwise(F.concat(with_core, outside))
    return both.select("band", "cell", F.explode(blocks).alias("block"), "k0", "k1", "root", "component")


def joined_components(docs: DataFrame, profiled: DataFrame, links: DataFrame, similarity: float = 0.8, words: int = 5, block: int = BLOCK) -> DataFrame:
    """(node, component) over ``links(a, b)`` between fingerprints and the links of texts that
    resemble each other in ``similarity`` or more.

    ``docs`` has doc_id, digest and text, ``profiled`` is a written table of ``profiles(docs, ...)``.
    Texts of equal sets are linked, whatever their fingerprints. Texts without words have no
    links of this kind. Null and repeated ids are rows like others. A cell beyond ``block`` sets
    is dealt to blocks of which any two that aren't joined yet meet.
    """
    named = profiled.where("k0 IS NOT NULL")
    one = F.min(F.struct("digest", "doc_id")).alias("one")
    kinds = Stage(named.groupBy("k0", "k1").agg(one, F.min("fp").alias("node"), F.first("n").alias("n"), F.first("cells").alias("cells")), "kinds")
    same = named.select("k0", "k1", "fp").distinct().join(kinds.df.select("k0", "k1", "node"), ["k0", "k1"]).where("fp <> node")
    roots = Stage(connected_components(links.unionByName(same.select(F.col("fp").alias("a"), F.col("node").alias("b")))), "roots")

    rooted = kinds.df.join(roots.df.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rooted.select("k0", "k1", "n", "root", F.posexplode("cells").alias("band", "cell"))
    key = F.xxhash64("k0", "k1")
    cells = rows.groupBy("band", "cell").agg(F.count("*").alias("m"), F.sum("n").alias("hashed"), F.min(F.struct("k0", "k1")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(key).alias("x"), F.sum(key.cast("decimal(38,0)")).alias("y"))
    once = cells.where("m > 1 AND low <> high").groupBy("m", "x", "y").agg(F.min_by(F.struct("cell", "hashed", "first"), "band").alias("c"), F.min("band").alias("band"))
    meeting = once.select("band", "c.cell", "m", "c.hashed", "c.first")
    members = Stage(rows.join(meeting, ["band", "cell"]), "members")
    if members.df.isEmpty():
        return _ended(roots.df, kinds, members, roots)
    wanted = members.df.select("k0", "k1").distinct().join(kinds.df.select("k0", "k1", "one"), ["k0", "k1"]).select(F.col("one.doc_id").alias("_id"), F.col("one.digest").alias("_digest"))
    texts = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["digest"] == F.col("_digest")), "left_semi")
    sets = Stage(_sets(texts, words).dropDuplicates(["k0", "k1"]), "sets")
    kinds.drop()

    found, now = [], None
    several = _groups("m", "hashed", block) > 1
    for chosen, meet in ((F.col("band") < FIRST_BANDS, _first_meetings), (F.col("band") >= FIRST_BANDS, _first_meetings), (several, last_meetings)):
        rows = members.df.where(chosen)
        if rows.isEmpty():
            continue
        if now is None:
            rows = rows.withColumn("component", F.col("root"))
        else:
            rows = rows.join(now.df.withColumnRenamed("node", "root"), "root", "left").withColumn("component", F.coalesce("component", "root"))
            left = rows.groupBy("band", "cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "cell")
            rows = rows.join(left, ["band", "cell"], "left_semi")
        dealt = meet(rows, block).join(sets.df, ["k0", "k1"])
        ordered = dealt.repartition("band", "cell", "block").sortWithinPartitions("band", "cell", "block", "k0", "k1")
        found.append(Stage(ordered.select("band", "cell", "block", "root", "component", "hashes").mapInArrow(_compared(similarity), "a long, b long").distinct(), "alike"))
        edges = found[0].df
        for x in found[1:]:
            edges = edges.unionByName(x.df)
        if now is not None:
            now.drop()
        now = Stage(connected_components(edges), "joined")
    final = roots.df.withColumnRenamed("component", "root").join(now.df.select(F.col("node").alias("root"), "component"), "root", "left")
    # roots that no fingerprint links to another are nodes of their own
    alone = now.df.join(roots.df.select("node"), "node", "left_anti")
    return _ended(final.select("node", F.coalesce("component", "root").alias("component")).unionByName(alone.select("node", "component")), *found, now, members, sets, roots)


def _ended(answer: DataFrame, *stages: Stage) -> DataFrame:
    """The answer, written; the stages it came from are deleted."""
    out = Stage(answer, "components").df
    for x in stages:
        x.drop()
    return out
