"""SimHash near-duplicate groups by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 4 are alike in at least one of three
parts: by the pigeonhole principle at most 1 bit differs in the first 24 bits, or at most 1
in the next 24, or none in the last 16 (2 + 2 + 1 > 4). In a part of 24 bits the anchors are
the words whose first 15 bits are in the perfect Hamming code: covering radius 1, so each
fingerprint has one home anchor, and any partner within 1 bit lies within radius + threshold
= 2 of it. Fingerprints are sent to all anchors within 2 (17 to 46, 19 on average) and compared
at each anchor: those at home there with all others. The last part needs no radius.
More bits than 4 are met with more parts.

Distinct fingerprints only are compared. At an anchor a spanning set of the links found is
returned, never all pairs, and an anchor with many fingerprints is split into a grid of
blocks that go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hot_keys import salted_join
from .staging import Stage, staged

#: Fingerprints of one anchor that one block compares.
BLOCK = 4096


def parts_for(threshold: int) -> list[tuple[int, int, int]]:
    """(shift, bits, allowed) of each part: sum(allowed + 1) > threshold, allowed 0 or 1.

    As few parts of 1 as reach the threshold and one of 0 if need be; bits as even as the
    code permits, a part of 0 being shorter as it has no radius.
    """
    ones, zero = divmod(threshold + 1, 2)
    tail = (16 if ones <= 2 else 64 // (ones + 1)) if zero else 0
    width, extra = divmod(64 - tail, ones) if ones else (0, 0)
    out, shift = [], 0
    for i in range(ones):
        bits = width + (i < extra)
        out.append((shift, bits, 1))
        shift += bits
    if zero:
        out.append((shift, 64 - shift, 0))
    return out


def coded_bits(bits: int) -> int:
    """Length of the perfect Hamming code that fits a part; its check gives bit i syndrome i + 1."""
    return 15 if bits >= 15 else 7 if bits >= 7 else 0


def anchor_masks(bits: int) -> list[list[int]]:
    """By syndrome: the changes of at most 2 bits that lead to an anchor, the home anchor's first."""
    coded = coded_bits(bits)
    syndrome = [i + 1 if i < coded else 0 for i in range(bits)]
    out: list[list[int]] = [[] for _ in range(coded + 1)]
    for weight in range(3):
        for at in combinations(range(bits), weight):
            s = 0
            for i in at:
                s ^= syndrome[i]
            out[s].append(sum(1 << i for i in at))
    return [sorted(row, key=int.bit_count) for row in out]


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The fingerprint of one text; zero without words."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        pairs = zip(starts[at : min(n, at + step)].tolist(), last[at : at + step].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.columns
            found = [fingerprint_of(t.as_py(), words) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([f - (1 << 64) if f >> 63 else f for f in found], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, f"doc_id {kind}, fp long")


def _cells(fps: DataFrame, threshold: int) -> DataFrame:
    """(part, anchor, fp, home): each fingerprint at every anchor it is sent to."""
    sent = []
    for part, (shift, bits, allowed) in enumerate(parts_for(threshold)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        if not allowed:
            sent.append(fps.select(F.lit(part).alias("part"), value.alias("anchor"), "fp", F.lit(True).alias("home")))
            continue
        coded = coded_bits(bits)
        syndrome = F.lit(0).cast("int")
        for k in range(coded.bit_length()):
            check = sum(1 << i for i in range(coded) if (i + 1) >> k & 1)
            syndrome = syndrome + (F.bit_count(value.bitwiseAND(F.lit(check))) % 2) * (1 << k)
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in anchor_masks(bits)])
        there = fps.select("fp", value.alias("v"), F.posexplode(F.element_at(masks, (syndrome + 1).cast("int"))).alias("i", "mask"))
        sent.append(there.select(F.lit(part).alias("part"), F.col("v").bitwiseXOR(F.col("mask")).alias("anchor"), "fp", (F.col("i") == 0).alias("home")))
    out = sent[0]
    for x in sent[1:]:
        out = out.unionByName(x)
    return out


def _spanning(threshold: int):
    """Links within runs of rows of the same cell, as a spanning forest of each run."""

    def runs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def forest(fp, home) -> tuple[list[int], list[int]]:
            """Edges of a spanning forest of the links of one cell."""
            label, a, b = np.arange(len(fp)), [], []
            for x in np.nonzero(home)[0].tolist():
                near = np.nonzero(np.bitwise_count(fp ^ fp[x]) <= threshold)[0]
                others, at = np.unique(label[near], return_index=True)
                apart = others != label[x]
                if apart.any():
                    a += [x] * int(apart.sum())
                    b += near[at[apart]].tolist()
                    label[np.isin(label, others[apart])] = label[x]
            return a, b

        def links(cells) -> pa.RecordBatch:
            """cells: columns part, anchor, block, fp, home of whole cells."""
            key = [cells[c] for c in ("part", "anchor", "block")]
            fp, home = cells["fp"].view(np.uint64), cells["home"]
            new = np.ones(len(fp), bool)
            new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
            start = np.nonzero(new)[0]
            size = np.diff(np.append(start, len(fp)))
            cell = np.repeat(np.arange(len(start)), size)
            some = np.zeros(len(start), bool)
            some[cell[home]] = True
            out_a, out_b = [], []
            small = np.nonzero((size > 1) & (size <= 32) & some)[0]
            for lag in range(1, int(size[small].max(initial=0))):
                at = start[small[size[small] > lag]]
                ends = at + size[small[size[small] > lag]]
                left = np.concatenate([np.arange(s, e - lag) for s, e in zip(at.tolist(), ends.tolist(), strict=True)]) if len(at) < 64 else _ranges(at, ends - lag)
                right = left + lag
                ok = (home[left] | home[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= threshold)
                out_a.append(fp[left[ok]])
                out_b.append(fp[right[ok]])
            for k in np.nonzero((size > 32) & some)[0].tolist():
                s, e = int(start[k]), int(start[k] + size[k])
                a, b = forest(fp[s:e], home[s:e])
                out_a.append(fp[s:e][a])
                out_b.append(fp[s:e][b])
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.uint64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)
            differ = a != b
            pair = np.unique(np.stack([a[differ].view(np.int64), b[differ].view(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        def _ranges(begin, end):
            length = end - begin
            shift = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
            return np.arange(int(length.sum())) + shift

        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            held.append(now)
            last = tuple(now[c][-1] for c in ("part", "anchor", "block"))
            if last == tuple(held[0][c][0] for c in ("part", "anchor", "block")) or sum(len(h["fp"]) for h in held) < 100_000:
                continue
            whole = {c: np.concatenate([h[c] for h in held]) for c in now}
            rest = (whole["part"] == last[0]) & (whole["anchor"] == last[1]) & (whole["block"] == last[2])
            yield links({c: v[~rest] for c, v in whole.items()})
            held = [{c: v[rest] for c, v in whole.items()}]
        if held:
            yield links({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return runs


def fingerprint_links(fps: DataFrame, threshold: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within the threshold; their components are
    those of all links. ``fps`` has one row per distinct fingerprint.

    A cell of more than ``block`` rows is dealt to a grid of blocks: row group i meets row
    group j in block (i, j), so no link is lost and no task gets more than two groups.
    """
    cells = Stage(_cells(fps, threshold), "cells")
    crowded = cells.df.groupBy("part", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > block)
    split = cells.df.join(crowded, ["part", "anchor"], "left").withColumn("groups", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int"))
    group = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda i: F.least(i, group) * F.col("groups") + F.greatest(i, group))
    dealt = split.select("part", "anchor", F.explode(pairs).alias("block"), "fp", "home")
    ordered = dealt.repartition("part", "anchor", "block").sortWithinPartitions("part", "anchor", "block", "fp")
    return ordered.select("part", "anchor", "block", "fp", "home").mapInArrow(_spanning(threshold), "a long, b long")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, similarity: float | None, set_words: int) -> tuple[Stage, DataFrame]:
    """(by document: doc_id, digest, fp; by fingerprint that has links: node, component)."""
    from . import resemblance

    text = F.col(text_col)
    if similarity is None:
        by_doc = Stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    else:
        keyed = docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), text.alias("text"))
        by_doc = Stage(resemblance.profiles(keyed, words, set_words), "profiles")
    links = fingerprint_links(by_doc.df.select("fp").distinct(), threshold)
    if similarity is None:
        return by_doc, staged(connected_components(links), "components")
    return by_doc, resemblance.joined_components(keyed, by_doc.df, links, similarity, set_words)


def _digest(text: Column) -> Column:
    """What stands for a text: its SHA-256; a null text is like an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, similarity: float | None = None, set_words: int = 5
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    With a ``similarity``, texts whose sets of ``set_words`` words resemble each other in as
    much are linked as well (``resemblance``).

    ``component_id`` is the smallest doc_id that links of at most ``threshold`` differing bits
    reach. Texts without words (null, empty, white space) have fingerprint zero and are linked
    like any other. Texts of fewer words than a shingle are one shingle. Repeated rows and ids
    give a row each. Null ids get a row; their component is that of their fingerprint, null
    where no other document is in it. No rows give no rows; further columns are ignored.
    """
    by_doc, components = _linked(docs, id_col, text_col, words, threshold, similarity, set_words)
    first = by_doc.df.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    named = first.join(components, first["fp"] == components["node"], "left").select("fp", "first_id", "copies", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = staged(named.join(least, "component").select("fp", "copies", "component_id"), "answer")
    return salted_join(by_doc.df, answer, "fp", "copies", by_doc.df.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, set_words: int = 5) -> DataFrame:
    """One row of ``docs``, all columns, of each group that ``near_duplicates`` finds with a ``similarity``.

    The row of the smallest id stays; of rows that share it the one whose text has the smallest
    digest, of repeated rows any one. A group of null ids alone keeps one row. Columns
    may have any names. No rows give no rows.
    """
    by_doc, components = _linked(docs, id_col, text_col, words, threshold, similarity, set_words)
    # nulls are the smallest in Spark's order of structs, so a flag puts them last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = by_doc.df.groupBy("fp").agg(F.min(order).alias("one"))
    named = first.join(components, first["fp"] == components["node"], "left").select("one", F.coalesce("component", "fp").alias("component"))
    kept = named.groupBy("component").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("_id"), F.col("one.digest").alias("_text"))
    repeated = by_doc.df.groupBy("doc_id", "digest").agg(F.count("*").alias("_copies")).where("_copies > 1")
    kept = kept.join(repeated, kept["_id"].eqNullSafe(repeated["doc_id"]) & (kept["_text"] == repeated["digest"]), "left").select("_id", "_text", F.coalesce("_copies", F.lit(1)).alias("_copies"))
    kept = staged(kept, "kept")
    by_doc.drop()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest"))
    found = rows.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_text")))
    if not kept.where("_copies > 1").isEmpty():
        found = found.where("_copies = 1").unionByName(found.where("_copies > 1").dropDuplicates(["_id", "_text"]))
    return found.select("row.*")
