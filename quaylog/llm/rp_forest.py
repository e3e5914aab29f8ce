"""Nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample again and again at the median of a random projection (the
difference of two of its vectors). All rows are then indexed: every vector goes to one leaf
of each tree. A query descends all trees at once through one priority queue, ordered by the
largest margin by which a path has left the query's side, and takes leaves until they should
hold a number of rows that grows slower than the table. The candidates of those leaves are reranked
by exact cosine in double precision. Each of the commonest dimensions has a forest of its own.

Equal vectors are one entry with its smallest ids. A leaf with many vectors is split into
blocks that meet the leaf's queries in different tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage, staged

TREES = 16
#: Vectors of each dimension that trees are fitted on; the number of leaves is bounded by a part of it.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32 << 20
SAMPLE_LEAF = 20
#: Dimensions that have a forest, those of most vectors; vectors of rarer ones are compared with all of theirs.
FORESTS = 32
#: Rows that a query's leaves should hold: FACTOR * rows ** POWER, all of them where that is more.
#: Structureless data in 64 dimensions need so many for a recall of 0.95; clustered data far fewer.
SEARCH_FACTOR, SEARCH_POWER = 2.1, 0.86
BLOCK = 8192


def fitted(sample, trees: int, seed: int):
    """(normals, cuts) of trees as complete binary trees in arrays: node i has children 2i + 1 and 2i + 2."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    depth = max(0, min(12, int(np.log2(max(1, n / SAMPLE_LEAF)))))
    inner = 2**depth - 1
    normals, cuts = np.zeros((trees, inner, dims)), np.zeros((trees, inner))
    for t in range(trees):
        where = np.zeros(n, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(where == node)
            normal = rng.standard_normal(dims)
            if len(mine) > 1:
                a, b = sample[rng.choice(mine, 2, replace=False)]
                if (a != b).any():
                    normal = a - b
            normals[t, node] = normal / np.linalg.norm(normal)
            along = sample[mine] @ normals[t, node]
            cuts[t, node] = np.median(along) if len(mine) else 0.0
            where[mine] = 2 * node + 1 + (along > cuts[t, node])
    return normals, cuts


def leaves(model, unit):
    """Leaf of each unit vector in each tree: rows x trees."""
    import numpy as np

    normals, cuts = model
    inner = cuts.shape[1]
    out = np.zeros((len(unit), len(cuts)), np.int32)
    for t in range(len(cuts)):
        node = np.zeros(len(unit), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            side = np.einsum("ij,ij->i", unit, normals[t, node]) > cuts[t, node]
            node = 2 * node + 1 + side
        out[:, t] = node - inner
    return out


def search(model, unit, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs for one query, nearest first, until they should hold ``share`` of the rows."""
    normals, cuts = model
    inner = cuts.shape[1]
    margins = normals @ unit - cuts
    queue = [(0.0, t, 0) for t in range(len(cuts))]
    taken, found, missing = [0] * len(cuts), [], 1.0
    while queue and 1.0 - missing < share:
        cost, t, node = heapq.heappop(queue)
        while node < inner:
            m = margins[t, node]
            right = m > 0
            heapq.heappush(queue, (max(cost, abs(m)), t, 2 * node + (1 if right else 2)))
            node = 2 * node + (2 if right else 1)
        found.append((t, node - inner))
        missing *= (1 - (taken[t] + 1) / (inner + 1)) / (1 - taken[t] / (inner + 1))
        taken[t] += 1
    return found


def searched_share(rows: int, factor: float = SEARCH_FACTOR, power: float = SEARCH_POWER) -> float:
    return min(1.0, factor * max(rows, 1) ** (power - 1))


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column):
    """An Arrow list column of lists of one length as a matrix of doubles."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scaled(x):
    """Rows times the power of two that brings their largest component near 1: no square overflows or vanishes, no digit is lost."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x):
    import numpy as np

    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x, y):
    """Cosine of each row of ``x`` with that of ``y``, summed from the first component to the last: the same whatever rows come along."""
    import numpy as np

    def dots(a, b):
        return np.cumsum(a * b, axis=1)[:, -1]

    return dots(x, y) / (np.sqrt(dots(x, x)) * np.sqrt(dots(y, y)))


def by_dimension(column) -> Iterator[tuple[int, list[int]]]:
    """(dimension, places) of an Arrow list column."""
    at: dict[int, list[int]] = {}
    for i, n in enumerate(column.value_lengths().to_pylist()):
        at.setdefault(n, []).append(i)
    yield from at.items()


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, share: float | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, nearest first.

    ``score`` is the cosine of the original vectors in double precision; ties go to the smaller
    id. A query's own id is no candidate; with fewer candidates than ``k`` all that are found
    are returned. ``share`` is that of all rows which a query's leaves should hold (by default it
    falls with their number). Vectors that are null, zero, or hold null or non-finite components take no
    part. Vectors of different dimensions are never near each other. An id with several vectors
    asks with each, and is as near as its nearest. Null ids take no part. No rows give no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    rows = staged(rows, "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = staged(entries, "entries")

    import numpy as np

    models, shares = {}, {}
    for at, (d, n) in enumerate(entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()):
        sample = np.zeros((0, d))
        if at < FORESTS:
            most = min(sample_rows, max(2, SAMPLE_BYTES // (8 * d)))  # what comes to the driver is bounded in rows and bytes
            chosen = entries.where(F.size("v") == d).orderBy(F.xxhash64("v"), "ids").limit(most).select("v").toArrow()
            sample = unit(_matrix(chosen.column(0).combine_chunks()))
        models[d] = fitted(sample, trees, seed)
        shares[d] = searched_share(n) if share is None else share
    model = spark.sparkContext.broadcast((models, shares))  # of each of FORESTS dimensions trees x leaves x dimensions, bounded by the sample

    def index(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, at in by_dimension(batch.column(1)):
                ids, v = (c.take(pa.array(at, pa.int64())) for c in batch.columns)
                leaf = leaves(model.value[0][d], unit(_matrix(v)))
                yield pa.RecordBatch.from_arrays([ids, v, pa.ListArray.from_arrays(np.arange(0, leaf.size + 1, trees, dtype=np.int32), leaf.ravel())], ["ids", "v", "leaves"])

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for d, places in by_dimension(batch.column(1)):
                ids, v = (c.take(pa.array(places, pa.int64())) for c in batch.columns)
                found = [search(model.value[0][d], q, model.value[1][d]) for q in unit(_matrix(v))]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), v.take(at), pa.array([t for f in found for t, _ in f], pa.int32()), pa.array([n for f in found for _, n in f], pa.int32())], ["ids", "v", "tree", "leaf"])

    indexed = Stage(entries.select("ids", "v").mapInArrow(index, "ids array<long>, v array<double>, leaves array<int>"), "indexed").df
    points = indexed.select("ids", "v", F.posexplode("leaves").alias("tree", "leaf")).withColumn("d", F.size("v"))
    queries = rows.where("asks").select(F.array("vec_id").alias("ids"), "v").mapInArrow(probe, "ids array<long>, v array<double>, tree int, leaf int").withColumn("d", F.size("v"))
    crowded = points.groupBy("d", "tree", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    crowded = F.broadcast(staged(crowded, "crowded"))  # leaves of the models at most
    blocks = F.coalesce("blocks", F.lit(1))
    names = ["d", "tree", "leaf", "block", "asks", "ids", "v"]
    points = points.join(crowded, ["d", "tree", "leaf"], "left").withColumn("block", F.pmod(F.xxhash64("ids"), blocks).cast("int")).withColumn("asks", F.lit(0))
    queries = queries.join(crowded, ["d", "tree", "leaf"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("asks", F.lit(1))
    cells = points.select(*names).unionByName(queries.select(*names)).repartition("d", "tree", "leaf", "block").sortWithinPartitions("d", "tree", "leaf", "block", "asks", "ids")

    def rerank(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def meet(ids: list, point, size, asked: list, v) -> pa.RecordBatch:
            # matrix products round by the shape of the block: they only choose what is scored by ``cosines``
            x = scaled(v)
            rough = (x @ point.T) / (np.linalg.norm(x, axis=1)[:, None] * size)
            best = np.argpartition(-rough, min(k + 1, len(ids) - 1), axis=1)[:, : k + 1]
            limit = np.take_along_axis(rough, best, 1).min(axis=1) - 8 * x.shape[1] * np.finfo(float).eps
            rows, near = np.nonzero(rough >= limit[:, None])
            scored: list[list] = [[] for _ in asked]
            for row, j, score in zip(rows.tolist(), near.tolist(), cosines(x[rows], point[near]).tolist(), strict=True):
                scored[row] += [(-score, i) for i in ids[j] if i != asked[row][0]]
            out = [(own, i, -s) for (own,), found in zip(asked, scored, strict=True) for s, i in sorted(found)[:k]]
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        # a cell's points come before its queries, which then pass by one batch after another
        cell, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if tuple(keys[a, :4]) != cell:
                    cell, held, ready = tuple(keys[a, :4]), [], None
                part = batch.slice(a, b - a)
                ids, v = part.column(5).to_pylist(), _matrix(part.column(6))
                if not keys[a, 4]:
                    held.append((ids, scaled(v)))
                elif held:
                    if ready is None:
                        point = np.concatenate([x for _, x in held])
                        ready = [i for x, _ in held for i in x], point, np.linalg.norm(point, axis=1)
                    for at in range(0, len(ids), 256):
                        yield meet(*ready, ids[at : at + 256], v[at : at + 256])

    found = cells.select(*names).mapInArrow(rerank, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
