"""K-means on whole numbers, with distances by counting bits of bit planes.

A vector of 64 whole components is kept as its bit planes: plane j is one 64-bit word that holds
bit j of every component, in two's complement. The product of two vectors is the sum over pairs
of planes of the number of bits that both have set, times the planes' weights: no rounding.
Tasks hold a batch of planes and the centroids; what leaves a task in a round is one row of sums
for each cluster that it met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stage

COMPONENTS = 64
CENTROIDS, ROUNDS, SCALE, SEED = 16, 3, 64, 1
#: With at most so many planes all distances fit 64 bits; beyond, Python's whole numbers are taken.
SAFE_PLANES = 28
BATCH = 4096


def usable(vector: Column) -> Column:
    """Exactly 64 components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == COMPONENTS) & ~bad, F.lit(False))


def planes_for(least: int, most: int) -> int:
    """Planes that hold the whole numbers from ``least`` to ``most``, the sign included."""
    return max((-1 - least).bit_length() if least < 0 else 0, most.bit_length() if most > 0 else 0) + 1


def packed(numbers, planes: int):
    """Rows x planes of 64-bit words, of rows of 64 whole numbers."""
    import numpy as np

    bits = (numbers[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def weights(planes: int) -> list[int]:
    """What a bit of each plane counts; the last plane is the sign."""
    return [1 << j for j in range(planes - 1)] + [-(1 << (planes - 1))]


def _whole(planes: int):
    import numpy as np

    return np.int64 if planes <= SAFE_PLANES else object


def _weighted(a, b):
    """Sum over pairs of planes, of words that broadcast against each other; planes are the last axis."""
    import numpy as np

    kind, total = _whole(max(a.shape[-1], b.shape[-1])), 0
    for i, u in enumerate(weights(a.shape[-1])):
        for j, v in enumerate(weights(b.shape[-1])):
            total = total + np.bitwise_count(a[..., i] & b[..., j]).astype(kind) * (u * v)
    return total


def products(a, b):
    """Products of every row of planes ``a`` with every row of ``b``."""
    return _weighted(a[:, None, :], b[None, :, :])


def nearest(a, centroids):
    """(cluster, squared distance) of each row of planes; ties go to the smaller number."""
    import numpy as np

    away = _weighted(a, a)[:, None] - 2 * products(a, centroids) + _weighted(centroids, centroids)[None, :]
    cluster = away.argmin(axis=1)
    return cluster, away[np.arange(len(a)), cluster]


def component_sums(a) -> list[int]:
    """Sum of each component over rows of planes, from the bits of each plane."""
    import numpy as np

    total = [0] * COMPONENTS
    for j, w in enumerate(weights(a.shape[1])):
        words = np.ascontiguousarray(a[:, j]).view(np.uint8).reshape(len(a), 8)
        ones = np.unpackbits(words, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total = [t + w * n for t, n in zip(total, ones.tolist(), strict=True)]
    return total


def _words(column):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(column), -1)


def _tally(points: DataFrame, centroids) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that isn't empty: its rows and the sums of its components."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rows: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                a = _words(batch.column(0).slice(at, BATCH))
                cluster = nearest(a, centroids)[0]
                for k in np.unique(cluster).tolist():
                    mine = a[cluster == k]
                    rows[k] = rows.get(k, 0) + len(mine)
                    sums[k] = [x + y for x, y in zip(sums.get(k, [0] * COMPONENTS), component_sums(mine), strict=True)]
        found = sorted(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([rows[k] for k in found], pa.int64()), pa.array([sums[k] for k in found], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = points.select("planes").mapInArrow(count, "cluster int, n long, sums array<long>")
    each = partial.select("cluster", "n", F.posexplode("sums").alias("component", "x"))
    whole = each.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in whole.orderBy("cluster", "component").collect():  # a row for each centroid and component
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["x"]))
    return out


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Kept are vectors of exactly 64 components, none null or non-finite; component x becomes the whole
    number floor(scale * x). The first centroids are the kept rows with the smallest SHA-256 of
    ``seed:id``, a null id being written as nothing; rows of one id are told apart by their planes,
    and a row that occurs twice can be two centroids, of which the smaller number takes the
    vectors. With fewer rows than ``centroids`` each is one. Repeated rows count and are
    returned as often as they occur. No kept row gives no rows. Further columns are ignored.
    Distances and their sums must fit 64 bits; an error says where they don't.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    numbers = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("numbers"))
    least, most = numbers.agg(F.min(F.array_min("numbers")), F.max(F.array_max("numbers"))).first()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if least is None:
        return spark.createDataFrame([], schema)
    count = planes_for(least, most)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, v = (c.slice(at, BATCH) for c in batch.columns)
                words = packed(v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), COMPONENTS), count)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(np.arange(0, words.size + 1, count, dtype=np.int32), np.ascontiguousarray(words).view(np.int64).ravel())], ["vec_id", "planes"])

    points = Stage(numbers.mapInArrow(pack, "vec_id long, planes array<long>"), "planes")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = points.df.select("planes", digest.alias("digest")).orderBy("digest", "planes").limit(centroids).collect()  # bounded by centroids

    import numpy as np

    def components(words) -> list[int]:
        return component_sums(words[None, :])

    def planes_of(whole: list[list[int]]):
        return packed(np.array(whole, np.int64), count)

    now = [components(np.array(r["planes"], np.int64).view(np.uint64)) for r in first]
    for _ in range(rounds):
        for k, (n, sums) in _tally(points.df, planes_of(now)).items():
            now[k] = [x // n for x in sums]
    final = planes_of(now)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, v = (c.slice(at, BATCH) for c in batch.columns)
                cluster, away = nearest(_words(v), final)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(away.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = Stage(points.df.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned").df
    points.drop()
    digests = [(k, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for k, x in enumerate(now)]
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    total = assigned.agg(F.sum("distance").alias("inertia"))
    return assigned.join(F.broadcast(inertia), "cluster").join(F.broadcast(total)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid, and one row


def _oracle() -> str:
    """The same in SQL, its rounds written out; rows are told apart by their number."""
    kept = f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS (SELECT r, unnest(range({COMPONENTS})) AS i, unnest(v) AS x FROM kept),
    first AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept),
    c0 AS (SELECT k, i, x FROM first JOIN x USING (r) WHERE k < {CENTROIDS})"""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT r, min_by(k, d * 100 + k) AS k, min(d) AS d FROM (SELECT x.r, c.k, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{n} c USING (i) GROUP BY ALL) GROUP BY r)")
        if n < ROUNDS:
            steps.append(f"s{n} AS (SELECT k, i, sum(x)::BIGINT AS t, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS (SELECT k, i, CASE WHEN n IS NULL THEN x ELSE t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END END AS x FROM c{n} LEFT JOIN s{n} USING (k, i))")
    sums = f"inertia AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY k), digests AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)"
    return f"WITH {', '.join([kept, *steps, sums])} SELECT vec_id, k::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS}) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN kept USING (r) JOIN inertia USING (k) JOIN digests USING (k)"


ORACLE = _oracle()
