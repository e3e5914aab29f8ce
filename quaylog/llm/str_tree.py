"""Hard negatives by best-first search of R-trees that are packed by sort-tile-recursive.

Rows are tiled once: Spark's range partitioner cuts them into slabs by their first component, each
slab is sorted by the second, and every run of up to ``TILE`` rows of it is a tile, written as one row
with its bounding box. A tile is the subtree of one task, whose nodes are packed in the same way, by
the widest component, down to leaves of ``LEAF`` rows. For an anchor, the box of a node gives an interval of
the inner product: component by component the least and the greatest product.

An anchor first asks its own tile; the worst of the rows found there is its floor. It is then held
against the boxes of all other tiles, block by block, and goes on to those that may hold a row inside its score window
and not below its floor. In a tile a queue takes nodes by their greatest product and stops at a node that is strictly
below the k-th row found. All products are of whole numbers and exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage, bounded_batches

TILE_BITS = 12
#: Rows of a tile, and numbers that it holds at most (fewer rows where vectors are long).
TILE, TILE_NUMBERS = 1 << TILE_BITS, 1 << 18
LEAF, FANOUT = 256, 16
#: Boxes and anchors that meet in one task when anchors are sent on.
BOXES, ASKING = 1024, 4096
NO_LIMIT = 1 << 62
PROBE = "pid long, tile long, d int, id long, label long, q binary, lows array<long>, highs array<long>, floors array<long>"
POSITIVES, NEGATIVES, SCALE, SHARE = 5, 10, 256, (30, 90)


def usable(vector: Column) -> Column:
    """Not null, no component null or non-finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def products(a, b):
    """Exact products of rows of whole numbers: in doubles where no sum can round, else in 64 bits, else in Python's numbers."""
    import numpy as np

    most = [int(max(x.max(), -int(x.min()))) if x.size else 0 for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if bound < 1 << 62 else a.astype(object) @ b.T.astype(object)


def intervals(q, low, high):
    """(least, greatest) product of each row of ``q`` with any vector inside each box."""
    import numpy as np

    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


class Tree:
    """An R-tree over rows of whole numbers, packed by sorting and cutting at the widest component."""

    def __init__(self, v):
        import numpy as np

        self.order, cuts, work = [], [0], [np.arange(len(v))]
        while work:
            at = work.pop()
            if len(at) <= LEAF:
                self.order.append(at)
                cuts.append(cuts[-1] + len(at))
                continue
            axis = np.argmax(v[at].max(axis=0) - v[at].min(axis=0)) if v.shape[1] else 0
            at = at[np.argsort(v[at, axis], kind="stable")] if v.shape[1] else at
            half = -(-len(at) // (2 * LEAF)) * LEAF
            work += [at[half:], at[:half]]
        self.order = np.concatenate(self.order)
        self.v, self.cuts = v[self.order], cuts
        starts = np.array(cuts[:-1])
        low, high = np.minimum.reduceat(self.v, starts, axis=0), np.maximum.reduceat(self.v, starts, axis=0)
        self.levels = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))

    def bounds(self, q) -> list[tuple[list, list]]:
        """For each level, the (least, greatest) product of each row of ``q`` with each node."""
        return [tuple(x.tolist() for x in intervals(q, low, high)) for low, high in self.levels]

    def search(self, bounds, row: int, scores, allowed, ids, low: int, high: int, k: int, floor: int) -> list[tuple[int, int]]:
        """The first ``k`` (score, id) of allowed rows with low <= score <= high, none below ``floor``: high scores first, then small ids.

        ``scores`` gives the products of a leaf's rows.
        """
        found: list[tuple[int, int]] = []  # a heap of (score, -id): its first is the worst
        if low > high:
            return found
        top, floor = len(self.levels) - 1, max(floor, low)
        queue = [(-bounds[top][1][row][0], top, 0)]
        while queue:
            most, level, node = heapq.heappop(queue)
            if -most < floor:
                break
            if bounds[level][0][row][node] > high:
                continue
            if level:
                for child in range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))):
                    reach = bounds[level - 1][1][row][child]
                    if reach >= floor and bounds[level - 1][0][row][child] <= high:
                        heapq.heappush(queue, (-reach, level - 1, child))
                continue
            a, s = self.cuts[node], scores(node)
            for i in ((s >= floor) & (s <= high) & allowed[a : a + len(s)]).nonzero()[0].tolist():
                x = (int(s[i]), -ids[a + i])
                if len(found) < k:
                    heapq.heappush(found, x)
                elif x > found[0]:
                    heapq.heapreplace(found, x)
            if len(found) == k:
                floor = max(floor, found[0][0])
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))


class Tile:
    """The rows of one written tile, and their tree."""

    def __init__(self, d: int, ids: bytes, labels: bytes, copies: bytes, v: bytes):
        import numpy as np

        own = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(v, np.int64).reshape(len(own), d)
        self.tree = Tree(self.rows)
        order = self.tree.order
        self.ids, self.labels, self.copies = own[order], np.frombuffer(labels, np.int64)[order], np.frombuffer(copies, np.int64)[order]
        self.listed = self.ids.tolist()

    def ask(self, q, ids: list[int], labels: list[int], windows: list[list[tuple[int, int, int]]], k: int, same: bool) -> list[list[list[tuple[int, int]]]]:
        """For each anchor and each of its (low, high, floor): the rows found, of its own label (itself left out) or of others."""
        import numpy as np

        bounds, out = self.tree.bounds(q), []
        for row, (own, label, asked) in enumerate(zip(ids, labels, windows, strict=True)):
            allowed = (self.labels == label) if same else (self.labels != label)
            if same:
                itself = np.flatnonzero((self.ids == own) & (self.copies == 1) & allowed)
                allowed[[i for i in itself.tolist() if (self.tree.v[i] == q[row]).all()]] = False
            kept: dict = {}

            def scores(node, row=row, kept=kept):
                if node not in kept:
                    kept[node] = products(self.tree.v[self.tree.cuts[node] : self.tree.cuts[node + 1]], q[row : row + 1])[:, 0]
                return kept[node]

            out.append([self.tree.search(bounds, row, scores, allowed, self.listed, low, high, k, floor) for low, high, floor in asked])
        return out


def _rows_of(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def _tiles(entries: DataFrame) -> Stage:
    """Entries(d, id, label, v, copy, asks, n) as tiles."""
    rows = entries.count()
    slabs = max(1, round((rows / TILE) ** 0.5))
    head = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0))
    slabbed = entries.repartitionByRange(slabs, "d", head(0), "id").sortWithinPartitions("d", head(1), "id", "label", "v", "copy").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        names = ["tile", "d", "low", "high", "ids", "labels", "copies", "asks", "counts", "v"]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 8]
        made = 0

        def tile(part: int, d: int) -> pa.RecordBatch:
            nonlocal made, held
            ids, labels, copies, asks, counts, v = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [(part << 20) + made, d, v.min(axis=0), v.max(axis=0), ids, labels, copies, asks, counts, v]
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, int) else np.ascontiguousarray(x, np.int64).tobytes()], k) for x, k in zip(row, kinds, strict=True)], names)

        now, part, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, ds = batch.column(7)[0].as_py(), batch.column(0).to_numpy()
            at = 0
            while at < len(ds):
                d = int(ds[at])
                room = max(1, min(TILE, TILE_NUMBERS // max(d, 1)))
                if held and (d != now or size >= room):
                    yield tile(part, now)
                    size = 0
                end = min(at + room - size, int(np.searchsorted(ds, d, "right")))
                cut = batch.slice(at, end - at)
                whole = [cut.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 4, 5, 6)]
                v = cut.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(end - at, d)
                held.append((*whole, v))
                now, size, at = d, size + end - at, end
        if held:
            yield tile(part, now)

    schema = "tile long, d int, low binary, high binary, ids binary, labels binary, copies binary, asks binary, counts binary, v binary"
    return Stage(slabbed.select("d", "id", "label", "v", "copy", "asks", "n", "part").mapInArrow(pack, schema), "tiles")


def _at_home(k: int):
    """The anchors of each tile, with the rows of their label that their own tile holds."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["pid", "tile", "d", "id", "label", "q", "n", "scores", "found"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for r in _rows_of(batches):
            asks, counts = np.frombuffer(r["asks"], np.int64), np.frombuffer(r["counts"], np.int64)
            at = np.flatnonzero(asks)
            if not len(at):
                continue
            tile = Tile(r["d"], r["ids"], r["labels"], r["copies"], r["v"])
            ids, labels, q = np.frombuffer(r["ids"], np.int64)[at].tolist(), np.frombuffer(r["labels"], np.int64)[at].tolist(), tile.rows[at]
            for i in range(0, len(at), 256):
                part = slice(i, i + 256)
                best = [x[0] for x in tile.ask(q[part], ids[part], labels[part], [[(-NO_LIMIT, NO_LIMIT, -NO_LIMIT)]] * len(ids[part]), k, True)]
                columns = [
                    [(r["tile"] << TILE_BITS) + int(j) for j in at[part]], [r["tile"]] * len(best), [r["d"]] * len(best), ids[part], labels[part], [x.tobytes() for x in q[part]], counts[at[part]].tolist(),
                    [[s for s, _ in b] for b in best], [[j for _, j in b] for b in best],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _sent_on(batches: Iterator) -> Iterator:
    """Of cells sorted with their boxes first: each anchor once for every tile, its own aside, that it has to ask."""
    import numpy as np
    import pyarrow as pa

    cell, boxes = None, {}
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            keys, asking = list(zip(*(rows.column(c).to_pylist() for c in (0, 1)), strict=True)), rows.column(2).to_pylist()
            places, tiles = [], []
            for key in dict.fromkeys(keys):
                mine = [j for j, x in enumerate(keys) if x == key]
                if key != cell:
                    cell, boxes = key, {}
                for j in (j for j in mine if not asking[j]):
                    r = rows.slice(j, 1).to_pylist()[0]
                    t = boxes.setdefault(r["d"], ([], [], []))
                    for x, y in zip(t, (r["tile"], np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64)), strict=True):
                        x.append(y)
                by_length: dict[int, list] = {}
                for j in (j for j in mine if asking[j]):
                    by_length.setdefault(rows.column(4)[j].as_py(), []).append(j)
                for d, at in by_length.items():
                    if d not in boxes:
                        continue
                    known = np.array(boxes[d][0])
                    part = rows.take(pa.array(at)).to_pylist()
                    least, most = intervals(np.stack([np.frombuffer(r["q"], np.int64) for r in part]), np.stack(boxes[d][1]), np.stack(boxes[d][2]))
                    for j, r, below, above in zip(at, part, least, most, strict=True):
                        reached = np.zeros(len(known), bool)
                        for low, high, floor in zip(r["lows"], r["highs"], r["floors"], strict=True):
                            reached |= (low <= high) & (above >= max(low, floor)) & (below <= high)
                        found = known[reached & (known != r["tile"])].tolist()
                        places += [j] * len(found)
                        tiles += found
            if places:
                taken = rows.take(pa.array(places))
                names = ["pid", "tile", "d", "id", "label", "q", "lows", "highs", "floors"]
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()) if c == "tile" else taken.column(c) for c in names], names)


def _answered(k: int, same: bool):
    """Of rows sorted by tile, its body first: what the anchors that ask it find there."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, tile, waiting = None, None, []

        def answers() -> pa.RecordBatch:
            nonlocal waiting
            q = np.stack([np.frombuffer(r["q"], np.int64) for r in waiting])
            windows = [list(zip(r["lows"], r["highs"], r["floors"], strict=True)) for r in waiting]
            found = tile.ask(q, [r["id"] for r in waiting], [r["label"] for r in waiting], windows, k, same)
            rows = [(r["pid"], w, s, i) for r, of in zip(waiting, found, strict=True) for w, best in enumerate(of) for s, i in best]
            waiting = []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["pid", "w", "score", "found"])

        for r in _rows_of(batches):
            if r["tile"] != now:
                if waiting:
                    yield answers()
                now, tile = r["tile"], None
            if not r["asking"]:
                tile = r
            else:
                if isinstance(tile, dict):
                    tile = Tile(tile["d"], tile["ids"], tile["labels"], tile["copies"], tile["v"])
                waiting.append(r)
                if len(waiting) == 256:
                    yield answers()
        if waiting:
            yield answers()

    return run


_BODY = ("ids", "labels", "copies", "v")


def _ask(tiles: DataFrame, probes: DataFrame, k: int, same: bool) -> DataFrame:
    """(pid, w, score, found): the first ``k`` rows that each probe finds in the tile it names, for each of its windows."""
    names = [x.split()[0] for x in PROBE.split(", ")]
    none = lambda schema, columns: [F.lit(None).cast(schema[c].dataType).alias(c) for c in columns]
    bodies = tiles.select(F.lit(0).alias("asking"), "tile", "d", *_BODY, *none(probes.schema, [c for c in names if c not in ("tile", "d")]))
    asking = probes.select(F.lit(1).alias("asking"), "tile", "d", *none(tiles.schema, _BODY), *[c for c in names if c not in ("tile", "d")])
    met = bodies.unionByName(asking).repartition("tile").sortWithinPartitions("tile", "asking")
    return met.mapInArrow(_answered(k, same), "pid long, w int, score long, found long")


def _route(tiles: DataFrame, probes: DataFrame, boxes: int, asking: int) -> DataFrame:
    """Probes for every tile beside their own that can hold what they ask for."""
    groups, blocks = max(1, -(-boxes // BOXES)), max(1, -(-asking // ASKING))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [x.split()[0] for x in PROBE.split(", ")]
    none = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in names if c not in ("tile", "d")]
    left = tiles.select(F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("g"), every(blocks).alias("b"), F.lit(0).alias("asking"), "tile", "d", "low", "high", *none)
    right = probes.select(every(groups).alias("g"), F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("b"), F.lit(1).alias("asking"), "tile", "d", F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high"), *[c for c in names if c not in ("tile", "d")])
    order = ["g", "b", "asking", "tile", "d", "low", "high", *[c for c in names if c not in ("tile", "d")]]
    return left.select(order).unionByName(right.select(order)).repartition("g", "b").sortWithinPartitions("g", "b", "asking").mapInArrow(_sent_on, PROBE)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("pid", "w").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, share: tuple[int, int] = SHARE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of every anchor and positive.

    Component x becomes the whole number floor(scale * x); a row's score is its inner product with the anchor, and rows of
    higher scores come first, then those of smaller ids. An anchor's positives are its first ``positives`` other rows of its label; a
    positive's negatives are the first ``negatives`` rows of other labels whose scores are from share[0] to share[1] hundredths
    of its own. A positive without such rows gives none; so does a negative score of a positive, whose bounds are crossed.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have no
    product, so they never meet. Repeated rows are rows of their own: a repeated anchor has its copies among its
    positives and is answered as often as it occurs. No rows or no anchors give no rows; further columns are ignored. Scores must
    fit 64 bits; an error says where they don't.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).cast("int").alias("asks"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    once = kept.groupBy("id", "label", "v").agg(F.max("asks").alias("asks"), F.count("*").alias("n"))
    # of a repeated row no more copies can be among the first than are asked for, itself aside
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(max(positives + 1, negatives)).cast("long"))))
    entries = Stage(once.withColumn("copy", copies).withColumn("asks", F.when(F.col("copy") == 1, F.col("asks")).otherwise(0)).withColumn("d", F.size("v")), "entries")
    tiles = _tiles(entries.df)
    entries.drop()

    home = Stage(tiles.df.mapInArrow(_at_home(positives), "pid long, tile long, d int, id long, label long, q binary, n long, scores array<long>, found array<long>"), "anchors")
    boxes, asking = tiles.df.count(), home.df.count()
    limit, no_floor = F.lit(NO_LIMIT).cast("long"), F.lit(-NO_LIMIT).cast("long")
    floor = F.when(F.size("scores") >= positives, F.array_min("scores")).otherwise(no_floor)
    probes = home.df.select("pid", "tile", "d", "id", "label", "q", F.array(no_floor).alias("lows"), F.array(limit).alias("highs"), F.array(floor).alias("floors"))
    known = home.df.select("pid", F.lit(0).alias("w"), F.explode(F.arrays_zip("scores", "found")).alias("x")).select("pid", "w", "x.scores", "x.found").toDF("pid", "w", "score", "found")
    chosen = Stage(_first(known.unionByName(_ask(tiles.df, _route(tiles.df, probes, boxes, asking), positives, True)), positives).select("pid", "rank", "score", "found"), "positives")

    whole = lambda n, up: F.expr(f"(score * {n} - pmod(score * {n}, 100)) div 100 + if({up} AND pmod(score * {n}, 100) > 0, 1, 0)")  # noqa: E731  rounded down or up
    low, high = whole(share[0], "true"), whole(share[1], "false")
    asked = chosen.df.select("pid", "rank", low.alias("low"), high.alias("high"))
    asked = asked.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("asked"))  # as many as positives
    windows = Stage(home.df.join(asked, "pid").select("pid", "tile", "d", "id", "label", "q", F.col("asked.low").alias("lows"), F.col("asked.high").alias("highs"), F.transform("asked", lambda _: no_floor).alias("floors")), "windows")
    near = Stage(_ask(tiles.df, windows.df, negatives, False), "near")
    worst = near.df.groupBy("pid", "w").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("floor")).where("floor IS NOT NULL")
    worst = worst.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("worst"))  # as many as positives
    raised = windows.df.join(worst, "pid", "left").withColumn("floors", F.transform("floors", lambda x, i: F.coalesce(F.try_element_at("worst", i), x))).drop("worst")
    far = _ask(tiles.df, _route(tiles.df, raised, boxes, asking), negatives, False)
    best = _first(near.df.unionByName(far), negatives).select("pid", (F.col("w") + 1).alias("positive_rank"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.df.select("pid", F.col("rank").alias("positive_rank"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = best.join(pairs, ["pid", "positive_rank"]).join(home.df.select("pid", F.col("id").alias("anchor_id"), "n"), "pid")
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    answer = Stage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"), "negatives").df
    for x in (tiles, home, chosen, windows, near):
        x.drop()
    return answer


ORACLE = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS (SELECT a.r AS a, b.r AS b, a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM kept a JOIN kept b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
  pos AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM scores WHERE same QUALIFY n <= {POSITIVES})
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, p.n::INTEGER AS positive_rank
   FROM pos p JOIN scores s ON s.a = p.a AND NOT s.same AND {SHARE[0]} * p.score <= 100 * s.score AND 100 * s.score <= {SHARE[1]} * p.score
   WINDOW w AS (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
