"""Hard negatives, k-means by bit planes and the n-gram join, against plain versions on awkward tables."""

import hashlib
import math
import random

import duckdb
import pytest

from quaylog.llm import bit_planes, ngram_join, queries, secrets, str_tree

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>, n int, tile int, score double"


def vectors(rng, n, dims, spread=1.0):
    out = []
    for i in range(n):
        v = [rng.uniform(-spread, spread) for _ in range(dims)]
        out.append((i, rng.randrange(3), v, 0, 0, 0.0))
    return out


def awkward(rng, dims):
    rows = vectors(rng, 60, dims)
    rows += [rows[3], rows[3], rows[10], (100, rows[7][1], rows[7][2], 1, 2, 3.0)]  # repeated rows, an equal vector
    rows += [(200, None, rows[5][2], 0, 0, 0.0), (201, 1, None, 0, 0, 0.0), (202, 1, [None] * dims, 0, 0, 0.0), (203, 1, [float("nan")] * dims, 0, 0, 0.0), (204, 1, [float("inf")] * dims, 0, 0, 0.0)]
    rows += [(None, 1, rows[6][2], 0, 0, 0.0), (205, 1, [0.0] * dims, 0, 0, 0.0), (206, 2, [0.5] * (dims + 1), 0, 0, 0.0), (207, 1, [], 0, 0, 0.0), (205, 2, [1.0] * dims, 0, 0, 0.0)]
    return rows


def whole(v, scale):
    import numpy as np

    return [math.floor(scale * float(np.float32(x))) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, is_anchor):
    """Negatives of every anchor and positive by comparing all rows."""
    kept = [(r[0], r[1], whole(r[2], 256)) for r in rows if r[0] is not None and r[1] is not None and fine(r[2])]
    out = []
    for a, (own, label, q) in enumerate(kept):
        if not is_anchor(own):
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), i, other == label) for b, (i, other, v) in enumerate(kept) if b != a and len(v) == len(q)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for place, (p, positive, _) in enumerate([x for x in scored if x[2]][:5]):
            found = [(s, i) for s, i, same in scored if not same and 30 * p <= 100 * s <= 90 * p][:10]
            out += [(own, positive, rank + 1, i, p, s, place + 1) for rank, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("dims,tile,leaf", [(1, 4, 2), (3, 1 << 12, 256), (3, 7, 3), (8, 5, 2)])
def test_hard_negatives(spark, monkeypatch, dims, tile, leaf):
    monkeypatch.setattr(str_tree, "TILE", tile)
    monkeypatch.setattr(str_tree, "LEAF", leaf)
    monkeypatch.setattr(str_tree, "FANOUT", 3)
    monkeypatch.setattr(str_tree, "BOXES", 4)
    monkeypatch.setattr(str_tree, "ASKING", 6)
    rows = awkward(random.Random(dims), dims)
    df = spark.createDataFrame(rows, VECTORS)
    got = str_tree.hard_negatives(df, df["vec_id"] % 5 == 0)
    assert got.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 5 == 0)


def test_no_negatives_without_rows_or_anchors(spark):
    df = spark.createDataFrame(vectors(random.Random(1), 5, 2), VECTORS)
    assert str_tree.hard_negatives(df.where("false"), df["vec_id"] >= 0).count() == 0
    assert str_tree.hard_negatives(df, df["vec_id"] < 0).count() == 0


def test_boxes_bound_products():
    import numpy as np

    rng = np.random.default_rng(2)
    for scale in (5, 1 << 28, 1 << 40):
        v, q = rng.integers(-scale, scale, (40, 6)), rng.integers(-scale, scale, (9, 6))
        least, most = str_tree.intervals(q, v.min(axis=0)[None, :], v.max(axis=0)[None, :])
        exact = q.astype(object) @ v.T.astype(object)
        assert (str_tree.products(q, v) == exact).all() and (exact >= least).all() and (exact <= most).all()


def clustered(rows, k, rounds):
    """Lloyd's rounds on whole numbers, row by row."""
    kept = [(r[0], whole(r[1], 64)) for r in rows if r[1] is not None and len(r[1]) == 64 and fine(r[1])]
    count = bit_planes.planes_for(min((min(v) for _, v in kept), default=0), max((max(v) for _, v in kept), default=0))
    import numpy as np

    planes = lambda v: bit_planes.packed(np.array([v], np.int64), count)[0].view(np.int64).tolist()
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), planes(r[1])))[:k]
    centroids = [v for _, v in first]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda i: (away(v, centroids[i]), i)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for i in set(own):
            mine = [v for (_, v), c in zip(kept, own) if c == i]
            centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    distance = [away(v, centroids[c]) for (_, v), c in zip(kept, own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, sum(x for x, y in zip(distance, own) if y == c), sum(distance), digest[c]) for (i, _), c, d in zip(kept, own, distance))


@pytest.mark.parametrize("n,spread", [(0, 1.0), (5, 1.0), (70, 0.2), (60, 3000.0)])
def test_bit_plane_clusters(spark, n, spread):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(64)], 0, "x") for i in range(n)]
    if n > 5:
        rows += [rows[3], rows[3], (None, rows[4][1], 1, "y"), (None, rows[5][1], 1, "y"), (900, [0.0] * 64, 0, None), (901, [-1.0] * 64, 0, None), (2, [0.25] * 64, 0, None)]
    rows += [(902, [1.0] * 63, 0, None), (903, None, 0, None), (904, [None] + [0.0] * 63, 0, None), (905, [float("nan")] * 64, 0, None), (906, [float("-inf")] * 64, 0, None), (907, [], 0, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, distance string")
    got = bit_planes.clusters(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == clustered([r[:2] for r in rows], 16, 3)


def test_products_of_planes_are_exact():
    import numpy as np

    rng = np.random.default_rng(4)
    for most in (1, 2, 64, 1 << 20, 1 << 30):
        v = rng.integers(-most, most, (30, 64))
        planes = bit_planes.planes_for(int(v.min()), int(v.max()))
        a = bit_planes.packed(v, planes)
        exact = v.astype(object) @ v.T.astype(object)
        assert (bit_planes.products(a, a) == exact).all()
        assert bit_planes.component_sums(a) == v.sum(axis=0).tolist()
    assert [bit_planes.planes_for(a, b) for a, b in ((0, 0), (-1, 0), (0, 1), (-2, 1), (-3, 3), (5, 9))] == [1, 1, 2, 2, 3, 5]


def components(rows, words=5, percent=80):
    """Sets of texts of word n-grams, all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids: dict = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((doc, len(sets[i]), least[find(i)])) for i, (doc, _) in enumerate(rows))


def near_copies(rng, n):
    """Texts of several lengths with a common passage, edited copies of some, and odd ones."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split() or ["a"]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))) + (f" {passage}" if rng.random() < 0.5 else "")
        rows.append((i, text))
    odd = ["", None, "   ", "One Two", "one  two\n", "one two three four five", "é É Ä", " ", "x" * 5000, "a " * 3000, "A " * 2000]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [rows[0], rows[0], (None, rows[1][1]), (None, "alone in here"), (3, rows[2][1] + " and an end of its own")]
    return rows


@pytest.mark.parametrize("small,block,counters", [(64, 512, 1 << 21), (2, 3, 1 << 6), (3, 8, 1 << 10)])
def test_ngram_join(spark, small, block, counters):
    rows = near_copies(random.Random(block), 110)
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, sid long, key string, n int, h int")
    got = ngram_join.near_duplicates(df, small=small, block=block, counters=counters)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == components(rows)
    assert ngram_join.near_duplicates(df.where("false")).count() == 0
    assert sorted(str(tuple(r)) for r in ngram_join.near_duplicates(df.where("text IS NULL")).collect()) == ["(1001, 0, 1001)"]


def test_at_the_threshold(spark):
    base = [f"a{i}" for i in range(14)]  # 10 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(base[:-2])), (4, " ".join(base[:-3])), (9, " ".join([*base, "x", "y", "z"]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == components(rows)


def test_a_hot_group_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_ROWS", 5)
    monkeypatch.setattr(ngram_join, "HOT_KEYS", 3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"e{i}", *base[i % 50 :]])) for i in range(90)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4, block=10)
    assert sorted(str(tuple(r)) for r in got.collect()) == components(rows)


@pytest.mark.parametrize("name", ["op11_str_tree", "op12_bit_planes", "op13_ngram_join"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_runs_inside_base_spans_are_left_out_in_one_walk():
    import time

    rng = random.Random(11)
    for _ in range(400):
        text = " ".join(rng.choice(["secret=", "AKIA" + "A1" * 9, "ab12" * 9, "token: " + "xY9" * 8, "qZ8" * 9, "-", "word"]) + rng.choice(["", "x", "=Q7w" * 6]) for _ in range(12))
        taken = secrets.base_spans(text)
        all_runs = secrets.random_spans(text, lambda run: list(run), [])
        runs = {m.span() for m in secrets.RUN.finditer(text)}
        outside = [x for x in all_runs if not any(s < b and a < e for a, b in runs if a <= x[1] and x[2] <= b for _, s, e in taken)]
        assert secrets.random_spans(text, lambda run: list(run), taken) == outside
    text = "".join(f"secret={rng.getrandbits(128):032x}\n" for _ in range(100_000))
    began = time.perf_counter()
    assert secrets.random_spans(text, lambda run: list(run), secrets.base_spans(text)) == []
    assert len(text) > 3_900_000 and time.perf_counter() - began < 10
