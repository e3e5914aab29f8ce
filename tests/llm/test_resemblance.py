"""Links of the pipeline's near-duplicate stage against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylog.llm import resemblance, simhash

SF = "/root/testdata/sf0.001"


def _components(rows, similarity=0.8):
    """Smallest id reachable over links of fingerprints or of sets, by comparing all pairs."""
    ids = [i for i, _ in rows]
    fps = [simhash.fingerprint_of(t) for _, t in rows]
    sets = [frozenset(resemblance.shingle_set(t).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            alike = sets[a] and common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9
            if alike or (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for x, i in enumerate(ids):
        least[root(x)] = min(i, least.get(root(x), i))
    return {(i, least[root(x)]) for x, i in enumerate(ids)}


def _edited(text, share, rng):
    words = text.split()
    return " ".join(f"w{rng.random()}" if rng.random() < share else w for w in words)


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = [t for _, t in given if t and 60 < len(t.split()) < 600][:60]
    near = [_edited(t, share, rng) for t in long for share in (0.01, 0.02, 0.03, 0.05)]
    hub = [_edited(long[0], 0.02, rng) for _ in range(60)]
    small = ["a b c d e f g h i", "a b c d e f g h i j", "A b  c\td e f g h i", "b", "B", "", None, "  ", "x y x y x y x y", "y x y x y x y x y x"]
    return given + list(enumerate(near + hub + small, 1_000_000))


def test_components_of_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert got == _components(rows)
    alone = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sum(i != c for i, c in got) > sum(i != c for i, c in alone)


def test_crowded_cells_in_blocks(spark, rows):
    rows = [r for r in rows if r[0] >= 1_000_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    profiled = resemblance.profiles(docs, 4, 5).cache()
    none = spark.createDataFrame([], "a long, b long")
    whole, split, single = ({tuple(r) for r in resemblance.joined_components(docs, profiled, none, block=b).collect()} for b in (512, 7, 1))
    sizes = Counter(c for _, c in whole)
    assert whole == split == single and max(sizes.values()) > 14


def test_alike_against_all_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40):
        base = rng.integers(0, 10_000, 300).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(300) < rng.uniform(0, 0.2), rng.integers(0, 10_000, 300).astype(np.uint64), base)) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets]
        assert (resemblance.alike(sets, 0.8) == np.array(want)).all()


def test_forest_joins_what_links_join():
    linked = np.eye(6, dtype=bool)
    for a, b in ((0, 1), (1, 2), (3, 4)):
        linked[a, b] = linked[b, a] = True
    assert len(resemblance.forest(linked, np.arange(6))) == 3
    assert len(resemblance.forest(linked, np.array([7, 7, 8, 9, 9, 5]))) == 1


def test_repeated_null_and_empty(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, text, "z"), (None, None, None), (2, None, "k0")], "doc_id long, text string, k0 string")
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs, similarity=0.8).collect()))
    assert got == [(0, 1), (0, 2), (1, 1), (1, 1), (2, 2)]
    assert simhash.near_duplicates(docs.where("false"), similarity=0.8).count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, _edited(text, 0.015, rng)), (3, text[: len(text) // 2])], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    other = "quite another text of more than a few words in all"
    third = "nothing that the two before it say is said again here"
    rows = [(2, text, "a"), (1, text.upper(), "b"), (1, text.upper(), "b"), (1, other, "c"), (None, other, "d"), (None, third, "e"), (None, third, "f"), (3, None, "g"), (3, "", "h"), (3, "  ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("row", F.lit(1)).withColumn("_id", F.lit(2))
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], (r["text"] or "").strip()) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, text.upper()), (1, other), (None, third), (3, "")], key=str)
    assert simhash.representatives(docs.where("false")).count() == 0
    only = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert simhash.representatives(only).count() == 1
