import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quaylog.llm import resemblance, secrets, simhash, spaced_seeds, tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).persist()
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(got) <= set(kept)
        gone = set(kept) - set(got)
        if name == "toxicity":
            scores = toxicity.label_and_score(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert gone == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        elif name == "simhash":
            assert gone == {r["doc_id"] for r in simhash.near_duplicates(before, similarity=0.8).where("doc_id <> component_id").collect()}
        elif name == "decontamination":
            assert gone == {r["doc_id"] for r in spaced_seeds.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            assert not gone
        kept = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


#: Names that the operators use inside, as further columns of the documents.
CLASHING = "row digest _id _text _copies fp component node k0 band before in_all bucket stratum shuffle_key due place length start seed doc item toxic spans".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]


def brute_contaminated(text, items):
    """Whether a text holds an item: all places of all alignments, by counting equal words."""
    words = spaced_seeds.word_hashes(text).tolist()
    for item in items:
        need = min(spaced_seeds.MIN_WORDS, len(item))
        for shift in range(-len(item) + 1, len(words)):
            same = [words[p] == item[p - shift] for p in range(max(0, shift), min(len(words), len(item) + shift))]
            for a in range(len(same) - need + 1):
                equal = sum(same[a : a + need])
                for b in range(a + need, len(same) + 1):
                    if 5 * equal >= 4 * (b - a) and equal >= 5 and need >= 5:
                        return True
                    equal += same[b] if b < len(same) else 0
    return False


def brute_groups(rows):
    """The row that stays of each group, by comparing all pairs."""
    fps = [simhash.fingerprint_of(t) for _, t in rows]
    sets = [frozenset(resemblance.shingle_set(t).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for x, (i, t) in enumerate(rows):
        groups.setdefault(root(x), []).append((i is None, i or 0, t))
    return groups.values()


@pytest.fixture
def awkward(spark, tmp_path):
    """A folder of tables with nulls, ties, repeats, long texts and clashing columns, and its documents' rows."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("l", "n", "ro", "st", "mi")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(i, prose(rng.choice([6, 14, 30]))) for i in range(8)] + [(8, None), (8, ""), (None, prose(20)), (9, prose(3))]
    rows = []
    for i in range(90):
        abuse = " you grubvark and vilesnout " if i % 3 == 0 else " "
        rows.append((i, prose(rng.randrange(15, 60)) + abuse + prose(20)))
    for i in range(90, 110):
        rows.append((i, prose(30) + " " + items[i % 8][1] + " " + prose(10)))
    for i in range(110, 130):
        kept = rows[rng.randrange(90)][1].split()
        kept[rng.randrange(len(kept))] = "changed"
        rows.append((i, " ".join(kept)))
    key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(44))
    rows += [(130, f"{prose(20)} password = hunter2hunter2 {prose(9)} {key} é"), (131, f"AKIA{'A1B2' * 4} {prose(12)} {'0123456789abcdef' * 2}")]
    rows += [(None, prose(30)), (None, prose(30)), (None, "you grubvark vilesnout " + prose(20)), (None, prose(10) + " " + items[1][1]), (3, prose(25)), (3, prose(25)), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(140, None), (141, ""), (142, " \t\n"), (None, None), (143, "x"), (144, prose(40_000)), (145, "word " * 9000), (146, "q" * 50_000), (147, "\u4e2d\u6587 <|endoftext|> \U0001f600")]
    full = [(i, t, None if k % 4 == 0 else "en", [None, "", "hot", "hot", "rare"][k % 5], None if t is None or k % 7 == 0 else len(t), *(None if (k + j) % 3 == 0 else f"c{j}" for j in range(len(CLASHING)))) for k, (i, t) in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING)
    spark.createDataFrame(full, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (500, 0, 1), (100, 1, None), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), full, items


def test_awkward_documents_against_plain_versions(spark, awkward):
    sf_dir, rows, items = awkward
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, frame):
        out = stages[name](spark, frame, sf_dir).persist()
        assert out.columns == COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        return out, [tuple(r) for r in out.collect()]

    # toxicity: each row by its text, with the lexicon that is learned from the labels that aren't held out
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    matcher = toxicity.Matcher(lexicon)
    clean, got = after("toxicity", docs)
    assert Counter(got) == Counter(r for r in rows if matcher.score(r[1]) < 0.7)
    abusive = [r for r in rows if "grubvark" in (r[1] or "")]
    assert abusive and not set(abusive) & set(got) and len(got) == len(rows) - len(abusive)

    # near copies: one row of each group, that of the smallest id
    kept, single = after("simhash", clean)
    groups = brute_groups([r[:2] for r in got])
    assert len(single) == len(groups) and set(single) <= set(got)
    chosen = {(r[0] is None, r[0] or 0, r[1]) for r in single}
    for group in groups:
        mine = [x for x in chosen if x in group]
        assert len(mine) == 1 and mine[0][:2] == min(x[:2] for x in group)

    # benchmark: whole items and long parts of them, by all alignments
    pure, left = after("decontamination", kept)
    plain = [w for _, t in items if len(w := spaced_seeds.word_hashes(t).tolist()) >= 5]
    short = [r for r in single if len((r[1] or "").split()) < 500]
    assert Counter(r for r in left if r in short) == Counter(r for r in short if not brute_contaminated(r[1], plain))
    assert {r[0] for r in single} - {r[0] for r in left} >= set(range(90, 110)) & {r[0] for r in single}

    # secrets: the same rows, masked by spans of the scan
    masked, redacted = after("secrets", pure)
    tokens_of = secrets._tokens_of(None)
    want = []
    for r in left:
        text = r[1]
        if text is not None:
            base = secrets.base_spans(text)
            gone = {p for _, a, b in base + secrets.random_spans(text, tokens_of, base) for p in range(a, b)}
            text = "".join("\0" if p in gone else c for p, c in enumerate(r[1]))
            while "\0\0" in text:
                text = text.replace("\0\0", "\0")
            text = text.replace("\0", "[secret]")
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    assert Counter(redacted) == Counter(want)
    assert sum("[secret]" in (r[1] or "") for r in redacted) >= 2

    # packing: each row's ids in gapless pieces, each place of the sequences once
    packed = corpus_pipeline.STAGES[-1][1](spark, masked, sf_dir).collect()
    exact = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    ids = [(r[0], [*exact.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in redacted]
    places = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in packed)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert sum(r["length"] for r in packed) == sum(len(x) for _, x in ids)
    have = Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    for doc_id, x in ids:
        for start, length in corpus_pipeline.packing.cuts(len(x)):
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[start : start + length]))
            have[doc_id, len(x), start, length, crc] -= 1
    assert not +have and min(have.values()) == 0


def test_run_is_its_stages_one_after_the_other(spark, awkward):
    sf_dir, rows, _ = awkward
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(docs.select(columns).collect()) == Counter(corpus_pipeline.run(spark, sf_dir).select(columns).collect())


def test_tables_without_rows(spark, awkward, tmp_path):
    sf_dir, rows, _ = awkward
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, f"{tmp_path}/none").count() == len(rows)
    assert stages["decontamination"](spark, docs, f"{tmp_path}/none").count() == len(rows)
