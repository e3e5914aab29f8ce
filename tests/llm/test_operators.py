import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaylog.llm import html_text, packing, revisits, rp_forest, secrets, shards, simhash, spaced_seeds, suffixes, tokens, toxicity
from quaylog.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, before long, fp long, bucket string, stratum int"
CORNERS = [(0, None, None), (1, "", "a"), (2, " \t\n", "a"), (3, "x", None), (4, "word " * 3000, "b"), (5, "same text here", "a"), (6, "same text here", "a"), (6, "same text here", "a"), (None, "no id", "b")]


def corners(spark, rows=CORNERS):
    return spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# sharding


def test_shards_match_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, shards.stratified_shards(docs).collect())) == sorted(con.sql(shards.ORACLE).fetchall())


def test_shards_corners(spark):
    got = shards.stratified_shards(corners(spark), 4).collect()
    assert len(got) == len(CORNERS)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    assert next(r["size"] for r in got if r["doc_id"] == 0) == 8
    assert shards.stratified_shards(corners(spark, [])).count() == 0


def test_shards_hold_the_mixture(spark):
    rows = [(i, "t", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(4000)]
    df = corners(spark, rows)
    report = shards.mixture_report(df, shards.stratified_shards(df, 8)).collect()
    hot = [r["count"] for r in report if r["source"] == "hot"]
    assert max(hot) - min(hot) <= 8


# packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    want = collections.Counter()
    for t in texts:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((len(ids), s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cuts(len(ids)))
    assert collections.Counter((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or s == len(by) - 1


def test_packing(spark, docs):
    check_packing(packing.pack(docs).collect(), [r["text"] for r in docs.collect()])
    check_packing(packing.pack(corners(spark)).collect(), [r[1] for r in CORNERS])
    assert packing.pack(corners(spark, [])).count() == 0


def test_packing_follows_targets(spark):
    df = corners(spark, [(i, "some words of text " * 60, "a" if i % 2 else "b") for i in range(200)])
    rows = packing.pack(df, targets={"a": 0.75, "b": 0.25}).where("sequence_id < 10").groupBy("source").agg(F.sum("length").alias("n")).collect()
    n = {r["source"]: r["n"] for r in rows}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.75) < 0.02


def test_slots_do_not_overlap_at_any_mix(spark):
    rng = random.Random(2)
    df = corners(spark, [(i, "a " * rng.randrange(1, 200), "s") for i in range(300)])
    check_packing(packing.pack(df).collect(), [r["text"] for r in df.collect()])


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    encoder = tokens.WordEncoder(tokens.tokenizer_file("byte_bpe_50k.json"), tokens.tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    parts = ["a", "be", "Zu", " ", " ", "\n", "\t", "\xa0", "1", "23", ".", "!!", "'s", "é", "日本", "<|endoftext|>", "😀", "\x1c", "\r\n", "—"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_share_a_fingerprint_keep_their_ids():
    encoder = tokens.WordEncoder(tokens.tokenizer_file("byte_bpe_50k.json"), tokens.tokenizer_file("byte_bpe_50k.tiktoken"))
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    for texts in ([a, b], [b], [f"x {a} y", f"x {b} y", "z"], [f"{b} {a}"]):
        assert [x.tolist() for x in encoder.encode_all(texts)] == [encoder.whole(t).tolist() for t in texts]


def test_long_texts_are_encoded_in_parts():
    encoder = tokens.WordEncoder(tokens.tokenizer_file("byte_bpe_50k.json"), tokens.tokenizer_file("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    text = " ".join(rng.choice(["foo", "bär", "x  y", "\n z", "abc\t", "Wort" * 20, "日本語"]) for _ in range(200_000))
    assert len(encoder._pieces(text)) > 1
    assert encoder.encode_all(["a", text, ""])[1].tolist() == encoder.whole(text).tolist()


# SimHash


def brute_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(runs))


def brute_groups(values, threshold):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_simhash_corners_and_data(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    values = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(values, 4)
    want = {(i, f"{v:016x}", rows[g][0]) for (i, _), v, g in zip(rows, values, groups, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want
    got = simhash.near_duplicates(corners(spark)).collect()
    assert len(got) == len(CORNERS)
    assert {r["doc_id"] for r in got if r["fingerprint"] == "0" * 16} == {0, 1, 2}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert simhash.near_duplicates(corners(spark, [])).count() == 0


@pytest.mark.parametrize(("threshold", "block"), [(4, 4096), (4, 16), (7, 64)])
def test_links_keep_all_components(spark, threshold, block):
    rng = random.Random(threshold)
    values = set()
    for _ in range(25):
        c = rng.getrandbits(64)
        for _ in range(50):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), threshold, block)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    a, b = collections.defaultdict(set), collections.defaultdict(set)
    for v, g in zip(signed, brute_groups(values, threshold), strict=True):
        a[g].add(v)
        b[found.get(v, v)].add(v)
    assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_anchors_cover():
    for bits in (13, 21, 24):
        assert all(row[0].bit_count() <= 1 for row in simhash.anchor_masks(bits))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    assert {(r["node"], r["component"]) for r in connected_components(edges).collect()} == {(i, 0) for i in range(61)} | {(200, 200), (201, 200)}


# repeated strings


def brute_repeats(rows, window):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + window] for _, b in bodies for k in range(len(b) - window + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + window, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        gone = gone[: len(b)]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "chunk", "wide"), [(200, 4 << 20, False), (40, 5000, True), (9, 4000, False)])
def test_repeats(spark, docs, monkeypatch, window, chunk, wide):
    if wide:
        monkeypatch.setattr(suffixes, "WIDE_FROM", 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "a" * 500), (903, rows[3][1]), (904, rows[5][1][:700] + rows[9][1][100:900]), (904, "é" * 300), (None, "b" * 450)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, window)


def test_strings_that_meet_in_powers_of_two_are_no_repeats(spark):
    a = thue_morse(2048)
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, "c" + a[:2047])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 2048).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 2048)


def test_products_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (np.append(rng.integers(0, suffixes.PRIME, 500, dtype=np.uint64), [np.uint64(suffixes.PRIME - 1)]) for _ in range(2))
    assert suffixes._times(a, b).tolist() == [int(x) * int(y) % suffixes.PRIME for x, y in zip(a, b, strict=True)]


def test_repeats_in_a_text_beyond_a_chunk(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(150_000))
    rows = [(1, text), (2, text[70_000:70_900] + "x" * 150), (3, text[:199])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=10_000).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 200)


def test_repeats_of_nothing(spark):
    assert suffixes.remove_repeats(corners(spark, [])).count() == 0
    assert len(suffixes.remove_repeats(corners(spark)).collect()) == len(CORNERS)


def test_covers_have_every_difference():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# toxicity


def test_fold():
    assert toxicity.fold("1D10T pathét!c m0r0n $tupid $5") == " idiot pathetic moron stupid s "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(3)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[10] = rng.choice(["scumbag", "Gr0ssling", "vexoa", "vexou"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    df, marks = corners(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.label_and_score(df, marks).collect()}
    assert all(r["predicted"] == labels[i][1] for i, r in got.items())
    assert {r["held_out"] for r in got.values()} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    lexicon = toxicity.learn_lexicon(df, marks, exceptions=("scumbag cleaner",))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(corners(spark, [(1, "a scumbag", "s"), (2, "a scumbag cleaner", "s"), (3, "a ѕсumbаg", "s")]), lexicon).collect()}
    assert scores[1] == scores[3] > 0.7 > scores[2]


def test_matcher_against_plain_search():
    rng = random.Random(10)
    words = ["ab", "abc", "b", "ca", "bca", "c"]
    for _ in range(300):
        terms = {f" {rng.choice(words)}{rng.choice(words)}{rng.choice(['', ' '])}": rng.random() for _ in range(6)}
        spared = tuple(f" {rng.choice(words)}{rng.choice(words)} {rng.choice(words)} " for _ in range(3))
        spared = tuple(x for x in spared if x not in terms)
        folded = f" {' '.join(''.join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randrange(30)))} "
        places = lambda x: [i for i in range(len(folded)) if folded.startswith(x, i)]
        gaps = [(a, a + len(x)) for x in spared for a in places(x)]
        hit = {x for x in terms if any(not any(a <= i and i + len(x) <= b for a, b in gaps) for i in places(x))}
        want = sum(terms[x] for x in hit) / toxicity.length_norm(folded.count(" "))
        assert abs(toxicity.Matcher(toxicity.Lexicon(terms, spared)).raw_of(folded) - want) < 1e-9


def test_training_counts_against_plain_ones(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}q" for _ in range(200)) for _ in range(30)]
    line = "this licence line of ten words is in all texts here "
    rows = [(i, line + t, "s") for i, t in enumerate(base)] + [(100 + i, line + t + " end", "s") for i, t in enumerate(base[:10])] + [(5, line + base[5], "s"), (None, "no", "s"), (77, None, "s"), (78, "", "s")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in [*range(30), *range(100, 110), 200]] + [(77, 1, "x"), (78, 1, "x"), (None, 1, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    training = corners(spark, rows).select("doc_id", "text").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    table = toxicity._training_table(training).df
    # copies of one label are one text: of 30 texts ten have a near copy of the same label
    want = {(i % 2, toxicity.fold(line + t)) for i, t in enumerate(base)} | {(1, "  ")}
    got = [(r["toxic"], r["folded"]) for r in table.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r["word"]: (r["toxic"], r["clean"]) for r in toxicity._word_counts(table).collect()}
    for word in ("iicence", "wabq", *base[0].split()[:3]):
        plain = [sum(k == kind and word in f.split() for k, f in want) for kind in (1, 0)]
        assert counts.get(word, (0, 0)) == tuple(plain)


def test_toxicity_corners(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.label_and_score(corners(spark), labels).collect()
    assert len(got) == len(CORNERS) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.label_and_score(corners(spark, []), labels).count() == 0


# secrets


def test_secret_spans(spark):
    key, long_hex = "q8Zr2Lx0Vb7TnK4wYc9PdM1s", "0123456789abcdef" * 2
    text = f"é password: hunter2x token = short api_key=abcdefgh1 AKIAABCDEFGHIJKL {long_hex} id {key} 12345678901234567890123 https_path/some-words_here/and-more"
    rows = [(1, text, "s"), (2, None, "s"), (3, "password:secret:abcdefgh1", "s")]
    got = {r["doc_id"]: r for r in secrets.scan(corners(spark, rows)).collect()}
    a = got[1]
    assert (a["n_assign"], a["n_access"], a["n_hex"], a["n_random"]) == (2, 1, 1, 1)
    base = [("assign", text.index("password"), text.index(" token")), ("assign", text.index("api_key"), text.index(" AKIA")), ("access", text.index("AKIA"), text.index(" 0123")), ("hex", text.index(long_hex), text.index(" id"))]
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
    assert a["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert a["spans"] == f"{line},random:{text.index(key)}:{text.index(key) + len(key)}"
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["n_assign"] == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(corners(spark, rows)).collect()}
    assert key not in clean[1] and long_hex not in clean[1] and clean[1].startswith("é [secret] token = short") and clean[2] is None


def test_known_forms():
    assert secrets.known_form("123e4567-e89b-12d3-a456-426614174000", "")
    assert secrets.known_form("d41d8cd98f00b204e9800998ecf8427e", "") and secrets.known_form("Zm9vYmFyYmF6cXV4MTIzNDU2", "sha-256: ")


def test_chance_repeats_and_letters_hide_no_secret():
    encode = tokens.load_tiktoken(tokens.tokenizer_file("byte_bpe_50k.tiktoken")).encode_ordinary
    rng = random.Random(4)
    for signs, size in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 1000), ("ABCDEF0123456789", 48), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 32), ("ZYXWVUTSRQPONMLKJIHGFEDCBA", 64)):
        for _ in range(100):
            key = "".join(rng.choice(signs[:-2] if i in (0, size - 1) else signs) for i in range(size))
            key = f"{key[:7]}aaa{key[10:]}" if "a" in signs else f"{key[:7]}000{key[10:]}" if "0" in signs else key
            assert secrets.random_spans(f"key {key} end", encode, []) == [("random", 4, 4 + size)]
    for run in ("getUserNameFromDatabase", "Some-words_in_UPPER_and-lower", "Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1", "XMLHttpRequestEventTarget", "=" * 40, "0000000000000000000000x1"):
        assert secrets.random_spans(f"id {run} end", encode, []) == []


def test_base_spans_against_plain_patterns(spark):
    import re

    rng = random.Random(9)
    parts = ["password", "Secret", "API_KEY", "apikey", "token", "AKIA", ":", "=", " ", '"', "'", "\t", "abcdef01", "f" * 31, "g", "A" * 12, "é", ".", "x=", "ſecret", "toKen"]
    assign = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["f0" * 60_000, "password=" * 20_000, ("AKIA" + "Z" * 12) * 5000]
    for text in texts:
        want = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
        assert sorted(secrets.base_spans(text)) == sorted(want)
    key = "token=" + "q8Zr2Lx0Vb"
    rows = corners(spark, [(1, key, "s"), (1, key, "s"), (None, "x " * 500_000 + key, "s")])
    assert sorted((str(r["doc_id"]), r["n_assign"]) for r in secrets.scan(rows).collect()) == [("1", 1), ("1", 1), ("None", 1)]
    assert secrets.scan(rows.where("false")).count() == 0 and secrets.redact(rows.where("false")).count() == 0


# decontamination


def brute_overlaps(doc, item):
    """Whether any alignment holds an overlap of enough words, 0.8 of them equal."""
    need = min(12, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        same = [doc[i + shift] == w if 0 <= i + shift < len(doc) else None for i, w in enumerate(item)]
        for i in range(len(same)):
            for j in range(i + need, len(same) + 1):
                part = same[i:j]
                if None not in part and 5 * sum(part) >= 4 * len(part):
                    return True
    return False


def test_overlaps_against_all_alignments(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([6, 9, 14, 30])))) for i in range(12)]
    rows = []
    for n in range(160):
        body = [rng.choice(words) for _ in range(rng.randrange(25))]
        item = rng.choice(items)[1].split()
        a = rng.randrange(len(item))
        part = [w if rng.random() > 0.12 else "other" for w in item[a : a + rng.randrange(5, 30)]]
        at = rng.randrange(len(body) + 1)
        rows.append((n if n % 9 else None, " ".join(body[:at] + part + body[at:]), "s"))
    rows += [rows[3], rows[3], (7, None, "s"), (7, "", "s"), (8, "w1 " * 20_000, "s")]
    given = items + [items[2], (None, items[3][1]), (50, None), (51, "")]
    df, t = corners(spark, rows), spark.createDataFrame([(*x, "z") for x in given], "item_id long, text string, doc_id string")
    got = [collections.Counter(map(str, spaced_seeds.overlaps(df, t, broadcast_seeds=n).collect())) for n in (0, 10**6)]
    assert got[0] == got[1]
    found = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.overlaps(df, t).collect()}
    want, hit = 0, 0
    for i, text, _ in rows[:160]:
        for j, item in items:
            held = brute_overlaps(text.split(), item.split())
            want += held
            hit += held and (i, j) in found
            # a null id stands for several texts
            assert held or i is None or (i, j) not in found, (i, j)
    assert want > 15 and hit >= 0.95 * want
    kept = [sorted(map(str, spaced_seeds.without_items(df, t, broadcast_seeds=n).collect())) for n in (0, 10**6)]
    assert kept[0] == kept[1] and spaced_seeds.without_items(df, t).columns == df.columns
    bad = [text for _, text, _ in rows if any(brute_overlaps((text or "").split()[:100], x.split()) for _, x in items)]
    assert len(rows) - len(kept[0]) >= 0.9 * len(bad) and sum("None, 'text'" in k for k in kept[0]) == 0


def test_words_of_all_scripts():
    same = lambda a, b: spaced_seeds.word_hashes(a).tolist() == spaced_seeds.word_hashes(b).tolist()
    assert same("«Zwei – Wörter» don’t", "zwei wörter don t") and same("a\u00a0b…c", "A B C") and not same("º", "")
    assert same("日本語の文章。x", "日 本 語 の 文 章 x") and len(spaced_seeds.word_hashes("ภาษาไทย ab日c")) == 10
    for text in ("é", "日", "x日", "日x", "", " ", "。", "a。b"):
        assert len(spaced_seeds.word_hashes(text)) == len(text.replace("。", " ").replace("x日", "x 日").replace("日x", "日 x").split())


def test_overlaps(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    item = [rng.choice(words) for _ in range(40)]
    changed = list(item)
    for i in (7, 19, 33):
        changed[i] = "other"
    filler = lambda: [rng.choice(words) for _ in range(100)]
    rows = [(1, " ".join(filler() + item + filler()), "s"), (2, ", ".join(filler() + changed).upper(), "s"), (3, " ".join(filler()), "s"), (4, " ".join(filler() + item[:8]), "s"), (5, None, "s"), (6, "", "s")]
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short")], "item_id long, text string")
    df = corners(spark, rows)
    got = sorted(map(tuple, spaced_seeds.overlaps(df, items).collect()))
    assert got == [(1, 10, 40, 40, 100), (2, 10, 37, 40, 100)]
    assert sorted(map(tuple, spaced_seeds.overlaps(df, items, broadcast_seeds=0).collect())) == got
    assert spaced_seeds.overlaps(df, items.where("false")).count() == 0
    assert spaced_seeds.overlaps(corners(spark, []), items).count() == 0


@pytest.mark.parametrize(("size", "share"), [(8, 0.8), (10, 0.8), (12, 0.8), (16, 0.8), (20, 0.9)])
def test_changed_words_at_any_places(size, share):
    item = spaced_seeds.word_hashes(" ".join(f"w{i}" for i in range(size)))
    items = spaced_seeds.Items([(0, " ".join(f"w{i}" for i in range(size)))])
    need, hits = min(12, size), 0
    for n in range(size + 1):
        for places in itertools.combinations(range(size), n) if n <= 3 else ():
            doc = np.concatenate([spaced_seeds.word_hashes("before it"), item, spaced_seeds.word_hashes("after")])
            doc[[p + 2 for p in places]] = 7
            same = [p not in places for p in range(size)]
            longest = max((j - i for i in range(size) for j in range(i + 1, size + 1) if sum(same[i:j]) >= round(share * 100) * (j - i) / 100), default=0)
            shifts = sorted(s for _, s in items.alignments(doc))
            if not shifts:
                continue
            hits += 1
            found = spaced_seeds.verified(doc, item, shifts, 12, share)
            assert (found is not None) == (longest >= need), places
            if found:
                assert found[1] == longest and found[0] == sum(same[found[2] - 2 : found[2] - 2 + longest])
    assert hits > 8


def test_an_overlap_of_most_equal_words_does_not_hide_a_longer_one():
    item = spaced_seeds.word_hashes(" ".join(f"w{i}" for i in range(40)))
    doc = np.concatenate([item[:11], item[20:25], [np.uint64(7)], item[26:31], [np.uint64(8)]])
    assert spaced_seeds.verified(doc, item, [-9, 0], 12, 0.8)[1] >= 12


def test_overlaps_of_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df, items = corners(spark, [(None, text, "s"), (1, "x " + text, "s"), (2, "other", "s")]), spark.createDataFrame([(None, text), (5, text)], "item_id long, text string")
    got = [sorted(map(str, spaced_seeds.overlaps(df, items, broadcast_seeds=n).collect())) for n in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) == 4


# pages


def test_main_text():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies to improve your experience on this site and so on and on and on, always.</div>
    <div class="post-content"><h2>Title</h2><p>First long paragraph of the article with enough text to surge, it has more words than a menu.
    <p>Second &amp; short.<ul><li>One<li>Two</ul><p class="ad">Buy now!</p><p>Third with <a href="x">a link</a> and te<b>xt</b>.</p></div>
    <aside>Related</aside><div class="comments"><p>Great article, I really enjoyed reading all of this, thank you very much for the post!</p></div><footer>(c)</footer></body></html>"""
    want = "Title\nFirst long paragraph of the article with enough text to surge, it has more words than a menu.\nSecond & short.\nOne\nTwo\nThird with a link and text."
    assert html_text.main_text(page).removeprefix("Title\n") == want.removeprefix("Title\n")
    assert html_text.main_text("<nav>a</nav><article><h1>T &lt;x&gt;</h1><p> a\n b<script>x</script></p></article><p>out of it, though long enough to be a paragraph of text, and then some more words") == "T <x>\na b"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p><!-- x") == ""


@pytest.mark.parametrize("name", "noscript template iframe svg math object select button canvas audio video".split())
def test_left_out_elements_end(name):
    def body(x):
        return html_text.main_text(f"<html><head><title>T</title><body><article><p>One.</p>{x}<p>Two.</p></article>")

    assert body(f"<{name}>gone<b>too</b></{name}>") == body(f"<{name} a='>'>x<{name}>y</{name}>z</{name.upper()} >") == "One.\nTwo."
    assert body(f"<{name}/>") == body(f"<{name} a='b' />") == body(f"<{name}>") == body(f"<{name}-icon></{name}-icon>") == "One.\nTwo."
    assert body(f"<!-- <{name}> -->") == body(f"<img alt='<{name}>'>") == body(f"<{name}><p>In.</p><{name}>gone</{name}>").replace("In.\n", "") == "One.\nTwo."


def test_heads_and_plain_elements_end():
    assert html_text.main_text("<head><title>T</title><meta a=b><article>One.<title-bar></title-bar><header-x></header-x><p>Two.</article>") == "One.\nTwo."
    assert html_text.main_text("<head>no<title>T</title></head><body><article>One.<script/>two<script>if (a<b) '<svg>'</script> <style>p</style>three</article>") == "One. two three"
    assert html_text.main_text("<article><p>One.<script>var a = '<p>two'; </script-x> <p>three") == "One."


def test_marks_drop_no_article_text():
    article = "<article><h2 id='related-work'>Related work</h2><section id='social-history'><p id='search-results'>One.</p></section><section id=related><p>Two.</p></section><h3 id='comments'>Three</h3></article>"
    want = "Related work\nOne.\nTwo.\nThree"
    for mark in ("site no-sidebar", "has-footer", "sidebar", "overlay", "overflow-hidden", "social-history"):
        assert html_text.main_text(f"<body><div class='{mark}'>{article}</div></body>") == want
    assert html_text.main_text(f"<body><form id=f>{article}</form></body>") == want
    long = "A paragraph of a page without a declared article, with enough words to count as text of its own, and then some."
    assert html_text.main_text(f"<div class='page has-sidebar no-ads'><p data-id='search' aria-label='On search'>{long}</p></div>") == long
    assert html_text.main_text(f"<div class='cookie-notice'><p>{long}</p></div><div id='comment-12'><p>{long}</p></div><div class='sidebar__inner'><p>{long}</p></div>") == ""


def test_all_articles_but_comments_are_kept():
    page = "<main><p>One.</p></main><article><p>Two is the longest.</p><div class='ad'>Buy</div><section id='comments'>No</section></article><article>Three.</article>"
    other = "<article class='comment'>Four</article><div class='comment-list'><article>Five</article></div><aside><article>Six</article></aside><article class='promo'>Seven</article>"
    assert html_text.main_text(page + other) == "One.\nTwo is the longest.\nThree."


def test_boilerplate_in_an_article_is_left_out():
    for mark in ("sponsored-content", "related-post", "newsletter-entry", "main-menu", "post-navigation", "widget-text"):
        assert html_text.main_text(f"<article><p>One.</p><div class='{mark}'><p>Not of the article.</p></div><p>Two.</p></article>") == "One.\nTwo.", mark


def test_articles_that_do_not_surge():
    long = "A paragraph of the article, long enough to make the sums of its lines surge. " * 20
    page = f"<article><h1>T</h1><p>By A</p><p>Now</p><p>Tags</p><p>{long}</p><div class='ad'><p>a</p><p>b</p><p>c</p><p>d</p></div><p>End.</p></article>"
    assert html_text.main_text(page + "<article>More</article>") == f"T\nBy A\nNow\nTags\n{long.strip()}\nEnd."


def test_stretches_against_all_sums():
    rng = random.Random(6)
    for _ in range(2000):
        lengths = [rng.choice([0, 0, 0, 3, 20, 60]) for _ in range(rng.randrange(25))]
        sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
        for back in (False, True):
            want, i = [], 0
            while i < len(lengths):
                if lengths[i] and sums[i] >= 70:
                    begin = i
                    while back and begin and lengths[begin - 1]:
                        begin -= 1
                    while i < len(lengths) and sums[i]:
                        i += 1
                    want.append((begin, max(k for k in range(i) if lengths[k]) + 1))
                else:
                    i += 1
            assert html_text.stretches(lengths, 70, 3, back) == want, lengths


@pytest.mark.parametrize("part", ["<p a=\"x>", "<p a=\" '>", "<a", "<span></b>", "<b><div><i></b>", "<![CDATA[ <p>", "<article>x</article>", "<svg>", "&#x", "<!-", "<li>"])
def test_long_pages_take_time_in_proportion(part):
    import time

    page = part * (1_000_000 // len(part))
    html_text.main_text(page[:1000])
    at = time.process_time()
    html_text.main_text(page[: len(page) // 8])
    short = time.process_time() - at
    at = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - at < 25 * max(short, 0.05)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>é", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("", 0), ("é", 1)]
    assert html_text.extract(df.where("false")).count() == 0 and html_text.extract(df.unionAll(df)).count() == 4


def test_revisits_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = revisits.resolved_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(revisits.ORACLE).fetchall()))


def test_revisit_outcomes(spark):
    schema = "record_id long, kind string, url string, captured timestamp_ntz, status int, headers map<string,string>, payload_digest string, bucket long"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [
        (1, "response", "http://www.x.org/a/?b=2&a=1#f", at(0), 200, {"ETag": '"1"', "Content-Type": "t", "X": "old"}, "d1", 0), (2, "response", "https://x.org/a?a=1&b=2", at(30), 200, {"etag": '"2"'}, "d2", 0), (3, "response", "x.org/a?a=1&b=2", at(31), 404, None, "d3", 0),
        (10, "revisit", "https://X.org:443/a?a=1&b=2&utm_source=z", at(1), 304, {"etag": 'W/"1"', "x": "new", "Content-Type": "no"}, None, 0), (11, "revisit", "x.org/a?a=1&b=2", at(40), 304, {"ETag": '"1"'}, None, 0),
        (12, "revisit", "x.org/a?a=1&b=2", at(0), 304, None, None, 0), (13, "revisit", None, at(5), 304, None, None, 0), (14, "revisit", "x.org/a?a=1&b=2", at(29), 304, None, None, 0),
    ]
    got = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r["outcome"], r["matched_id"]) for i, r in got.items()} == {10: ("resolved", 1), 11: ("mismatch", None), 12: ("orphan", None), 13: ("orphan", None), 14: ("unchecked", 1)}
    assert got[10]["headers"] == {"etag": 'W/"1"', "content-type": "t", "x": "new"}


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    x[300:340] = x[7]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(1000, None, 1.0), (1050, [0.0] * 16, 1.0), (1100, [float("nan")] * 16, 1.0), (1150, [1.0] * 3, 1.0), (1200, [None] * 16, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = collections.defaultdict(list)
    for r in rp_forest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 50))
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(600), -s.round(12)))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[300]] == [7, 301, 302, 303, 304]
    assert 1150 not in got
    assert rp_forest.nearest(df.where("false"), F.lit(True)).count() == 0
    assert rp_forest.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_neighbours_at_any_scale_and_dimension(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, np.resize([1.0, 1e200, 1e-200, 1e300, 1e-300], 40), strict=True))]
    rows += [(100 + i, rng.standard_normal(3).tolist()) for i in range(4)] + [(1, base[2].tolist()), (None, base[3].tolist()), (200, [5e-324] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in rp_forest.nearest(df, F.col("vec_id") % 50 == 0, share=1.0).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    unit = rp_forest.unit(base)
    want = unit @ unit[0]
    want[1] = max(want[1], want[2])
    order = [i for i in np.argsort(-want, kind="stable").tolist() if i][:5]
    assert set(got) == {0, 100, 200} and set(got[100]) == {101, 102, 103}
    assert [i for i in got[0] if i < 40] and all(abs(got[0][i] - want[i]) < 1e-12 for i in order if i in got[0]) and len(set(order) & set(got[0])) >= 4
    assert all(-1 - 1e-12 <= s <= 1 + 1e-12 for x in got.values() for s in x.values())


def test_forest_finds_neighbours_of_clusters_in_few_leaves():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    x = rp_forest.unit(centres[rng.integers(0, 60, 4000)] + 0.15 * rng.standard_normal((4000, 32)))
    model = rp_forest.fitted(x, 16, 3)
    leaf, hit, seen = rp_forest.leaves(model, x), 0, 0
    for q in range(0, 4000, 100):
        scores = x @ x[q]
        scores[q] = -9
        near = np.argsort(-scores)[:5]
        mask = np.zeros(4000, bool)
        for t, n in rp_forest.search(model, x[q], 0.05):
            mask |= leaf[:, t] == n
        hit, seen = hit + mask[near].sum(), seen + mask.sum()
    assert hit >= 0.9 * 5 * 40 and seen < 0.06 * 4000 * 40
