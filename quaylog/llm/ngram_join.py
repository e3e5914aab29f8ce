"""Documents whose sets of word n-grams have a Jaccard similarity of a threshold or more, exactly.

The sets are the rows of a sparse matrix of documents by n-grams; two documents link when their
rows' product, the overlap, is large enough for their sizes. Only blocks of that product that can hold a link are made:

* N-grams have one order, from rare to common, by counters over all documents (a fixed number of them, so
  that some n-grams share one: any order is right, a good one is only faster). Of n n-grams the first
  n - ceil(n * threshold) + 1 form the prefix, and rows that link share an n-gram of their prefixes. So the
  columns of the prefixes are the cells in which rows meet.
* First every row of a cell is multiplied with the cell's first row, unless their sizes alone rule a link out. That
  joins most of any group of copies with one product for each.
* What a cell then still holds of different components is compared whole: pair by pair in small cells, by blocks of rows
  in large ones, where rows outside the largest component meet each other and that component. Pairs that are joined already
  need no product, so no group gives all its pairs.

A product is accumulated from the n-grams that two rows share; sets travel once for each block that they meet. A set goes by
the 64 bits of one of its texts where rows meet (texts that share them only meet once more), and by 128 of its own where they link.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hot_keys import HOT_KEYS, LEAST_ROWS, salted_join
from .resemblance import BLOCK, alike, forest, last_meetings
from .staging import Buckets, Stage, bounded_batches, release

WORDS, PERCENT = 5, 80
#: Counters of each of two rows, and counters that travel together.
COUNTERS, CHUNK = 1 << 21, 1 << 16
#: Rows of a cell up to which its pairs are listed.
SMALL = 64
#: Hashes that a task gathers before it counts or sends them.
GATHERED = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def ngrams(text: str | None, words: int = WORDS):
    """The distinct hashes of a text's word n-grams, sorted; of fewer words that of all of them; none without words."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), len(tokens))], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    out = np.zeros(len(tokens) - words + 1, np.uint64)
    for i in range(words):
        out = (out ^ each[i : i + len(out)]) * np.uint64(_MIX[i % len(_MIX)])
        out ^= out >> np.uint64(29 + i % 3)
    return np.unique(out)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def sizes_fit(a, b, percent: int = PERCENT):
    """Whether sets of these sizes can link at all."""
    import numpy as np

    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _slots(hashes, counters: int):
    """Each hash's counter in both rows."""
    import numpy as np

    bits = counters.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes & np.uint64(counters - 1)).astype(np.int64)


def count_ngrams(docs: DataFrame, words: int, counters: int = COUNTERS):
    """Two rows of counters over the n-grams of all documents; of a size that doesn't depend on them."""
    import numpy as np

    chunk = min(CHUNK, counters)

    def count(batches: Iterator) -> Iterator:
        import numpy as np

        total, held, size = np.zeros((2, counters), np.int64), [], 0

        def add():
            nonlocal held, size
            for row, slots in enumerate(_slots(np.concatenate(held), counters)):
                total[row] += np.bincount(slots, minlength=counters)
            held, size = [], 0

        for batch in batches:
            for t in batch.column(0):
                held.append(ngrams(t.as_py(), words))
                size += len(held[-1])
                if size > GATHERED:
                    add()
        if held:
            add()
        parts = total.reshape(-1, chunk)
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        for i in some:
            yield sent(i, parts[i])

    def sent(i: int, counts):
        """A row of counters, in as many bytes each as the largest needs, four at most."""
        import numpy as np
        import pyarrow as pa

        counts = np.minimum(counts, (1 << 32) - 1)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32) if counts.max() <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts.astype(kind).tobytes()], pa.binary())], ["chunk", "counts"])

    def received(counts: bytes):
        import numpy as np

        return np.frombuffer(counts, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(counts) // chunk]).astype(np.int64)

    def add_up(batches: Iterator) -> Iterator:
        totals: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                at, own = batch.column(0)[i].as_py(), received(batch.column(1)[i].as_py())
                totals[at] = totals[at] + own if at in totals else own
        for at, sums in totals.items():
            yield sent(at, sums)

    schema = "chunk int, counts binary"
    out = np.zeros((2 * counters // chunk, chunk), np.uint32)
    for r in docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add_up, schema).collect():  # all counters together, 16 MB
        out[r["chunk"]] = received(r["counts"])
    return out.reshape(2, counters)


def _profiles(docs: DataFrame, model, words: int, percent: int) -> DataFrame:
    """Of docs(doc_id, h, text): doc_id, h, key (128 bits of the set), n, and the prefix, rare n-grams first; null without words."""

    def compute(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        counts = model.value
        for batch in batches:
            rows = []
            for t in batch.column(2):
                found = ngrams(t.as_py(), words)
                if not len(found):
                    rows.append((None,) * 3)
                    continue
                key = xxhash.xxh3_128_digest(found.tobytes())
                a, b = _slots(found, counts.shape[1])
                order = np.lexsort((found, np.minimum(counts[0][a], counts[1][b])))[: prefix_length(len(found), percent)]
                rows.append((key, len(found), found[order].view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "h", "key", "n", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "h", "text").mapInArrow(compute, f"doc_id {kind}, h long, key binary, n long, prefix array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(sid, key, hashes) of every text with words, of docs(sid, text)."""

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        def out(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for _, x in held], pa.binary()), pa.array([x for _, x in held], pa.binary())], ["sid", "key", "hashes"])

        held, size = [], 0
        for batch in batches:
            for sid, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(found := ngrams(t.as_py(), words)):
                    held.append((sid, found.tobytes()))
                    size += len(found)
                if size > GATHERED // 2:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select("sid", "text").mapInArrow(compute, "sid long, key binary, hashes binary")


def overlaps(row, others: list):
    """Product of one row with each of others: how many n-grams they share; all sorted."""
    import numpy as np

    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(row, joined), len(row) - 1)
    starts = np.cumsum([0] + [len(x) for x in others[:-1]])
    return np.add.reduceat((row[at] == joined).astype(np.int64), starts)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the keys of those pairs(a, b) of sids that link. A row's partners are dealt to several tasks where they are very many."""
    counts = Stage(pairs.groupBy("a").agg(F.count("*").alias("c")), "partners")
    total = counts.df.agg(F.sum("c")).first()[0] or 0
    most = max(LEAST_ROWS, total // HOT_KEYS)
    hot = F.broadcast(counts.df.where(F.col("c") > most).select("a", F.ceil(F.col("c") / F.lit(most)).cast("int").alias("parts")))  # at most HOT_KEYS rows
    dealt = Stage(pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("block")), "dealt")
    rows = dealt.df.select("a", "block").distinct().join(sets.withColumnRenamed("sid", "a"), "a").withColumn("partner", F.lit(0))
    partners = dealt.df.join(sets.withColumnRenamed("sid", "b"), "b").drop("b").withColumn("partner", F.lit(1))
    names = ["a", "block", "partner", "key", "hashes"]
    met = rows.select(names).unionByName(partners.select(names)).repartition("a", "block").sortWithinPartitions("a", "block", "partner")

    def multiply(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, held = None, []
        for batch in batches:
            cells = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            keys, hashes, found, at = batch.column(3).to_pylist(), batch.column(4), [], 0
            while at < len(cells):
                end = at
                while end < len(cells) and cells[end] == cells[at]:
                    end += 1
                own = [np.frombuffer(hashes[i].as_py(), np.uint64) for i in range(at, end)]
                if cells[at][:2] != now:
                    now, held = cells[at][:2], []
                if not cells[at][2]:
                    held += zip(keys[at:end], own, strict=True)
                else:
                    size = np.array([len(x) for x in own])
                    for key, row in held:
                        common = overlaps(row, own)
                        links = 100 * common >= percent * (len(row) + size - common)
                        found += [(key, keys[at + i]) for i in np.flatnonzero(links).tolist() if keys[at + i] != key]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    links = Stage(met.mapInArrow(multiply, "a binary, b binary"), "links")
    counts.drop()
    dealt.drop()
    return links.df


def _listed(percent: int):
    """Of small cells, sorted: pairs of different components whose sizes fit."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen: set = set()

        def pairs(rows) -> None:
            sid, n, label = rows
            i, j = np.triu_indices(len(sid), 1)
            some = (label[i] != label[j]) & sizes_fit(n[i], n[j], percent)
            i, j = sid[i[some]], sid[j[some]]
            seen.update(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.int64()) for i in (0, 1)], ["a", "b"])
            seen.clear()
            return batch

        rest = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            ends = [0, *cuts.tolist()]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                pairs([c[a:b] for c in columns[1:]])
            rest = [c[ends[-1] :] for c in columns]
            if len(seen) > 100_000:
                yield out()
        if rest is not None and len(rest[0]):
            pairs(rest[1:])
        yield out()

    return run


def _multiplied(percent: int):
    """Of blocks of rows, sorted: links that join what the block's products join."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links(rows: list[tuple]) -> list[tuple]:
            if len({g for _, g, _ in rows}) < 2:
                return []
            like = alike([np.frombuffer(h, np.uint64) for _, _, h in rows], percent / 100)
            return [(rows[x][0], rows[y][0]) for x, y in forest(like, np.array([g for _, g, _ in rows]))]

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            found, cells = [], zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)
            for cell, key, label, hashes in zip(cells, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if cell != now:
                    found += links(held)
                    now, held = cell, []
                held.append((key, label, hashes.as_py()))
            yield batch_of(found)
        yield batch_of(links(held))

    return run


def _large_cells(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of cells of more than SMALL rows(cell, sid, n, label, m, hashed); cells of the same rows are multiplied once."""
    members = rows.groupBy("cell").agg(F.bit_xor("sid").alias("x"), F.sum(F.col("sid").cast("decimal(38,0)")).alias("y"), F.count("*").alias("c"))
    once = members.groupBy("x", "y", "c").agg(F.min("cell").alias("cell")).select("cell")
    zero = F.lit(0).cast("long")
    named = rows.join(once, "cell").select(zero.alias("band"), "cell", F.col("sid").alias("k0"), zero.alias("k1"), "n", F.col("sid").alias("root"), F.col("label").alias("component"), "m", "hashed", F.lit(True).alias("first"))
    dealt = last_meetings(named, block).join(sets.withColumnRenamed("sid", "k0"), "k0")
    ordered = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "key")
    return ordered.select("cell", "block", "key", "component", "hashes").mapInArrow(_multiplied(percent), "a binary, b binary")


def _components(docs: DataFrame, kinds: Stage, members: Stage, words: int, percent: int, small: int, block: int) -> DataFrame:
    """(key, component): the components of sets that link, of two sets at least."""
    wanted = Stage(members.df.select("sid").distinct(), "wanted")
    # a join by shuffle at every size: it brings copies together, so that they go and buckets are written where they are
    texts = docs.select(F.col("h").alias("sid"), "text").join(wanted.df.hint("merge"), "sid", "left_semi").dropDuplicates(["sid", "text"])
    sets = Buckets(_sets(texts, words), "sets", "sid")
    wanted.drop()
    release(docs.sparkSession)

    star = members.df.where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"), F.col("n").alias("m")).distinct()
    sized = star.join(kinds.df.select(F.col("sid").alias("a"), "n"), "a").where(f"100 * least(m, n) >= {percent} * greatest(m, n)")
    first = Stage(sized.select("a", "b").distinct(), "stars")
    links = [_linked(first.df, sets.df, percent)]
    joined = Stage(connected_components(links[0]), "joined")

    label = F.xxhash64(F.coalesce("component", "key"))
    rooted = kinds.df.select("sid", "key").join(joined.df.withColumnRenamed("node", "key"), "key", "left").select("sid", label.alias("label"))
    labelled = Stage(members.df.join(rooted, "sid").select("cell", "sid", "n", "label", "m", "hashed"), "labelled")
    split = labelled.df.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
    left = Stage(labelled.df.join(split, "cell", "left_semi"), "split")
    labelled.drop()
    listed = left.df.where(F.col("m") <= small).select("cell", "sid", "n", "label").repartition("cell").sortWithinPartitions("cell").mapInArrow(_listed(percent), "a long, b long").distinct()
    # pairs of the first products are not multiplied again
    done = first.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = Stage(listed.join(done, ["a", "b"], "left_anti"), "pairs")
    links.append(_linked(pairs.df, sets.df, percent))
    large = left.df.where(F.col("m") > small)
    if not large.isEmpty():
        links.append(Stage(_large_cells(large, sets.df, percent, block), "large").df)
    for x in links[1:]:
        links[0] = links[0].unionByName(x)
    answer = Stage(connected_components(links[0]), "components").df.select(F.col("node").alias("key"), "component")
    for x in (first, joined, left, pairs, sets):
        x.drop()
    return answer


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, counters: int = COUNTERS, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``component_id`` is the smallest id that links reach, its own included.

    Two rows link when 100 * (shared n-grams) >= percent * (n-grams of either), over the distinct ``words``-grams of their words
    after A-Z are lower-cased; a text of fewer words has them all as its one n-gram. Rows without text or words have no
    n-grams and no links: their component is their own id, or null. Null ids are never the smallest; a
    component of null ids alone is null. Different texts of one id are different rows, repeated rows link. No
    rows give no rows; further columns are ignored. N-grams are told apart by 64 bits, sets by 128. Ids are whole numbers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    model = spark.sparkContext.broadcast(count_ngrams(rows, words, counters))  # 16 MB
    profiles = Stage(_profiles(rows, model, words, percent), "profiles")
    own = Stage(profiles.df.select("doc_id", "key", "n"), "rows")
    kinds = Stage(profiles.df.where("key IS NOT NULL").dropDuplicates(["key"]).select(F.col("h").alias("sid"), "key", "n", "prefix"), "kinds")
    profiles.drop()
    release(spark)

    each = kinds.df.select(F.explode("prefix").alias("cell"), "sid", "n")
    cells = Stage(each.groupBy("cell").agg(F.count("*").alias("m"), F.min("sid").alias("lead"), F.sum("n").alias("hashed")).where("m > 1"), "cells")
    release(spark)
    members = Stage(each.join(cells.df, "cell"), "members")
    cells.drop()
    listed, kinds = kinds, Stage(kinds.df.drop("prefix"), "kinds")
    listed.drop()
    release(spark)

    found = _components(rows, kinds, members, words, percent, small, block)
    by_set = own.df.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    named = Stage(by_set.join(found, "key", "left").withColumn("component", F.coalesce("component", "key")), "named")
    least = named.df.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = named.df.join(least, "component").select("key", "copies", "component_id")
    with_words = own.df.where("key IS NOT NULL")
    linked = salted_join(with_words, answers, "key", "copies", own.df.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.df.where("key IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    answer = Stage(linked.unionByName(alone), "linked").df
    for x in (own, kinds, members, named):
        x.drop()
    return answer


ORACLE = f"""WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  grams AS (SELECT r, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')))) AS g FROM words WHERE len(w) > 0),
  sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
  ordered AS (SELECT r, g, count(*) OVER (PARTITION BY g) AS f FROM grams),
  ranked AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY f, g) AS p FROM ordered),
  prefixes AS (SELECT r, g FROM ranked JOIN sizes USING (r) WHERE 100 * (p - 1) <= {100 - PERCENT} * n),
  candidates AS (SELECT DISTINCT a.r AS a, b.r AS b FROM prefixes a JOIN prefixes b ON a.g = b.g AND a.r < b.r),
  shared AS (SELECT a, b, count(*) AS c FROM candidates JOIN grams x ON x.r = a JOIN grams y ON y.r = b AND y.g = x.g GROUP BY a, b),
  links AS (SELECT a, b FROM shared JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(r, x) AS (SELECT a, a FROM ways UNION SELECT reach.r, ways.b FROM reach JOIN ways ON ways.a = reach.x),
  least AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN words w ON w.r = reach.x GROUP BY reach.r)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN least.r IS NULL THEN doc_id ELSE component_id END AS component_id FROM words LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)"""
