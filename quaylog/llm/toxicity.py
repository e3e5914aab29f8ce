"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding undoes disguise: compatibility forms, accents, homoglyphs of other alphabets, digits
and signs that stand for letters inside words, and case. Terms are word starts (" lowei") or
whole words (" idiot "), weighted by the log-ratio of their document rates in toxic and
other labelled documents. A hit inside an exception phrase doesn't count. The weights of
the distinct terms found, normalised by text length, are calibrated to a probability.
"""

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stage

#: Letters of other alphabets that look like Latin ones, and signs read as letters. Fixed values.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
        "α": "a", "β": "b", "γ": "y", "δ": "d", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
        "ı": "i", "ʟ": "i", "ø": "o", "ł": "i", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d",
        "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "l": "i", "|": "i",
    }
)
IN_WORD = str.maketrans("@$!|+€£", "asiitei")
_SIGN = re.compile(r"(?<=\w)[@$!|+€£](?=\w)|(?<![\w$])[@$€£](?=[^\W\d])")
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")

#: Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "circus clown", "class clown", "clown fish", "pond scum", "soap scum", "scum line", "keep it simple stupid", "idiot proof", "idiot light", "sore loser", "winner and loser")
MIN_STEM, MAX_STEM = 4, 12
#: Hash orders of five-word runs, and how many of their least hashes near copies share.
ORDERS, SHARED = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), 3
#: Labelled documents, in the order of a hash of their ids, that the lexicon is learned from.
TRAINING_ROWS = 40_000


def fold(text: str | None) -> str:
    """Words of letters in one plain form, with a space before and after each."""
    t = text or ""
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    t = _SIGN.sub(lambda m: m.group().translate(IN_WORD), t.lower()).translate(HOMOGLYPHS)
    return f" {_NOT_LETTERS.sub(' ', t).strip()} "


@dataclass
class Lexicon:
    """Terms with weights, exception phrases (both folded) and the calibration of a score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = math.log(0.1)
    slope: float = 1.0
    prior: float = 0.1


def length_norm(words: int) -> float:
    """What the sum of weights is divided by: 1 for short texts, 2 at 9,000 words, 3 at 45,000."""
    return 1.0 + math.log1p(words / 1500) / math.log(7)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            if phrase not in lexicon.terms:
                self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def raw(self, text: str | None) -> float:
        return self.raw_of(fold(text))

    def raw_of(self, folded: str) -> float:
        """Weights of the distinct terms found outside exceptions, over the length norm."""
        if not len(self.automaton):
            return 0.0
        spared, hits = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (spared if weight is None else hits).append((end - size + 1, end, weight))
        if spared and hits:
            spared.sort(key=lambda s: s[:2])
            begins, reach = [a for a, _, _ in spared], []
            for _, b, _ in spared:
                reach.append(max(b, reach[-1]) if reach else b)
            # the phrases that begin no later than a hit hold it if the farthest of them reaches its end
            hits = [h for h in hits if h[0] < begins[0] or reach[bisect_right(begins, h[0]) - 1] < h[1]]
        if not hits:
            return 0.0
        found = {folded[a : b + 1]: w for a, b, w in hits}
        return sum(found.values()) / length_norm(folded.count(" "))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.lexicon.intercept + self.lexicon.slope * self.raw(text)))))


def _signatures(words: list[str]) -> list[int]:
    """Least hash of the five-word runs under each order; two texts share one with their similarity as chance."""
    import numpy as np

    runs = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
    return [int((((runs ^ (runs >> np.uint64(15))) * np.uint64(k)) & np.uint64(0xFFFFFFFF)).min()) for k in ORDERS]


def _training_table(training: DataFrame) -> Stage:
    """(toxic, folded): the texts of training(doc_id, toxic, text), folded, of near copies with one label the first by id.

    A text is a near copy of the document of the smallest id that has one of its signatures, if it shares
    enough of them; repeated rows are copies too.
    """

    def fold_all(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, toxic, texts = batch.columns
            folded = [fold(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, toxic, pa.array([_signatures(f.split()) for f in folded], pa.list_(pa.int64())), pa.array(folded, pa.string())], ["doc_id", "toxic", "signatures", "folded"])

    kind = training.schema["doc_id"].dataType.simpleString()
    every = Stage(training.select("doc_id", "toxic", "text").mapInArrow(fold_all, f"doc_id {kind}, toxic int, signatures array<long>, folded string"), "folded")
    marked = every.df.select("doc_id", "toxic", F.posexplode("signatures").alias("i", "s"))
    firsts = marked.groupBy("toxic", "i", "s").agg(F.min("doc_id").alias("first"))
    shared = marked.distinct().join(firsts, ["toxic", "i", "s"]).where("first < doc_id").groupBy("doc_id", "first").agg(F.count_distinct("i").alias("n"))
    copies = shared.where(F.col("n") >= SHARED).select("doc_id").distinct()
    table = Stage(every.df.join(copies, "doc_id", "left_anti").groupBy("doc_id", "toxic").agg(F.min("folded").alias("folded")).select("toxic", "folded"), "training")
    every.drop()
    return table


def _word_counts(training: DataFrame) -> DataFrame:
    """(word, toxic, clean): texts of training(toxic, folded) that hold a word."""

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, folded in zip(*batch.columns, strict=True):
                seen[toxic.as_py()].update(set(folded.as_py().split()))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    return training.select("toxic", "folded").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beyond_chance(terms: DataFrame, toxic_docs: int, clean_docs: int, terms_tried: int) -> DataFrame:
    """Terms whose share of toxic texts is beyond chance (Chernoff's bound) among all that were tried."""
    rate = toxic_docs / (toxic_docs + clean_docs)
    n = F.col("toxic") + F.col("clean")
    q = F.col("toxic") / n
    divergence = q * F.log(q / F.lit(rate)) + F.when(q < 1, (1 - q) * F.log((1 - q) / F.lit(1 - rate))).otherwise(0.0)
    return terms.where((q >= 0.5) & (q > rate) & (n * divergence >= math.log(max(2, terms_tried)) + 2))


def _choose(good: dict[str, tuple[int, int]], toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Weights of terms (with toxic and clean texts of each); of nested terms the widest that is as good."""
    out: dict[str, float] = {}
    ordered = sorted(good)
    for term in sorted(good, key=lambda t: (len(t), t)):
        toxic, clean = good[term]
        if any(term[:k] in out for k in range(1, len(term))):
            continue
        at, purer = bisect_right(ordered, term), False
        while at < len(ordered) and ordered[at].startswith(term) and not purer:
            purer = good[ordered[at]][0] >= 0.9 * toxic and good[ordered[at]][1] <= clean
            at += 1
        if not purer:
            out[term] = math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log((clean + 0.5) / (clean_docs + 1))
    return out


def learn_lexicon(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, training_rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from labelled documents (``labels``: doc_id and toxic 0 or 1, null left out).

    Learned from the first ``training_rows`` labels by a hash of the id: the documented bound of
    the sample, and so of the distinct terms in it, of which those beyond chance are brought to
    the driver. All counts are of the sample's texts, near copies once; labels without a document
    count for nothing. Of several labels of an id the larger holds, of several texts the
    smallest. With no labels, or labels of one kind, there are no terms and every text gets the same score.
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = _training_table(texts.join(F.broadcast(chosen), "doc_id"))  # at most training_rows ids
    training = table.df
    kinds = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic_docs, clean_docs = kinds.get(1, 0), kinds.get(0, 0)
    prior = (toxic_docs + 1) / (toxic_docs + clean_docs + 2)
    folded = tuple(f for f in (fold(x) for x in exceptions) if f.strip())
    lexicon = Lexicon({}, folded, math.log(prior / (1 - prior)), 1.0, prior)
    if not toxic_docs or not clean_docs:
        table.drop()
        return lexicon
    words = _word_counts(training)
    stems = F.when(F.length("word") > MIN_STEM, F.transform(F.sequence(F.lit(MIN_STEM), F.least(F.length("word") - 1, F.lit(MAX_STEM))), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k))))
    terms = Stage(
        words.select("toxic", "clean", F.explode(F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.coalesce(stems, F.array().cast("array<string>")))).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 3"),
        "terms",
    )
    good = _beyond_chance(terms.df, toxic_docs, clean_docs, terms.df.count()).collect()
    lexicon.terms = _choose({r["term"]: (r["toxic"], r["clean"]) for r in good}, toxic_docs, clean_docs)
    lexicon.intercept, lexicon.slope = _calibrate(training, lexicon)
    terms.drop()
    table.drop()
    return lexicon


def _calibrate(training: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Logistic intercept and slope, held near those that independent terms would have."""
    import numpy as np

    def raw(batches: Iterator) -> Iterator:
        matcher = Matcher(lexicon)
        for batch in batches:
            toxic, folded = batch.columns
            yield pa.RecordBatch.from_arrays([toxic, pa.array([round(matcher.raw_of(t.as_py()), 1) for t in folded], pa.float64())], ["toxic", "raw"])

    bins = training.select("toxic", "folded").mapInArrow(raw, "toxic int, raw double").groupBy("toxic", F.least("raw", F.lit(100.0)).alias("raw")).agg(F.count("*").alias("n")).collect()  # 2 x 1001 rows at most
    bins.sort()
    x, y, n = (np.array([r[c] for r in bins], float) for c in ("raw", "toxic", "n"))
    start = np.array([math.log(lexicon.prior / (1 - lexicon.prior)), 1.0])
    hold, w = np.array([0.1, 20.0]), start.copy()
    design = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -50, 50)))
        gradient = design @ (n * (y - p)) - hold * (w - start)
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + np.diag(hold), gradient)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.05))


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null texts count as empty; texts without hits get the calibrated score of none. Nothing but
    the text is used. Repeated rows are scored alike; no rows give no rows.
    """

    def score(batches: Iterator) -> Iterator:
        matcher = Matcher(lexicon)
        for batch in batches:
            ids, texts = batch.columns
            yield pa.RecordBatch.from_arrays([ids, pa.array([matcher.score(t.as_py()) for t in texts], pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic(text: Column, lexicon: Lexicon, threshold: float = 0.7) -> Column:
    """Whether a text is toxic; a null text counts as empty."""

    @F.arrow_udf("boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)
        for texts in batches:
            yield pa.array((matcher.score(t.as_py()) >= threshold for t in texts), pa.bool_(), size=len(texts))

    return judge(F.coalesce(text, F.lit("")))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_and_score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels that aren't held out.

    Null texts count as empty; null ids are scored and held out from nothing; repeated rows get a
    row each. Without labels all texts get one score; no rows give no rows. Further columns
    of either table are ignored.
    """
    lexicon = learn_lexicon(docs, labels.where(~held_out()))
    return score_documents(docs, lexicon, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
