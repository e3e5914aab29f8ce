"""Mixture-controlled packing into sequences of a fixed number of tokens.

Every source is a queue of documents in seeded random order. Serving queues by deficit
round-robin with target shares w_s means that a token at place x of its queue is due at
virtual time x / w_s; between any two points of that clock each source gets its share, to
within one quantum, and what it lacks at the end of a window is served first in the next.
The due time depends on nothing but the place in the queue, so windows and partitions
need no hand-over: the deficit carried across both is in the clock itself.

Documents are cut into quanta of 256 ids, the last one into powers of two (37 = 32 + 4 + 1).
Pieces of one size, ordered by due time, fill whole slots of 256 ids, and the slots of all
sizes are interleaved in proportion. A sequence is 8 consecutive slots, so no sequence but
the last is padded. Ids are checksummed while they are at hand and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import buckets_for, hex_fraction_bucket, shuffle_key, with_positions
from .staging import Stage
from .tokens import tokenizer_file, word_encoder

QUANTUM = 256
END_OF_TEXT = 1
#: Documents that a task encodes at a time.
ENCODED_ROWS = 512


def cuts(tokens: int, quantum: int = QUANTUM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole quanta, then powers of two."""
    whole, rest = divmod(tokens, quantum)
    out = [(i * quantum, quantum) for i in range(whole)]
    start, size = whole * quantum, quantum // 2
    while size:
        if rest & size:
            out.append((start, size))
            start += size
        size //= 2
    return out


def _tokenized(docs: DataFrame, text_col: str, json_path: str | None, ranks_path: str | None, end_id: int, quantum: int) -> DataFrame:
    """doc_id, stratum, shuffle_key, doc_tokens and an array of (start, length, crc)."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # the default vocabulary is the worker's own file
        encoder, end = word_encoder(json_path or tokenizer_file("byte_bpe_50k.json"), ranks_path or tokenizer_file("byte_bpe_50k.tiktoken")), end_id.to_bytes(4, "little")
        for batch in (whole.slice(at, ENCODED_ROWS) for whole in batches for at in range(0, whole.num_rows, ENCODED_ROWS)):
            totals, offsets, starts, lengths, crcs = [], [0], [], [], []
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for encoded in encoder.encode_all(texts):
                ids = memoryview(encoded.astype("<u4").tobytes() + end)
                totals.append(len(ids) // 4)
                for start, length in cuts(totals[-1], quantum):
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                offsets.append(len(starts))
            pieces = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["start", "length", "crc"]),
            )
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "stratum", "shuffle_key")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(totals, pa.int64()), pieces], ["doc_id", "stratum", "shuffle_key", "doc_tokens", "pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "stratum", "shuffle_key", F.col(text_col).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, stratum string, shuffle_key string, doc_tokens long, pieces array<struct<start:long,length:long,crc:long>>"
    )


def pack(
    docs: DataFrame,
    sequence_tokens: int = 2048,
    targets: dict[str, float] | None = None,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    json_path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = END_OF_TEXT,
    quantum: int = QUANTUM,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` are the wanted token shares by source (default: the corpus's own, so that
    all queues run dry together; a source that isn't named gets its own share). When a queue
    is dry the others share its place. Null and empty texts are one end-of-text id. Null
    source is a queue of its own. Repeated rows are packed as often as they occur. No rows
    give no pieces. Further columns are ignored.
    """
    if sequence_tokens % quantum or quantum & (quantum - 1):
        raise ValueError("the quantum must be a power of two that divides the sequence")
    queued = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("stratum"),
        shuffle_key(seed, F.col(id_col), F.col(text_col)).alias("shuffle_key"),
    )
    tokenized = Stage(_tokenized(queued, "text", json_path, ranks_path, end_id, quantum), "tokens")
    rows = tokenized.df.count()
    placed = with_positions(
        tokenized.df.select("doc_id", "stratum", "shuffle_key", "doc_tokens", "pieces").withColumn("bucket", hex_fraction_bucket(F.col("shuffle_key"), buckets_for(rows))),
        ["stratum"], "bucket", ["shuffle_key", "doc_id", "doc_tokens"], weight="doc_tokens",
    )
    share = F.col("in_all").cast("double")
    if targets:
        total = float(sum(targets.values()))
        wanted = F.create_map(*[x for k, v in targets.items() for x in (F.lit("=" + k), F.lit(v / total))])
        tokens = tokenized.df.agg(F.sum("doc_tokens")).first()[0] or 0
        share = F.coalesce(wanted[F.col("stratum")] * F.lit(float(tokens)), share)
    jitter = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    pieces = Stage(
        placed.select("doc_id", "stratum", "doc_tokens", "before", share.alias("share"), jitter.alias("jitter"), F.explode("pieces").alias("p")).select(
            "doc_id",
            "stratum",
            "doc_tokens",
            F.col("p.start").alias("start"),
            F.col("p.length").alias("length"),
            F.col("p.crc").alias("crc"),
            ((F.col("before") + F.col("p.start") + F.col("jitter") * F.col("p.length")) / F.col("share")).alias("due"),
        ),
        "pieces",
    )
    tokenized.drop()
    of_size = {r["length"]: (r["n"], r["last"]) for r in pieces.df.groupBy("length").agg(F.count("*").alias("n"), F.max("due").alias("last")).collect()}
    if not of_size:
        return _slotted(pieces.df.withColumn("before", F.lit(0).cast("long")), {}, sequence_tokens, quantum)
    span, buckets = max(x[1] for x in of_size.values()) or 1.0, buckets_for(sum(x[0] for x in of_size.values()))
    ranked = with_positions(
        pieces.df.withColumn("bucket", F.least(F.floor(F.col("due") * F.lit(buckets / span)), F.lit(buckets - 1)).cast("long")),
        ["length"], "bucket", ["due", "stratum", "doc_id", "start", "crc"],
    )
    return _slotted(ranked, {k: n for k, (n, _) in of_size.items()}, sequence_tokens, quantum)


def _slotted(ranked: DataFrame, pieces_of_size: dict[int, int], sequence_tokens: int, quantum: int) -> DataFrame:
    """Sequence and offset of each piece from its rank among those of its size (``before``).

    Slot k of n slots of one size stands at (2k + 1) / 2n of the way; its global rank is
    the number of slots of all sizes before that point, ties to the larger size. Pieces that
    fill no whole slot come last, larger sizes first.
    """
    sizes = [quantum >> i for i in range(quantum.bit_length())]
    slots = {s: pieces_of_size.get(s, 0) // (quantum // s) for s in sizes}
    wide = "decimal(38,0)" if 2 * max(slots.values(), default=0) ** 2 > 2**62 else "long"
    place, rest = F.lit(None).cast("long"), quantum * sum(slots.values())
    for size in sizes:
        per, n = quantum // size, slots[size]
        k = f"(before div {per})"
        ranks = [k]
        for other in sizes:
            if other != size and slots[other] and n:
                add = n if other > size else n - 1
                ranks.append(f"((cast(2 * {k} + 1 as {wide}) * {slots[other]} + {add}) div {2 * n})")
        in_slot = F.expr(f"({' + '.join(ranks)}) * {quantum} + (before % {per}) * {size}")
        left = F.lit(rest).cast("long") + (F.col("before") - n * per) * size
        place = F.when(F.col("length") == size, F.when(F.col("before") < n * per, in_slot).otherwise(left)).otherwise(place)
        rest += (pieces_of_size.get(size, 0) - n * per) * size
    return ranked.withColumn("place", place.cast("long")).select(
        "doc_id",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        F.expr(f"place div {sequence_tokens}").alias("sequence_id"),
        (F.col("place") % sequence_tokens).alias("offset"),
        F.when(F.col("stratum") != "", F.substring(F.col("stratum"), 2, 1 << 30)).alias("source"),
    )
