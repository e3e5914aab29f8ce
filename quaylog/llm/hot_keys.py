"""A join by a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are hot, so their table may be broadcast at any size of the input.
HOT_KEYS = 10_000
LEAST_ROWS = 1_000


def salted_join(rows: DataFrame, answers: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``answers``, which has one row per ``key`` and how many ``rows`` it has in ``count``.

    A key of more than total / 10,000 rows (1,000 at least) is hot: its rows are dealt to as many
    tasks as that bound goes into them, and its answer is copied to each. All other keys have one
    task, as in a plain join. ``total`` is the number of ``rows``, which are best read from files.
    """
    most = max(LEAST_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = F.broadcast(answers.where(F.col(count) > most).select(key, parts.alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = answers.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copied, [key, "_part"], how).drop("_part")
