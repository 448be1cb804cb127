"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 60-bit hash. Words are summed by source and hash bucket (its leading 12 bits); the
running sum locates the bucket in which a source's budget ends, and only rows of that boundary
bucket are summed again by the next 12 bits, until a bucket holds one hash. A row is then taken by
comparing its hash with its source's threshold: nothing is sorted, and a larger budget takes a
superset of what a smaller one takes.

A budget beyond a source's size takes every row whole times first. The row on the boundary is taken
if that comes nearer to the target. Null text has size 0 and takes nothing; null sources are one
source, the last; rows repeated with id and text share a hash and a decision. A very long text is a
row like any other. Extra columns are ignored by ``plan_mix`` and kept by ``mix``. An empty table
gives an empty result. Weights follow the sources' order and are parameters. Sources may be many:
their ranks and sums are made in parts, and they are broadcast only where they are counted as few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, small, stored

LEVEL_BITS = 12
LEVELS = 5


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(id_col: str, text: str) -> Column:
    """60 bits of the MD5 of id and text, as a long."""
    joined = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rank``: the place of each row from 0, nulls last. Ranges of the order are numbered apart, so no task has all rows."""
    ranges = stored(rows.orderBy(F.col(by).asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = stored(counts.select("range", before.alias("base")), "ranges-before")
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.col(by).asc_nulls_last()))
    return ranges.withColumn("nth", nth).join(small(counts), "range").withColumn("rank", F.col("base") + F.col("nth") - 1).drop("range", "base", "nth")


def targets(sources: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """``source, source_size`` with ``target``: weighted shares of all sizes, each at most ``most_repeats`` times its source's size."""
    sources = ranked(sources, "source")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", cycle.cast("long")).drop("rank"), "weights")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    level, capped = total / weight, -1
    while True:  # the excess of capped sources goes to the others, by weight
        above = F.col("weight") * F.lit(level) > F.col("source_size") * most_repeats
        n, held, w = sources.where(above).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or w == weight:
            break
        capped, level = n, (total - most_repeats * held) / (weight - w)
    return sources.withColumn("target", F.least((F.col("source_size") * most_repeats).cast("double"), F.col("weight") * F.lit(level)))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: ``whole`` (times every row is taken) and ``below`` (rows of a smaller hash are taken once more)."""
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0))
    goals = goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # `prefix`: the boundary bucket so far; `left`: what of the budget it may still take
    state = stored(goals.select("source", "whole", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix")), "mix")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = sized.join(small(state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("p")))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(running))
        joined = sums.join(state.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("upto") - F.col("size"))
        # the first bucket that goes beyond; if none does, all of the source lies below
        first = joined.where(F.col("upto") > F.col("left")).groupBy("s").agg(F.min_by(F.struct("bucket", "before", "size"), "bucket").alias("b"))
        state = stored(
            state.join(first, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "whole", F.coalesce(F.col("left") - F.col("b.before"), F.lit(0.0)).alias("left"),
                F.coalesce("b.bucket", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("prefix"), F.coalesce("b.size", F.lit(0)).alias("edge"),
            ),
            "mix",
        )
    # the last level's bucket is one hash; its rows are taken if half of them or more lie within the budget
    return state.select("source", "whole", F.when((F.col("edge") > 0) & (2 * F.col("left") >= F.col("edge")), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: the id, ``source, hash, size, source_size, target`` and ``copies``, the times that the mix takes it."""
    sized = stored(docs.select(F.col(id_col), F.col(source).alias("source"), word_count(text).alias("size"), row_hash(id_col, text).alias("hash")), "sized")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats), "targets")
    limits = thresholds(sized, goals)
    per = stored(goals.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight"), "limits")
    rows = sized.join(small(per.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return rows.select(id_col, "source", "hash", "size", "source_size", "target", F.least(copies, F.lit(most_repeats)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, all columns; a row taken several times is repeated. Rows without words are left out."""
    sized = stored(docs.select(F.col(source).alias("source"), word_count(text).alias("size"), row_hash(id_col, text).alias("hash")), "sized")
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats), "targets")
    src, whole, below, copy = (fresh(docs.columns, c) for c in ("mix_source", "mix_whole", "mix_below", "mix_copy"))
    per = stored(thresholds(sized, goals).toDF(src, whole, below), "limits")
    joined = docs.join(small(per), docs[source].eqNullSafe(F.col(src)))
    copies = F.least(F.col(whole) + F.when(row_hash(id_col, text) < F.col(below), 1).otherwise(0), F.lit(most_repeats))
    taken = F.when(word_count(text) > 0, copies).otherwise(0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), taken.cast("int")))).drop(src, whole, below, copy)
