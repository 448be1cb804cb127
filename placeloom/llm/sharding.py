"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows of equal text stay together. Groups are summed by Spark; those of at least 1/``bundles`` of
all bytes (so ``bundles`` of them at most) are items of their own, and the smaller ones are bundled
by hash into ``bundles`` items. Sorted by size, the items, at most twice ``bundles``, go to the
least-loaded shard through a heap on the driver.

Null text counts as empty and shares its group; null ids and repeated rows keep their rows. A group
larger than a shard's share makes its shard larger. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

BUNDLES = 16_384
#: Parts of a shard whose rows are numbered apart, and the rows of a part beyond which its rows are dealt out again.
NUMBERED, CROWDED = 2048, 1_000_000


def schedule(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: largest first, to the least-loaded (of equal loads, the lowest)."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, s = heap[0]
        out[k] = s
        heapq.heapreplace(heap, (load + sizes[k], s))
    return out


def shard(docs: DataFrame, shards: int = 8, bundles: int = BUNDLES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard`` and ``slot``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("key"))
    rows = stored(rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("int")), "sizes")
    groups = stored(rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = F.col("bytes") * bundles >= F.lit(total)
    items = groups.where(large).select(F.col("key"), F.lit(-1).alias("bundle"), "bytes")
    items = items.unionByName(groups.where(~large).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).withColumn("key", F.lit("")))
    found = sorted(items.collect(), key=lambda r: (-r["bytes"], r["key"], r["bundle"]))  # at most 2 * bundles rows
    to = schedule([r["bytes"] for r in found], shards)
    dealt = spark.createDataFrame([(r["key"], r["bundle"], s) for r, s in zip(found, to)], "k string, b int, s int")
    alone = F.broadcast(dealt.where("b < 0").select("k", F.col("s").alias("own")))
    bundled = F.broadcast(dealt.where("b >= 0").select("b", F.col("s").alias("shared")))
    placed = rows.join(alone, F.col("key") == F.col("k"), "left").join(bundled, F.col("bundle") == F.col("b"), "left")
    placed = placed.select(id_col, "size", "text_crc32", "key", F.coalesce("own", "shared").alias("shard"))
    return numbered(placed, id_col)


def numbered(placed: DataFrame, id_col: str, crowded: int = CROWDED) -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard. Parts of a shard are numbered apart, and begin where the parts before them end.

    Rows that are equal in id and text share a part; a part of more than ``crowded`` rows is dealt out by where its rows
    lie, so none has to be numbered in one task.
    """
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.col(id_col), F.col("key")), F.lit(NUMBERED)).cast("int"))
    placed = stored(placed.withColumn("lies", F.monotonically_increasing_id()), "placed")
    cuts = placed.groupBy("shard", "part").agg(F.ceil(F.count("*") / crowded).cast("int").alias("cuts")).where("cuts > 1")
    cuts = small(stored(cuts, "crowded"))
    dealt = placed.join(cuts, ["shard", "part"], "left").withColumn("cut", F.coalesce(F.pmod(F.col("lies"), F.col("cuts")), F.lit(0))).drop("cuts", "lies")
    counts = dealt.groupBy("shard", "part", "cut").count()
    upto = Window.partitionBy("shard").orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("shard", "part", "cut", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base")), "bases")
    nth = F.row_number().over(Window.partitionBy("shard", "part", "cut").orderBy(F.col(id_col), "key"))
    out = dealt.withColumn("nth", nth).join(small(counts), ["shard", "part", "cut"])
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"))
