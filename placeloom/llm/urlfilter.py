"""URL filters by a temporal list join, with DataFrame functions only.

List entries are dated: an entry is added or removed at a time. Each entry's changes become validity
intervals, from an addition to the next change; an as-of join then evaluates every capture against
the entries active when it was fetched. An entry is a ``host``, a ``domain`` (it and all below it)
or a ``prefix`` (host and path, by whole segments, as ``host/a/b``).

A capture with an active entry of an allowing list is ``allow``, else with one of a blocking list
``block``, else ``none``; without a host (null, relative or unparseable URLs) it is ``invalid``.
At one instant a removal wins over an addition; repeated entries count once; entries with a null
field are ignored. A null fetch time matches nothing. Repeated captures are judged alike; other
columns of captures are kept, and names that clash are avoided. Empty tables give empty results or
no matches.

Only captures of listed hosts are joined with entries: the hosts are reduced to distinct ones first,
so a host with a third of all captures is one row there, and sides are broadcast only after a count.
Adaptive execution splits a hot host in the joins by URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, stored

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and final dots; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, effect, kind, pattern, since, until``: when each entry is active (``until`` is null while it still is).

    ``entries`` has ``list, effect`` (``block`` or ``allow``), ``kind, pattern, action`` (``add`` or ``remove``) and ``at``.
    """
    key = ["list", "effect", "kind", "pattern"]
    whole = entries.dropna(subset=[*key, "action", "at"]).withColumn("pattern", F.regexp_replace(F.lower("pattern"), r"/+$", ""))
    changes = whole.groupBy(*key, "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    changes = changes.withColumn("until", F.lead("at").over(Window.partitionBy(*key).orderBy("at")))
    return changes.where(~F.col("removed")).select(*key, F.col("at").alias("since"), "until")


def _parents(host: Column) -> Column:
    """The host and the domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def _prefixes(host: Column, path: Column) -> Column:
    """Host and path up to each segment's end."""
    parts = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.concat(F.array(host), F.slice(parts, F.lit(1), k)), "/"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All columns of ``captures`` with ``host, verdict, n_block, n_allow`` (active entries) and ``since`` (start of the oldest that decides)."""
    active = stored(intervals(entries), "intervals")
    names = captures.columns
    host = fresh(names, "host")
    rows = captures.withColumn(host, host_of(F.col(url)))
    hosts = rows.select(F.col(host).alias("h")).where("h is not null").distinct()
    owners = small(stored(active.select(F.substring_index("pattern", "/", 1).alias("p")).distinct(), "owners"))
    listed = hosts.select("h", F.explode(_parents(F.col("h"))).alias("p")).join(owners, "p", "left_semi").select("h").distinct()
    listed = small(stored(listed, "hosts"))
    inside = rows.join(listed.withColumnRenamed("h", "h_"), rows[host] == F.col("h_"), "left_semi")
    outside = rows.join(listed.withColumnRenamed("h", "h_"), rows[host] == F.col("h_"), "left_anti")

    keyed = inside.select(F.col(url).alias("u"), F.col(fetched).alias("t"), F.col(host).alias("h")).distinct()
    domains = F.transform(_parents(F.col("h")), lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("pattern")))
    prefixes = F.transform(_prefixes(F.col("h"), F.lower(path_of(F.col("u")))), lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("h").alias("pattern")))
    keyed = keyed.select("u", "t", F.explode(F.concat(own, domains, prefixes)).alias("k")).select("u", "t", "k.kind", "k.pattern")
    hits = keyed.join(small(active), ["kind", "pattern"]).where((F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    block = F.col("effect") == "block"
    found = hits.groupBy("u", "t").agg(
        F.count_if(block).alias("n_block_"), F.count_if(~block).alias("n_allow_"),
        F.min(F.when(block, F.col("since"))).alias("blocked_"), F.min(F.when(~block, F.col("since"))).alias("allowed_"),
    )
    judged = inside.join(found, inside[url].eqNullSafe(F.col("u")) & inside[fetched].eqNullSafe(F.col("t")), "left")
    n_block, n_allow = F.coalesce("n_block_", F.lit(0)), F.coalesce("n_allow_", F.lit(0))
    extra = [fresh(names, c) for c in ("verdict", "n_block", "n_allow", "since")]
    verdict = F.when(n_allow > 0, "allow").when(n_block > 0, "block").otherwise("none")
    since = F.when(n_allow > 0, F.col("allowed_")).otherwise(F.col("blocked_"))
    judged = judged.select(*[F.col(f"`{c}`") for c in rows.columns], verdict.alias(extra[0]), n_block.cast("long").alias(extra[1]), n_allow.cast("long").alias(extra[2]), since.alias(extra[3]))
    zero = F.lit(0).cast("long")
    others = outside.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(host).isNull(), "invalid").otherwise("none").alias(extra[0]),
        zero.alias(extra[1]), zero.alias(extra[2]), F.lit(None).cast(judged.schema[extra[3]].dataType).alias(extra[3]),
    )
    return judged.unionByName(others)
