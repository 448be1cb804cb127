"""Changes of tables as functions from tables to tables. The result is written to a new path, or merged where a table format can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..schemas import DEFAULTS, REFERENCES, UNIQUE


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Columns that the rows don't have get their defaults; a null that is there stays."""
    for name, value in DEFAULTS.get(table, {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by the order; nulls come first. No window: a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    whole = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row__")
    return rows.groupBy(*keys).agg(whole).select(*keys, "__row__.*").select(*rows.columns)


def least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the least row by all other columns in order (nulls first), so that reruns agree."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row__")).select(*keys, "__row__.*").select(*rows.columns)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added, one of each key (the least by all columns); others change nothing. Null keys meet no row of the target."""
    fresh = least(rows, keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows replace those of the same key or are added; of several with one key the last by ``order`` counts, without an order the least by all columns."""
    rows = latest(rows, keys, order) if order else least(rows, keys)
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def update(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``changes`` (one row per key) replace those of matching rows, nulls too."""
    new = [c for c in changes.columns if c not in keys]
    side = changes.select(*[F.col(k).alias(f"__{k}__") for k in keys], *[F.col(c).alias(f"__new_{c}__") for c in new], F.lit(True).alias("__hit__"))
    on = [F.col(k) == F.col(f"__{k}__") for k in keys]
    joined = target.join(side, on, "left")
    return joined.select(*[F.when(F.col("__hit__"), F.col(f"__new_{c}__")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def sparse_update(target: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Patches (one row per key) set the columns for which ``has_<column>`` is true, strings trimmed; null is a value, absence is not.

    No patch column at all raises ValueError.
    """
    if not columns:
        raise ValueError("no field to update")
    side = patches.select(F.col(key).alias("__key__"), *[x for c in columns for x in (F.col(c).alias(f"__new_{c}__"), F.coalesce(F.col(f"has_{c}"), F.lit(False)).alias(f"__has_{c}__"))])
    joined = target.join(side, F.col(key) == F.col("__key__"), "left")
    kinds = dict(target.dtypes)
    new = lambda c: trim_space(f"__new_{c}__") if kinds[c] == "string" else F.col(f"__new_{c}__")
    return joined.select(*[F.when(F.col(f"__has_{c}__"), new(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def unmatched(target: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches without a row to change."""
    return patches.join(target.select(key), key, "left_anti")


def merge_duplicate(posts: DataFrame, saved: DataFrame, columns: list[str]) -> DataFrame:
    """Finished posts (``id, platform, content_id`` and ``columns``) that came in under placeholder rows.

    Where another row has the platform and content id, that canonical row takes the columns and the placeholder
    is only marked completed; else the placeholder takes them with the content id. Of several placeholders of one
    content id that of the least id counts, of its rows the least by the columns.
    """
    there = posts.select(F.col("platform"), F.col("content_id"), F.col("id").alias("canonical"))
    joined = saved.join(there, ["platform", "content_id"], "left").withColumn("target", F.coalesce("canonical", "id"))
    main = joined.select(F.col("target").alias("id"), F.col("id").alias("__from__"), "platform", "content_id", *columns, F.lit("completed").alias("status"))
    merged = update(posts, least(main, ["id"]).drop("__from__"), ["id"])
    placeholders = joined.where("target <> id").select("id", F.lit("completed").alias("status"))
    return update(merged, placeholders, ["id"])


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows whose keys are in ``gone``; a second time changes nothing."""
    return target.join(gone.select(*keys), keys, "left_anti").select(*target.columns)


def _parents_first() -> list[str]:
    """Tables in an order in which what cascades to a table comes before it."""
    left = {(p, c) for c, _, p, action in REFERENCES if action == "cascade"}
    names, out = sorted({x for edge in left for x in edge}), []
    while names:
        free = [n for n in names if all(c != n for _, c in left)]
        if not free:
            raise ValueError(f"references cascade in a circle: {names}")
        out += free
        names, left = [n for n in names if n not in free], {(p, c) for p, c in left if p not in free}
    return out


def delete_cascading(tables: dict[str, DataFrame], table: str, gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """All tables without the rows ``gone`` of one: children go too, or lose their reference.

    A table that is reached on several ways loses what goes on any of them. The table itself may be missing (users are
    kept elsewhere); so may children and their columns.
    """
    lost = {table: gone.select(F.col(key).alias("__gone__")).distinct()}
    there = [(child, column, parent, action) for child, column, parent, action in REFERENCES if child in tables and column in tables[child].columns]
    for name in _parents_first():
        hits = [tables[name].join(lost[parent], F.col(column) == F.col("__gone__"), "left_semi").select(F.col("id").alias("__gone__")) for child, column, parent, action in there if child == name and action == "cascade" and parent in lost]
        if hits:
            ids = lost.get(name)
            for hit in hits:
                ids = hit if ids is None else ids.unionByName(hit)
            lost[name] = ids.distinct()  # type: ignore[union-attr]
    out = dict(tables)
    for name in lost.keys() & tables.keys():
        out[name] = tables[name].join(lost[name], F.col(key if name == table else "id") == F.col("__gone__"), "left_anti")
    for child, column, parent, action in there:
        if action == "set null" and parent in lost:
            out[child] = set_null(out[child], lost[parent], column)
    return out


def set_null(child: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """References to the ids (one column, distinct) become null."""
    ids = ids.toDF("__gone__")
    joined = child.join(ids, F.col(column) == F.col("__gone__"), "left")
    return joined.withColumn(column, F.when(F.col("__gone__").isNull(), F.col(column))).select(*child.columns)


def attach(children: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """Children get the parent that ``links`` (one row per key) gives them; others stay."""
    side = links.select(F.col(key).alias("__key__"), F.col(column).alias("__parent__"))
    joined = children.join(side, F.col(key) == F.col("__key__"), "left")
    return joined.withColumn(column, F.coalesce("__parent__", column)).select(*children.columns)


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; nulls are never equal."""
    return table.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(name: str, table: DataFrame) -> dict[str, DataFrame]:
    """Rows or keys that break each rule of a table: uniqueness, and columns that mustn't be null."""
    from ..schemas import TABLES

    out = {f"unique({', '.join(k)})": duplicates(table, k) for k in UNIQUE.get(name, [])}
    return out | {f"not null({f.name})": table.where(F.col(f.name).isNull()) for f in TABLES[name] if not f.nullable and f.name in table.columns}
