"""Who may see or write the rows of a table, for all users at once.

``readers`` and ``writers`` add two columns to a table's rows: ``audience`` (``all``, ``known``: anyone
signed in, ``admin``, or ``user``) and ``reader``, that user's id. A row for everyone is one row, never one a
user; any other row is there once for each user of its own. ``as_user`` takes one user's rows out, the
same as ``policy.visible`` and ``policy.may_write`` give.

Lists are closed over their owners and collaborators as edges (list, user), which rows below a list join
by its id. Users that are null have no rights, lists that are missing give none to readers. Repeated
rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import PUBLIC, Tables

OWNED = {("profiles", "insert"): "id", ("profiles", "update"): "id", ("social_posts", "update"): "user_id", ("saved_places", "insert"): "user_id", ("saved_places", "delete"): "user_id", ("follows", "insert"): "follower_id", ("follows", "delete"): "follower_id"}


def _for(rows: DataFrame, audience: str) -> DataFrame:
    return rows.withColumns({"audience": F.lit(audience), "reader": F.lit(None).cast("long")})


def _of(rows: DataFrame, user: str) -> DataFrame:
    """Rows that are their user's."""
    return rows.where(F.col(user).isNotNull()).withColumns({"audience": F.lit("user"), "reader": F.col(user)})


def _same_reader(*parts: DataFrame) -> DataFrame:
    """Parts below one another; a missing reader takes the type of the users that there are."""
    kind = next((p.schema["reader"].dataType for p in parts if p.schema["reader"].dataType.typeName() != "long"), parts[0].schema["reader"].dataType)
    out = None
    for p in parts:
        p = p.withColumn("reader", F.col("reader").cast(kind))
        out = p if out is None else out.unionByName(p)
    assert out is not None
    return out


def _open() -> Column:
    return F.coalesce(F.col("is_public"), F.lit(False))


def list_readers(tables: Tables) -> DataFrame:
    """``list_id, audience, reader``, each once: a list that is public has the one row for all."""
    lists = tables["lists"].groupBy(F.col("id").alias("list_id")).agg(F.max(_open()).alias("open"))
    users = tables["lists"].select(F.col("id").alias("list_id"), F.col("user_id").alias("reader")).union(tables["list_collaborators"].select("list_id", "user_id"))
    mine = lists.where("NOT open").join(users.where("reader IS NOT NULL").distinct(), "list_id").select("list_id", F.lit("user").alias("audience"), "reader")
    return _same_reader(_for(lists.where("open").select("list_id"), "all"), mine)


def list_editors(tables: Tables) -> DataFrame:
    """``list_id, audience, reader`` of owners and editors, each once."""
    own = tables["lists"].select(F.col("id").alias("list_id"), "user_id")
    edits = tables["list_collaborators"].where("role = 'editor'").select("list_id", "user_id")
    return _of(own.union(edits).distinct(), "user_id").drop("user_id")


def _owners(tables: Tables) -> DataFrame:
    return _of(tables["lists"].select(F.col("id").alias("list_id"), "user_id").distinct(), "user_id").drop("user_id")


def _by(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Rows with the rights of what their key names."""
    right = edges.withColumnRenamed(edges.columns[0], "__of__")
    return rows.join(right, F.col(key) == F.col("__of__")).drop("__of__")


def readers(table: str, tables: Tables) -> DataFrame:
    rows = tables[table]
    if table in PUBLIC:
        return _for(rows, "all")
    if table == "saved_places":
        return _of(rows, "user_id")
    if table == "lists":
        shared = tables["list_collaborators"].where("user_id IS NOT NULL").select(F.col("list_id").alias("__of__"), F.col("user_id").alias("reader")).distinct()
        closed = rows.where(~_open())
        others = closed.join(shared, (F.col("id") == F.col("__of__")) & ~F.col("user_id").eqNullSafe(F.col("reader")))
        return _same_reader(_for(rows.where(_open()), "all"), _of(closed, "user_id"), others.withColumn("audience", F.lit("user")).drop("__of__"))
    if table == "list_places":
        return _by(rows, list_readers(tables), "list_id")
    if table == "list_collaborators":
        owned = _by(rows, _owners(tables), "list_id")
        return _same_reader(owned.where(~F.col("user_id").eqNullSafe(F.col("reader"))), _of(rows, "user_id"))
    if table == "guides":
        return _for(rows, "all").withColumn("audience", F.when(F.col("is_published"), "all").otherwise("known"))
    if table == "guide_places":
        shown = tables["guides"].groupBy("id").agg(F.max(F.coalesce("is_published", F.lit(False))).alias("p"))
        rights = _for(shown, "all").select("id", F.when(F.col("p"), "all").otherwise("known").alias("audience"), "reader")
        return _by(rows, rights, "guide_id")
    if table == "waitlist":
        return _for(rows, "admin")
    raise KeyError(table)


def writers(table: str, action: str, rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows of an ``insert``, ``update`` or ``delete`` with who is allowed; rows of nobody are left out."""
    if table in ("guides", "guide_places") or (table in ("cities", "places", "social_posts") and action == "insert"):
        return _for(rows, "known")
    if (table, action) in OWNED:
        return _of(rows, OWNED[table, action])
    if table == "lists":
        return _of(rows, "user_id")
    if table == "list_places" and action in ("insert", "delete"):
        return _by(rows, list_editors(tables), "list_id")
    if table == "list_collaborators" and action in ("insert", "delete"):
        return _by(rows, _owners(tables), "list_id")
    if table == "waitlist" and action == "insert":
        return _for(rows, "all")
    return _for(rows.where("false"), "all")


def as_user(rows: DataFrame, uid: object = None, admin: bool = False) -> DataFrame:
    """What one user has of rows with ``audience`` and ``reader``; None is someone who isn't signed in."""
    allowed = ["all"] + ["known"] * (uid is not None) + ["admin"] * admin
    own = F.col("audience").isin(allowed)
    return rows.where(own | F.coalesce(F.col("reader") == F.lit(uid), F.lit(False)) if uid is not None else own).drop("audience", "reader")


def reach(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """``reader, rows``: how many rows each signed-in user has; rows for all are counted once, not for each user."""
    own = rows.where("audience = 'user'").groupBy("reader").agg(F.count("*").alias("own"))
    shared = rows.where(F.col("audience").isin("all", "known")).agg(F.count("*").alias("shared"))
    each = users.select(F.col(user).alias("__user__")).where("__user__ IS NOT NULL").distinct()
    joined = each.join(own, F.col("__user__") == F.col("reader"), "left").crossJoin(F.broadcast(shared))  # one row
    return joined.select(F.col("__user__").alias("reader"), (F.coalesce("own", F.lit(0)) + F.col("shared")).alias("rows"))
