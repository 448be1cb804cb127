"""Queries on places, saved places, lists, categories and cities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, is_blank, like_any_case, text_key
from .paging import Page, paged, sort_keys


@dataclass(frozen=True)
class Columns:
    """Names of a places table's columns."""

    id: str = "id"
    name: str = "name"
    description: str = "description"
    neighborhood: str = "neighborhood"
    category: str = "category"
    city: str = "city"
    user_id: str = "user_id"
    post_id: str = "social_post_id"
    created_at: str = "created_at"


def filtered(places: DataFrame, search: str = "", category: str = "", city: str = "", post_id: str = "", user_id: object = None, mine: bool = False, c: Columns = Columns()) -> DataFrame:
    """Places by optional filters, each applied if its value isn't blank.

    ``search`` is looked for in name, description and neighborhood, ``city`` in the city, ``category`` is the
    whole category; all in any case with ``%`` and ``_`` as wildcards. ``mine`` needs a user (PermissionError).
    """
    if search := search.strip():
        places = places.where(like_any_case(c.name, search) | like_any_case(c.description, search) | like_any_case(c.neighborhood, search))
    if category := category.strip():
        places = places.where(like_any_case(c.category, category, whole=True))
    if city := city.strip():
        places = places.where(like_any_case(c.city, city))
    if post_id := post_id.strip():
        places = places.where(F.col(c.post_id) == post_id)
    if mine:
        if user_id is None:
            raise PermissionError("a user is needed for own places")
        places = places.where(F.col(c.user_id) == F.lit(user_id))
    return places


def places_page(places: DataFrame, page: Page, sort_by: str = "created_at", ascending: bool = False, c: Columns = Columns(), **filters) -> DataFrame:
    """A page of filtered places; an unknown sort column falls back to the creation time."""
    allowed = {"name": c.name, "category": c.category, "city": c.city, "created_at": c.created_at}
    return paged(filtered(places, c=c, **filters), sort_keys(sort_by, ascending, allowed, "created_at", c.id), page)


def place_detail(places: DataFrame, asked: DataFrame, id_col: str = "id", post_col: str = "social_post_id", asked_col: str = "asked") -> DataFrame:
    """For each asked id the place with that id, else the places of the post with that id; ``matched_by`` tells which."""
    by_id = asked.join(places, F.col(asked_col) == F.col(id_col)).withColumn("matched_by", F.lit("id"))
    rest = asked.join(by_id.select(F.col(asked_col).alias("__found__")).distinct(), F.col(asked_col) == F.col("__found__"), "left_anti")
    by_post = rest.join(places, F.col(asked_col) == F.col(post_col)).withColumn("matched_by", F.lit("post"))
    return by_id.unionByName(by_post)


def categories(places: DataFrame, search: str = "", city: str = "", c: Columns = Columns()) -> DataFrame:
    """Distinct categories that aren't blank; ``search`` is plain text here, without wildcards."""
    rows = places.where(F.col(c.category).isNotNull())
    if city.strip():
        rows = rows.where(like_any_case(c.city, city.strip()))
    out = rows.select(F.col(c.category).alias("category")).distinct().where(~is_blank("category"))
    return out.where(contains_text("category", search.strip())) if search.strip() else out


def cities(table: DataFrame, search: str = "", name: str = "name") -> DataFrame:
    return table.where(like_any_case(name, search.strip())) if search.strip() else table


def saved_page(saved: DataFrame, places: DataFrame, user_id: object, page: Page, sort_by: str = "saved_at", ascending: bool = False, compat: bool = False, c: Columns = Columns(), **filters) -> DataFrame:
    """Saved places of a user with ``saved_at``.

    With ``compat`` the page is cut from the saved rows first, by time saved, and the filters then act on that
    page, so it may hold fewer rows than the limit. Else filters come first and every page is full.
    ``saved`` has ``user_id, place_id, created_at``, one row per user and place.
    """
    own = saved.where(F.col("user_id") == F.lit(user_id)).select(F.col("place_id").alias("__place__"), F.col("created_at").alias("saved_at"))
    allowed = {"name": c.name, "category": c.category, "city": c.city, "saved_at": "saved_at"}
    if compat:
        own = paged(own, sort_keys("saved_at", ascending, {"saved_at": "saved_at"}, "saved_at", "__place__"), page)
        joined = filtered(places.join(own, F.col(c.id) == F.col("__place__")), c=c, **filters)
        return joined.drop("__place__")
    joined = filtered(places.join(own, F.col(c.id) == F.col("__place__")), c=c, **filters)
    return paged(joined, sort_keys(sort_by, ascending, allowed, "saved_at", c.id), page).drop("__place__")


def owned_lists(lists: DataFrame, user_id: object, owner: str = "user_id", created: str = "created_at", key: str = "id") -> DataFrame:
    """A user's lists, the newest first."""
    return lists.where(F.col(owner) == F.lit(user_id)).orderBy(F.col(created).desc_nulls_first(), F.col(key))


def distinct_places(extracted: DataFrame, group: list[str], order: list[str], name: str = "name", city: str = "city") -> DataFrame:
    """The first of extracted places with the same name and city (trimmed, in any case) in each group; places without a name go."""
    named = extracted.where(F.coalesce(F.col(name) != "", F.lit(False)))
    keyed = named.withColumn("__name__", text_key(name)).withColumn("__city__", text_key(F.coalesce(F.col(city), F.lit(""))))
    first = F.min_by(F.struct(*extracted.columns), F.struct(*order)).alias("__row__")
    return keyed.groupBy(*group, "__name__", "__city__").agg(first).select("__row__.*")


def new_rows(candidates: DataFrame, existing: DataFrame, keys: list[str], any_case: bool = True) -> DataFrame:
    """Candidates whose keys don't exist yet (by trimmed text in any case, or exactly), each once."""
    norm = (lambda k: text_key(F.coalesce(F.col(k), F.lit("")))) if any_case else F.col
    there = existing.select(*[norm(k).alias(f"__{k}__") for k in keys]).distinct()
    marked = candidates.select("*", *[norm(k).alias(f"__{k}__") for k in keys])
    marks = [f"__{k}__" for k in keys]
    return marked.join(there, marks, "left_anti").dropDuplicates(marks).drop(*marks)
