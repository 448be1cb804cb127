"""Stages that need an outside service, as interfaces with rule-based stand-ins.

The stand-ins are no models: they make the pipeline run and tests repeat. Each stage only gets what
isn't known yet, by distinct keys, so a slow service sees each key once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import either, handle, handle_city, handle_name, keyword_category, text_key

#: Maps batches of distinct keys to batches with results, as ``mapInPandas`` does.
BatchService = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def by_distinct_key(rows: DataFrame, keys: list[str], service: BatchService, schema: str) -> DataFrame:
    """Rows with a service's result columns; the service gets each key once. ``schema`` has the keys and the results."""
    found = rows.select(*keys).distinct().mapInPandas(service, schema)
    side = found.select(*[F.col(k).alias(f"__{k}__") for k in keys], *[c for c in found.columns if c not in keys])
    return rows.join(side, [F.col(k).eqNullSafe(F.col(f"__{k}__")) for k in keys], "left").drop(*[f"__{k}__" for k in keys])


def geocode(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Forward lookup by name and city, else by city: ``found_latitude, found_longitude, found_address, found_neighborhood``, null if unknown.

    ``gazetteer`` has ``name`` ('' for a city's centre), ``city, latitude, longitude, address, neighborhood``, one row per name and city.
    """
    fields = ["latitude", "longitude", "address", "neighborhood"]
    keyed = gazetteer.select(text_key("name").alias("n"), text_key("city").alias("c"), F.struct(*fields).alias("s"))
    exact, centre = keyed.withColumnRenamed("s", "exact"), keyed.where("n = ''").select(F.col("c").alias("c2"), F.col("s").alias("centre"))
    marked = places.withColumn("__n__", text_key("name")).withColumn("__c__", text_key(F.coalesce("city", F.lit(""))))
    joined = marked.join(exact, (F.col("__n__") == F.col("n")) & (F.col("__c__") == F.col("c")), "left").join(centre, F.col("__c__") == F.col("c2"), "left")
    hit = F.coalesce("exact", "centre")
    return joined.select(*places.columns, *[hit[f].alias(f"found_{f}") for f in fields])


def reverse_geocode(points: DataFrame, gazetteer: DataFrame, cell: float = 0.01, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """``found_neighborhood`` of the gazetteer's entry that is nearest in the cell or the eight around it, or ''. Coordinates of 0 count as missing.

    Cells bound the join; entries are reduced to one per neighborhood and cell first.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    entries = gazetteer.where("neighborhood is not null").groupBy(at("latitude").alias("a"), at("longitude").alias("b"), F.col("neighborhood").alias("__hood__")).agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    around = F.array(*[F.struct((F.col("a") + i).alias("a"), (F.col("b") + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    entries = entries.select(F.explode(around).alias("at"), "__hood__", "lat", "lon").select("at.a", "at.b", "__hood__", "lat", "lon")
    entries = entries.groupBy("a", "b").agg(F.collect_list(F.struct("__hood__", "lat", "lon")).alias("hoods"))
    known = points.withColumn("__a__", F.when(F.col(latitude) != 0, at(latitude))).withColumn("__b__", F.when(F.col(longitude) != 0, at(longitude)))
    joined = known.join(entries, (F.col("__a__") == F.col("a")) & (F.col("__b__") == F.col("b")), "left")
    away = lambda h: (h["lat"] - F.col(latitude)) * (h["lat"] - F.col(latitude)) + (h["lon"] - F.col(longitude)) * (h["lon"] - F.col(longitude))
    nearest = F.array_min(F.transform("hoods", lambda h: F.struct(away(h).alias("d"), h["__hood__"].alias("h"))))["h"]
    return joined.select(*points.columns, F.coalesce(nearest, F.lit("")).alias("found_neighborhood"))


def saved_place(places: DataFrame) -> DataFrame:
    """The row that is saved of a geocoded place: what was given goes before what was found; missing texts are '' and the category is 'Restaurants'."""
    text = lambda c: F.coalesce(either(c), F.lit(""))
    return places.select(
        F.trim("name").alias("name"), F.coalesce(either("address", "found_address"), F.lit("")).alias("address"), text("city").alias("city"), either("neighborhood", "found_neighborhood").alias("neighborhood"),
        F.coalesce(either("category"), F.lit("Restaurants")).alias("category"), text("description").alias("description"), text("creator_handle").alias("creator_handle"), F.col("found_latitude").alias("latitude"), F.col("found_longitude").alias("longitude"),
    )


def places_by_rule(posts: DataFrame, key: str = "id", mentions: str = "mentions", text: str = "text", author: str = "author") -> DataFrame:
    """Places that venue handles name: ``key, name, city, category, creator_handle, confidence`` (0.5); handles without a city are no places."""
    one = posts.select(key, F.explode(mentions).alias("m"), text, author)
    found = one.where(handle_city("m").isNotNull())
    return found.select(key, handle_name("m").alias("name"), handle_city("m").alias("city"), keyword_category(text).alias("category"), handle(author).alias("creator_handle"), F.lit(0.5).alias("confidence"))
