"""Rights for all users at once against the rules of one user."""

from __future__ import annotations

import random

import pytest

from placeloom.operators import audience, policy

USERS = [None, 1, 2, 3, 4, 99]
ACTIONS = ["insert", "update", "delete"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    user = lambda: rng.choice([None, 1, 2, 3, 4])
    make = lambda schema, rows: spark.createDataFrame(rows, schema).repartition(2).cache()
    lists = [(k, user(), rng.choice([True, False, False, None])) for k in range(12)]
    helpers = [(k, rng.randrange(14), user(), rng.choice(["editor", "viewer", None])) for k in range(40)]
    return {
        "lists": make("id long, user_id long, is_public boolean", lists + [lists[3]]),
        "list_collaborators": make("id long, list_id long, user_id long, role string", helpers + helpers[:3]),
        "list_places": make("id long, list_id long, place_id long", [(k, rng.choice([None, *range(14)]), k % 5) for k in range(50)] + [(0, 1, 0)]),
        "guides": make("id long, is_published boolean", [(k, rng.choice([True, False, None])) for k in range(6)]),
        "guide_places": make("id long, guide_id long", [(k, rng.choice([None, *range(8)])) for k in range(20)]),
        "saved_places": make("id long, user_id long", [(k, user()) for k in range(20)]),
        "follows": make("id long, follower_id long, following_id long", [(k, user(), user()) for k in range(10)]),
        "waitlist": make("id long, email string", [(1, "a@example.org"), (2, None)]),
        "profiles": make("id long, display_name string", [(1, "a"), (2, None), (None, "c")]),
        **{t: make("id long, user_id long", [(k, user()) for k in range(5)]) for t in ("cities", "places", "social_posts")},
    }


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("table", ["lists", "list_places", "list_collaborators", "guides", "guide_places", "saved_places", "follows", "waitlist", "profiles", "places"])
def test_readers(tables, table):
    found = audience.readers(table, tables).cache()
    assert found.where("audience = 'user'").count() == found.where("audience = 'user' AND reader IS NOT NULL").count()
    for uid in USERS:
        for email in (None, "an.admin@example.org"):
            assert _rows(audience.as_user(found, uid, email is not None)) == _rows(policy.visible(table, tables, uid, email)), (table, uid, email)


@pytest.mark.parametrize("table", ["lists", "list_places", "list_collaborators", "guides", "saved_places", "follows", "waitlist", "profiles", "social_posts", "cities"])
def test_writers(tables, table):
    for action in ACTIONS:
        found = audience.writers(table, action, tables[table], tables).cache()
        for uid in USERS:
            assert _rows(audience.as_user(found, uid)) == _rows(policy.may_write(table, action, tables[table], tables, uid)), (table, action, uid)


def test_rows_for_all_are_not_multiplied(tables):
    found = audience.readers("list_places", tables)
    assert found.where("audience = 'all'").count() == policy.visible("list_places", tables, None).count()
    users = tables["lists"].sparkSession.createDataFrame([(u,) for u in (1, 2, 99, None, 1)], "who long")
    assert {r["reader"]: r["rows"] for r in audience.reach(found, users, "who").collect()} == {u: policy.visible("list_places", tables, u).count() for u in (1, 2, 99)}


def test_empty_tables_and_ids_of_text(spark, tables):
    none = {k: v.where("false") for k, v in tables.items()}
    for t in none:
        assert audience.readers(t, none).count() == 0
    texts = {**tables, **{t: tables[t].withColumn("user_id", tables[t]["user_id"].cast("string")) for t in ("lists", "list_collaborators")}}
    for t in ("lists", "list_places", "list_collaborators"):
        assert _rows(audience.as_user(audience.readers(t, texts), "2")) == _rows(policy.visible(t, texts, "2"))
