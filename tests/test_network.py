"""Registered queries against their SQL, and rules that results must keep."""

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tramline.oracle import QUERIES as SQL
from tramline.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    def value(x):
        if not isinstance(x, (list, tuple, dict)) and pd.isna(x):
            return None
        return int(x) if isinstance(x, float) and x == int(x) else round(x, 6) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(value, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        want = db.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_journeys_keep_their_rules(spark):
    found = QUERIES["journey_plan"](spark, SMALL).toPandas()
    assert set(found["od_id"]) == set(range(0, 150, 20))
    for _, own in found.groupby("od_id"):
        assert sorted(own["n"]) == list(range(1, len(own) + 1))
        rides = own[~own["kind"].isin(["walk", "none"])]
        assert (rides["fare"] >= 5).all() and (rides["boardings"] >= 1).all() and (rides["minutes"] > 0).all()
        assert not rides.duplicated(["routes", "fare", "minutes"]).any()
        assert own["reason"].notna().sum() == (own["kind"] == "none").sum()
        by_kind = rides.drop_duplicates("kind").set_index("kind")
        if {"partial"} & set(by_kind.index):
            assert not {"recommended", "fastest", "cheapest"} & set(by_kind.index)
