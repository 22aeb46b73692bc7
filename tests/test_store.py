"""Stores laid out for lookups."""

import random

import pytest
from conftest import rows

from strandmill.sources.lookup_store import open_lookup_store, write_lookup_store

ROWS = "k string, g int, v long, w string"


def data():
    rng = random.Random(1)
    out = [(rng.choice(["hot", "a", "b\x1f0", "b", "\x1e", "c\x1e1", f"k{i % 37}"]), i % 3, i, "w") for i in range(400)]
    return out + [("hot", 1, 1000 + i, "w") for i in range(300)] + [(None, 1, 5000, "w"), ("a", None, 5001, "w"), ("", 0, 5002, "w")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
@pytest.mark.parametrize("hot_rows", [10**6, 60])
def test_lookups_equal_joins(spark, tmp_path, keys, hot_rows):
    path = str(tmp_path / "store")
    df = spark.createDataFrame(data(), ROWS)
    write_lookup_store(df, path, keys, ["v"], buckets=5, hot_rows=hot_rows)
    # An earlier session's store is opened from its layout alone.
    for session in (spark, spark.newSession()):
        store = open_lookup_store(session, path)
        assert bool(store.hot) == (hot_rows == 60)
        assert rows(store.table) == rows(df)
        wanted = df.select(*keys).distinct().where("k in ('hot', 'b', 'c\x1e1', '', 'k3') or k is null")
        extra = [(*r, i) for i, r in enumerate(wanted.collect())]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", x int"
        wanted = session.createDataFrame(extra, schema)
        other = session.createDataFrame(data(), ROWS)
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = store.lookup(wanted, how)
            assert rows(got.select(sorted(got.columns))) == rows(other.join(wanted, keys, how).select(sorted(got.columns)))
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = plan_of(store.lookup(wanted))
        finally:
            session.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # Only what is looked up is moved.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_points_open_few_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame(data(), ROWS)
    write_lookup_store(df, path, ["k"], ["v"], buckets=16, hot_rows=60)
    store = open_lookup_store(spark, path)
    for keys in ([["hot"]], [["b\x1f0"], ["\x1e"], ["nothing"]]):
        got = store.points(*keys)
        assert rows(got) == rows(df.where(df.k.isin([k[0] for k in keys])))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # to see the buckets in the plan
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan_of(store.points(["a"]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    with pytest.raises(Exception, match="(?i)exist"):
        write_lookup_store(df, path, ["k"], ["v"])
