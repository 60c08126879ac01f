"""Queries against replays of the whole log in plain Python, beside their SQL."""

import pytest

from logstrata import fixtures as fx
from logstrata.queries import QUERIES


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return sorted((r.asDict() for r in fx.events(spark, sf_dir).collect()), key=lambda r: r["version"])


def test_list_range_folds_pops(spark, sf_dir, events):
    held = {}
    for r in events:
        values = held.setdefault(r["key"], [])
        if r["event_type"] == "click":
            values.insert(0, r["props"])
        elif r["event_type"] == "view":
            values.append(r["props"])
        elif r["event_type"] in ("error", "purchase") and values:
            values.pop(0 if r["event_type"] == "error" else -1)
    want = [(k, pos, v) for k, values in held.items() for pos, v in enumerate(values) if 1 <= pos <= len(values) - 2]
    got = [(r["key"], r["pos"], r["value"]) for r in QUERIES["list_range"](spark, sf_dir).collect()]
    assert want and sorted(got) == sorted(want)


def test_flushall_epoch_has_every_increment(spark, sf_dir, events):
    want, epoch = [], 0
    for r in events:
        if r["event_type"] == "click":
            want.append((r["key"], r["version"], "INCR", epoch))
        epoch += r["event_type"] == "signup" and r["event_id"] % 100 == 0
    got = [tuple(r[c] for c in ("key", "seq", "cmd", "epoch")) for r in QUERIES["flushall_epoch"](spark, sf_dir).collect()]
    assert want and sorted(got) == sorted(want)


def test_as_of_probe_join_has_every_probe(spark, sf_dir, events):
    want = []
    for r in events:
        at = r["event_id"] // 2
        seen = [x for x in events if x["key"] == r["key"] and x["version"] <= at]
        value = seen[-1]["props"] if seen and seen[-1]["event_type"] != "error" else None
        want.append((r["event_id"], r["key"], at, value, seen[-1]["version"] if seen else 0))
    got = [tuple(r[c] for c in ("probe_id", "key", "probe_version", "value", "version")) for r in QUERIES["as_of_probe_join"](spark, sf_dir).collect()]
    assert want and sorted(got, key=repr) == sorted(want, key=repr)


def test_a_few_keys_are_a_filter_on_the_scan(spark, tmp_path):
    """No shuffle of the log for a few keys, and what is asked of a store reaches Parquet."""
    from logstrata.operators import resolve
    from logstrata.sources.storage import Store

    store = Store(spark, str(tmp_path / "s"))
    store.append(spark.range(1, 2001).selectExpr("concat('k', id % 50) AS key", "cast(id AS string) AS value", "id AS version"))
    keys = spark.createDataFrame([(0, "k7"), (1, "none"), (2, "k7")], "ord long, key string")
    asked = resolve.multi_get(store.log(), keys)
    assert sorted(map(tuple, asked.collect())) == [(0, "k7", "1957"), (1, "none", None), (2, "k7", "1957")]
    assert sorted(map(tuple, resolve.multi_get(store.log(), keys, most=1).collect())) == sorted(map(tuple, asked.collect()))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [k7,none])" in plan.replace(" ", "").replace("In(key,[", "In(key, [")
    plan = store.get("k7", 900)._jdf.queryExecution().executedPlan().toString()
    # the plan shortens the list after the bounds of the key
    assert "GreaterThanOrEqual(key,k7), LessThanOrEqual(key,k7), LessTha" in plan and "ReadSchema: struct<key:string,value:string,version:bigint" in plan
