"""Fixtures with known answers, and seeded models."""

import random

import pytest

from logstrata.model import LOG, log_rows
from logstrata.operators import merge, resolve


@pytest.fixture
def log(spark):
    return lambda *rows: log_rows(spark.createDataFrame([(k, v, n) for k, v, n in rows], LOG))


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def model(rows, version=None):
    out = {}
    for k, v, n in sorted(rows, key=lambda r: r[2]):
        if version is None or n <= version:
            out[k] = v or None
    return sorted((k, v) for k, v in out.items() if v is not None)


def test_put_overwrite_remove(log):
    rows = [("k1", "value1", 1), ("k1", "new_value", 2), ("k1", None, 3)]
    assert pairs(resolve.latest(log(*rows[:2]))) == [("k1", "new_value")]
    assert pairs(resolve.latest(log(*rows))) == []
    assert resolve.latest(log(*rows), tombstones=True).count() == 1


def test_empty_value_is_a_tombstone_and_empty_keys_are_refused(log, spark):
    assert pairs(resolve.latest(log(("a", "x", 1), ("a", "", 2)))) == []
    with pytest.raises(Exception, match="needs a key"):
        log(("", "x", 1)).collect()
    with pytest.raises(Exception, match="needs a key"):
        log(("a", "x", 0)).collect()


def test_empty_log(log, spark):
    none = log_rows(spark.createDataFrame([], LOG))
    assert resolve.latest(none).count() == merge.retain(none, 5).count() == 0
    assert pairs(resolve.multi_get(none, spark.createDataFrame([(0, "a")], "ord long, key string"))) == [("a", None)]


def test_versions(log):
    rows = log(("mvcc_key", "version_1", 1000), ("mvcc_key", "version_2", 2000), ("mvcc_key", "version_3", 3000))
    assert pairs(resolve.as_of(rows, 999)) == []
    assert [pairs(resolve.as_of(rows, v))[0][1] for v in (1000, 1999, 2000, 3000, 13000)] == ["version_1", "version_1", "version_2", "version_3", "version_3"]


def test_block_as_of(log):
    rows = [("key0", "v0", 1), ("key1", "v1", 1), ("key2", "value22", 10), ("key2", "value2", 2), ("key3", "value3", 3)]
    rows += [("key4", f"value{'4' * n}", v) for n, v in ((1, 4), (2, 7), (3, 8), (4, 9))] + [("key5", f"value{'5' * n}", v) for n, v in ((1, 5), (2, 6), (3, 7), (4, 8))] + [("key6", "value6", 6)]
    inside = resolve.between(log(*rows), "key2", "key7")
    assert [v for _, v in pairs(resolve.as_of(inside, 6))] == ["value2", "value3", "value4", "value55", "value6"]
    assert [v for _, v in pairs(resolve.as_of(inside, 7))][:3] == ["value2", "value3", "value44"]


def test_prefix_and_ranges(log):
    words = {"a": "0", "ab": "1", "abc": "33", "abcd": None, "abcde": "5", "abcdef": "6", "abcdefg": "7", "abcdefgh": "8", "b": "9"}
    rows = [(k, "old", 1) for k in words] + [(k, v, 2) for k, v in words.items()] + [("ab", None, 3)]
    assert pairs(resolve.latest(resolve.prefixed(log(*rows), "ab"))) == [("abc", "33"), ("abcde", "5"), ("abcdef", "6"), ("abcdefg", "7"), ("abcdefgh", "8")]
    many = log(*[(f"key{i:04d}", str(i), 1) for i in range(1000, 1030)], ("key1015", None, 2))
    found = pairs(resolve.latest(resolve.between(many, "key1010", "key1020")))
    assert len(found) == 9 and found[5][0] == "key1016"


def test_three_tables(log):
    old = log(("key1", "value1", 1), ("key2", "value2", 2), ("key3", "value3", 3))
    mid = log(("key2", "value2_new", 4), ("key4", "value4", 5), ("key3", None, 6))
    new = log(("key1", "value1_new", 7), ("key2", "value2_final", 8), ("key5", "value5", 9))
    assert pairs(resolve.live(merge.merge_runs(old, mid, new))) == [("key1", "value1_new"), ("key2", "value2_final"), ("key4", "value4"), ("key5", "value5")]


def test_overlay_hides_deleted(log):
    upper, lower = log(("a", None, 5), ("b", "2", 6)), log(("a", "1", 1), ("c", "3", 2))
    assert [(r["key"], r["source"]) for r in merge.overlay(upper, lower).orderBy("key").collect()] == [("b", "upper"), ("c", "lower")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_model(log, spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(40)}", None if rng.random() < 0.25 else f"v{i}", i) for i in range(1, 500)]
    df = log(*rows).cache()
    assert pairs(resolve.latest(df)) == model(rows)
    for v in (1, 100, 333):
        assert pairs(resolve.as_of(df, v)) == model(rows, v)
    kept = merge.retain(df, 250).cache()
    assert kept.count() < 499
    for v in (250, 300, 499):  # retention changes no read at or above the watermark
        assert pairs(resolve.as_of(kept, v)) == model(rows, v)
    probes = [(i, f"k{rng.randrange(45)}", rng.randrange(1, 600)) for i in range(100)]
    for width in (7, 1 << 20):
        got = {r["probe_id"]: r["value"] for r in resolve.probe(df, spark.createDataFrame(probes, "probe_id long, key string, version long"), width).collect()}
        assert got == {i: dict(model(rows, v)).get(k) for i, k, v in probes}


def test_value_separation_round_trip(log):
    rows = [(f"k{i:03d}", "x" * (10 if i % 2 == 0 else 128), i) for i in range(1, 201)]
    kept, values = merge.separate(log(*rows), 12)
    assert values.count() == 100 and kept.where("pointer is not null").count() == 100
    assert sorted((r["key"], r["value"], r["version"]) for r in merge.resolve_values(kept, values).collect()) == sorted(rows)
    placed = merge.offsets(values, 16).orderBy("version").collect()
    at = 0
    for r in placed:
        assert r["offset"] == at
        at += 4 + 128 + 10


def test_sizes(log):
    rows = [("ab", "xyz", 1), ("c", None, 2)]
    assert log(*rows).agg({"version": "max"}).first()[0] == 2
    from pyspark.sql import functions as F

    assert log(*rows).agg(F.sum(merge.record_bytes())).first()[0] == 2 + 3 + 8 + 1 + 8


def test_python_predicate_and_config(log, tmp_path):
    from logstrata.model import Config

    rows = log(*[(f"key{i:02d}", str(i), 1) for i in range(100)])
    found = resolve.matching_function(rows, lambda k: 1 if int(k[3:]) < 20 else -1 if int(k[3:]) > 60 else 0)
    assert found.count() == 41
    (tmp_path / "c.toml").write_text("[sizes]\nrun_bytes = 5\n[other]\nname = 'x'\n")
    assert Config.read(str(tmp_path / "c.toml")) == Config(run_bytes=5)
