import random

import pytest

from logstrata.functions import blocks, bloom
from logstrata.model import LOG, Config
from logstrata.plans import layout
from logstrata.session import Crash, Database
from logstrata.sources import wal
from logstrata.sources.storage import Store


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rng, rows = random.Random(3), []
    assert store.read().count() == 0
    for part in range(5):
        new = [(f"k{rng.randrange(30):02d}", None if rng.random() < 0.2 else f"v{part}-{i}", part * 40 + i + 1) for i in range(40)]
        rows += new
        store.append(spark.createDataFrame(new, LOG))
    want = {}
    for k, v, _ in sorted(rows, key=lambda r: r[2]):
        want[k] = v
    live = {k: v for k, v in want.items() if v is not None}
    read = lambda version=0: {r["key"]: r["value"] for r in store.read(version).collect()}
    assert read() == live and len(store.runs()) == 5
    assert store.compact(10**9) == [0] and [r["level"] for r in store.runs()] == [1]
    assert read() == live and store.log().count() == len(want)
    key = next(iter(live))
    assert store.get(key).first()["value"] == live[key] and store.get("nope").count() == 0
    store.vacuum()
    assert read() == live
    assert layout.level_plan(store.manifest()).first()["n_runs"] == 1
    store.truncate()
    assert store.read().count() == 0


def test_zone_maps_prune_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "z"))
    for low in (100, 200, 300):
        store.append(spark.createDataFrame([(f"a{i}", "v", i) for i in range(low, low + 100)], LOG))
    assert [(r["first_key"], r["last_key"]) for r in reversed(store.runs())] == [("a100", "a199"), ("a200", "a299"), ("a300", "a399")]
    assert len(store.log("a250", "a260").inputFiles()) < len(store.log().inputFiles())
    assert layout.prune(store.manifest(), "a250").count() == 1


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "d"))
    db.put_batch([("a", "1"), ("b", "2"), ("a", "3")])
    assert db.get("a") == "3" and db.get("zz") is None
    one = db.begin()
    one.put("a", "mine")
    assert one.get("a") == "mine" and db.get("a") == "3"
    db.put("a", "theirs")
    assert one.commit() is False and db.get("a") == "theirs"
    two = db.begin("REPEATABLE_READ")
    assert two.get("b") == "2"
    db.remove("b")
    assert two.get("b") == "2" and two.commit() and two.commit() and not two.abort()
    assert [r["key"] for r in db.scan().collect()] == ["a"]
    again = Database(spark, str(tmp_path / "d"))
    assert again.next_id > 1 and again.get("a") == "theirs"


def test_wal_files(spark, tmp_path):
    rows = [(i, i // 10 + 1, "PUT", "k", "v") for i in range(60)]
    path = str(tmp_path / "wal")
    wal.append(spark.createDataFrame(rows, wal.WAL), path, 20)
    assert wal.read(spark, path).count() == 60
    assert wal.collect_garbage(spark, path, 2) == [0]
    assert wal.read(spark, path).count() == 40


def test_block_format():
    entries = [(f"key{i}".encode() if i else b"apple", b"x" * (4 + i), i) for i in range(5)]
    assert blocks.decode(blocks.encode(entries)) == entries
    broken = bytearray(blocks.encode(entries))
    broken[3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        blocks.decode(bytes(broken))


def test_blocks_close_on_a_new_key(spark):
    rows = [(0, f"k{i // 3:02d}", "v" * 20, i) for i in range(90)]
    got = layout.block_layout(spark.createDataFrame(rows, "run_id long, key string, value string, version long"), 200).orderBy("block").collect()
    assert sum(r["n_rows"] for r in got) == 90
    assert all(a["last_key"] < b["first_key"] for a, b in zip(got, got[1:], strict=False)) and all(r["bytes"] >= 200 for r in got[:-1])


def test_bloom(spark):
    bits, hashes = bloom.sizes(1000, 0.1)
    rows = spark.createDataFrame([(i % 2, f"key{i}") for i in range(2000)], "run_id long, key string")
    filters = bloom.build(rows, "run_id", bits, hashes)
    there = bloom.probe(filters, "run_id", rows.select("key"), bits, hashes)
    assert rows.join(there, ["run_id", "key"], "left_anti").count() == 0
    absent = spark.createDataFrame([(f"other{i}",) for i in range(1000)], "key string")
    assert bloom.probe(filters, "run_id", absent, bits, hashes).count() <= 2 * 200


def test_levels_cache_and_config():
    assert layout.due_levels({0: 4, 1: 7, 2: 12}) == [0, 2] and layout.target_bytes(2) == (4 << 20) * 16
    assert layout.hit_rate([1, 1, 2, 2, 3, 3, 1, 2, 3], 3) == pytest.approx(2 / 3)
    assert Config.of({"block_bytes": 1, "other": 2}) == Config(block_bytes=1)


def test_values_apart(spark, tmp_path):
    """Large values lie in files of their own; compaction and collection lose none that is read."""
    store = Store(spark, str(tmp_path / "v"), Config(separate_from=5), values_apart=True)
    store.append(spark.createDataFrame([("a", "long value 1", 1), ("b", "tiny", 2), ("c", "another long one", 3), ("d", "d" * 40, 4)], LOG))
    store.append(spark.createDataFrame([("a", "long value 2", 5), ("c", None, 6), ("é", "ééé", 7)], LOG))
    want = {"a": "long value 2", "b": "tiny", "d": "d" * 40, "é": "ééé"}
    read = lambda version=0: {r["key"]: r["value"] for r in store.read(version).collect()}
    assert read() == want and read(4) == {"a": "long value 1", "b": "tiny", "c": "another long one", "d": "d" * 40}
    assert store.get("a").first()["value"] == "long value 2" and store.get("c").count() == 0 and store.log().count() == 7
    store.compact(10, 0)
    files = {v for r in store.runs() for v in r["values"]}
    store.collect_values()
    store.vacuum()
    assert read() == want and len(files) == 2 and [len(r["values"]) for r in store.runs()] == [1]


def test_a_hot_key_spreads_over_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "h"), Config(run_bytes=20_000))
    store.append(spark.range(1, 20_001).selectExpr("'hot' AS key", "sha2(cast(id AS string), 256) AS value", "id AS version").repartition(4))
    assert len(store.log().inputFiles()) > 1 and store.get("hot").first()["version"] == 20_000


def test_recovery_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "c")
    db = Database(spark, path)
    db.put("a", "1")
    one, two = db.begin(), db.begin()
    one.put("a", "2")
    one.remove("zz")
    two.put("b", "lost")
    with pytest.raises(Crash):
        one.commit(crash=True)
    assert db.get("a") == "1"
    again = Database(spark, path)
    assert again.get("a") == "2" and again.get("b") is None and again.next_id > one.txn_id
    count = again.store.log().count()
    assert Database(spark, path).store.log().count() == count
    assert again.flush() == [1] and dict(again.items()) == {"a": "2"}


def test_isolation_levels(spark, tmp_path):
    db = Database(spark, str(tmp_path / "i"))
    db.put("a", "1")
    with pytest.raises(ValueError, match="isolation"):
        db.begin("SNAPSHOT")
    dirty, other, clean, serial = db.begin("READ_UNCOMMITTED"), db.begin("READ_UNCOMMITTED"), db.begin("READ_COMMITTED"), db.begin("SERIALIZABLE")
    dirty.put("a", "seen")
    assert other.get("a") == "seen" and clean.get("a") == serial.get("a") == "1"
    other.put("a", "newer")
    dirty.put("a", "late")  # a larger id has written it: this one is out at once
    assert dirty.state == "ABORTED" and not dirty.commit() and dirty.get("a") is None
    assert other.abort() and db.begin("READ_UNCOMMITTED").get("a") == "1"
    serial.put("a", "kept")
    assert serial.commit() and db.get("a") == "kept"
    clean.put("a", "too late")
    assert not clean.commit() and db.get("a") == "kept"
