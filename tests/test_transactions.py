import random

import pytest

from logstrata.model import OPS, TXN
from logstrata.operators import transactions as tx


def frames(spark, ops, txns):
    return spark.createDataFrame(ops, OPS), spark.createDataFrame(txns, TXN)


def got(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_isolation(spark):
    ops, txns = frames(spark, [(1, 0, "PUT", "a", "1"), (2, 0, "PUT", "a", "2"), (3, 0, "PUT", "b", "3"), (4, 0, "PUT", "c", "4"), (4, 1, "DELETE", "a", None)], [(1, "COMMITTED", 1), (2, "ABORTED", 2), (3, "COMMITTED", 9), (4, "ACTIVE", 4)])
    assert got(tx.read_uncommitted(ops, txns)) == {"b": "3", "c": "4"}
    assert got(tx.read_committed(ops, txns, 4)) == {"a": "1", "b": "3"}
    assert got(tx.repeatable_read(ops, txns, 4, 5)) == {"a": "1"}
    assert got(tx.read_committed(ops, txns, 2)) == {"a": "1"}
    assert got(tx.own_view(ops, txns, 4)) == {"b": "3", "c": "4"}


def test_replay_needs_commit(spark):
    rows = [(1, 1, "PUT", "k0", "v"), (2, 2, "PUT", "k1", "v"), (3, 2, "COMMIT", None, None), (4, 3, "PUT", "k2", "v"), (5, 3, "ROLLBACK", None, None), (6, 4, "PUT", "k3", "v"), (7, 4, "COMMIT", None, None)]
    wal = spark.createDataFrame(rows, "seq long, txn_id long, op string, key string, value string")
    assert sorted(got(tx.replay(wal))) == ["k1", "k3"]
    assert sorted(got(tx.replay(wal, 2))) == ["k3"]
    assert sorted(got(tx.replay(wal, 0, spark.createDataFrame([(4,)], "txn_id long")))) == ["k1"]


def test_checkpoint(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "txn_id long")
    assert tx.checkpoint_id(ids(3, 4, 5, 8, 9, 5)).first()[0] == 5
    assert tx.checkpoint_id(ids()).first()[0] is None
    assert sorted(r[0] for r in tx.compressed_ids(ids(3, 4, 5, 8, 9)).collect()) == [5, 8, 9]


def outcomes(ops, txns):
    writes = {}
    for t, _, _, k, _ in ops:
        writes.setdefault(t, set()).add(k)
    done, out = {}, {}
    for t, _, _ in sorted((x for x in txns if x[1] == "COMMITTED"), key=lambda x: (x[2], x[0])):
        bad = any(done.get(k, 0) > t for k in writes.get(t, ()))
        out[t] = "ABORTED" if bad else "COMMITTED"
        if not bad:
            for k in writes.get(t, ()):
                done[k] = max(done.get(k, 0), t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_commit_outcomes_against_model(spark, seed):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(seed)
    txns = [(t, "ABORTED" if rng.random() < 0.1 else "COMMITTED", t + rng.randrange(12)) for t in range(1, 80)]
    ops = [(t, i, "PUT", f"k{rng.randrange(12)}", "v") for t, _, _ in txns for i in range(3)]
    assert {r["txn_id"]: r["outcome"] for r in tx.commit_outcomes(*frames(spark, ops, txns)).collect()} == outcomes(ops, txns)


def test_watermark(spark):
    _, txns = frames(spark, [], [(1, "COMMITTED", 1), (2, "ACTIVE", 2), (5, "ACTIVE", 2)])
    assert tx.watermark(txns).first()[0] == 2
    assert tx.watermark(txns.where("state = 'COMMITTED'")).first()[0] == 2
