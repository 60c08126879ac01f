"""The pipeline's near stage against the similarity of every pair."""

import random

import pytest


def near_model(rows):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both * 9 >= 4 * (len(sets[a]) + len(sets[b])) and both:
                root[find(a)] = find(b)
    kept = {}
    for i, r in enumerate(rows):
        kept[find(i)] = min(kept.get(find(i), r), r)
    return sorted(kept.values())


@pytest.mark.parametrize("block", [1024, 5])
def test_near_stage_reaches_similarity_four_fifths(spark, block, monkeypatch):
    import corpus_pipeline
    from logstrata.llm import simhash

    rng, rows = random.Random(5), []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 7, 30, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    rows += [(len(rows), ""), (len(rows) + 1, " "), (len(rows) + 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = simhash.representatives
    monkeypatch.setattr(simhash, "representatives", lambda d: whole(d, block=block))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect())
    want = [i for i, _ in near_model([(i, t or "") for i, t in rows])]
    assert got == want and len(want) < len(rows)


def test_repeated_rows_and_ids(spark):
    """One row of each component, also where ids repeat or are missing and where columns clash."""
    import corpus_pipeline

    a, b = ("one two three four five six seven eight nine ten eleven twelve", "other words that have nothing to do with the first text at all")
    rows = [(3, b, "x"), (5, a, "x"), (5, b, "x"), (9, a, "x"), (None, a, "x"), (None, a, "y"), (None, "a third text alone", "x"), (None, "a third text alone", "z"), (7, "a third text alone indeed", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS row", "4 AS _row", "5 AS rows")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, b), (5, a), (None, "a third text alone"), (7, "a third text alone indeed")], key=repr)


def test_pruning_keeps_what_is_near():
    """Wide fingerprints of sets at similarity 0.8 stay well within the limit; those of others mostly don't."""
    import numpy as np

    from logstrata.llm import simhash

    rng = np.random.default_rng(6)
    for n in (simhash.FEW, 100, 1000):
        for _ in range(40):
            marks = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            part = marks[: -(-n * 8 // 9)]
            mate = np.unique(np.concatenate([part, rng.integers(0, 1 << 63, n - len(part), dtype=np.uint64)]))
            apart = int(np.bitwise_count(simhash.wide(np.unique(marks)) ^ simhash.wide(mate)).sum())
            assert apart <= simhash.FAR - 8
            other = simhash.wide(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            assert int(np.bitwise_count(simhash.wide(marks) ^ other).sum()) > simhash.FAR
