import random

import pytest

from logstrata.functions import resp, scalars
from logstrata.model import COMMANDS
from logstrata.operators import commands, typed


def say(spark, *lines, at=None):
    rows = []
    for i, line in enumerate(lines, 1):
        t = 100 + i if at is None else at[i - 1]
        cmd, *args = line.split()
        rows.append((i, t, cmd, args[0] if args else None, args[1:]))
    df = commands.replay(spark.createDataFrame(rows, COMMANDS))
    return [r["reply"] for r in df.orderBy("seq").collect()]


def test_strings(spark):
    assert say(spark, "SET k v", "GET k", "INCR c", "INCR c", "DECR c", "DECR c", "DECR c", "INCR k") == ["+OK\r\n", "$1\r\nv\r\n", "1", "2", "1", "0", "-1", "-ERR the value is not an integer\r\n"]


def test_expiry_is_strict_and_writes_clear(spark):
    got = say(spark, "SET k v", "EXPIRE k 1", "GET k", "GET k", "TTL k", "EXPIRE x 5", at=[10, 10, 11, 12, 12, 12])
    assert got == ["+OK\r\n", ":1\r\n", "$1\r\nv\r\n", "$-1\r\n", ":-2\r\n", ":0\r\n"]
    assert say(spark, "HSET h f 1", "EXPIRE h 1", "HSET h g 2", "HKEYS h", at=[1, 1, 5, 5]) == [":1\r\n", ":1\r\n", ":1\r\n", "*1\r\n$1\r\ng\r\n"]
    # SET keeps the old expiry; DEL counts an expired key that nothing has touched
    assert say(spark, "SET k v", "EXPIRE k 1", "SET k w", "GET k", "DEL k", at=[1, 1, 5, 5, 5])[2:] == ["+OK\r\n", "$-1\r\n", ":0\r\n"]
    assert say(spark, "SET k v", "EXPIRE k 1", "DEL k", at=[1, 1, 9])[-1] == ":1\r\n"


def test_hashes(spark):
    got = say(spark, "HSET h a 1", "HSET h b 2", "HSET h a 3 c 4", "HGET h a", "HGET h z", "HDEL h a", "HDEL h a", "HKEYS h", "HSETNX h b 9", "HSETNX h d 9", "HDEL h b")
    assert got[:7] == [":1\r\n", ":1\r\n", ":1\r\n", "$1\r\n3\r\n", "$-1\r\n", ":1\r\n", ":0\r\n"]
    assert got[7:] == ["*2\r\n$1\r\nb\r\n$1\r\nc\r\n", ":0\r\n", ":1\r\n", ":1\r\n"]


def test_lists(spark):
    got = say(spark, "LPUSH l v1", "LPUSH l v2", "RPUSH l v3", "LRANGE l 0 -1", "LPOP l", "RPOP l", "LLEN l", "RPOP l", "RPOP l", "LLEN l")
    assert got == [":1\r\n", ":2\r\n", ":3\r\n", "*3\r\n$2\r\nv2\r\n$2\r\nv1\r\n$2\r\nv3\r\n", "$2\r\nv2\r\n", "$2\r\nv3\r\n", ":1\r\n", "$2\r\nv1\r\n", "$-1\r\n", ":0\r\n"]


def test_sorted_sets(spark):
    got = say(spark, "ZADD z 1 one 2 two 3 three", "ZRANGE z 0 -1", "ZINCRBY z 2 two", "ZRANGE z 0 -1", "ZRANK z two", "ZREM z one", "ZCARD z", "ZSCORE z three", "ZRANGE z 3 3 BYSCORE", "ZRANGE z 5 1")
    assert got[0] == ":3\r\n" and got[1] == resp.array(["one", "two", "three"]) and got[2] == ":4\r\n"
    assert got[3] == resp.array(["one", "three", "two"]) and got[4:7] == [":2\r\n", ":1\r\n", ":2\r\n"]
    assert got[7] == "$1\r\n3\r\n" and got[8] == resp.array(["three"]) and got[9] == "*0\r\n"


def test_sets(spark):
    got = say(spark, "SADD s m1 m2 m3 m2", "SISMEMBER s m2", "SREM s m1 m3 m9", "SCARD s", "SMEMBERS s", "SREM s m2", "SCARD s")
    assert got == [":3\r\n", ":1\r\n", ":2\r\n", ":1\r\n", "*1\r\n$2\r\nm2\r\n", ":1\r\n", ":0\r\n"]


def test_types_flush_and_several_keys(spark):
    got = say(spark, "SADD s a", "HSET s f v", "HSETNX s f v", "GET s", "SET s x", "GET s", "SET t y", "DEL s t u", "SET s x", "FLUSHALL", "GET s", "PING", "SET s", "NOPE s")
    assert got[1] == got[3] == resp.WRONGTYPE and got[2] == ":0\r\n"
    assert got[4:8] == ["+OK\r\n", "$1\r\nx\r\n", "+OK\r\n", ":2\r\n"]
    assert got[10] == "$-1\r\n" and got[11] == "+PONG\r\n" and got[12].startswith("-ERR wrong number") and got[13].startswith("-ERR unknown")


@pytest.mark.parametrize("seed", [1, 2])
def test_set_folds_agree_with_replay(spark, seed):
    """The set-based folds and the fold in order end alike."""
    rng, rows = random.Random(seed), []
    for i in range(1, 600):
        kind = rng.choice("zsh")
        key, m = f"{kind}{rng.randrange(4)}", f"m{rng.randrange(5)}"
        cmd, args = {"z": rng.choice([("ZADD", [str(rng.randrange(9)), m]), ("ZINCRBY", ["2", m]), ("ZREM", [m])]), "s": rng.choice([("SADD", [m]), ("SREM", [m])]), "h": rng.choice([("HSET", [m, str(i)]), ("HSETNX", [m, str(i)]), ("HDEL", [m])])}[kind]
        rows.append((i, i, cmd, key, args))
    keys = [f"{k}{i}" for k in "zsh" for i in range(4)]
    asks = [(1000 + j, 1000, {"z": "ZRANGE", "s": "SMEMBERS", "h": "HKEYS"}[k[0]], k, ["0", "-1"] if k[0] == "z" else []) for j, k in enumerate(keys)]
    replies = {r["seq"]: r["reply"] for r in commands.replay(spark.createDataFrame(rows + asks, COMMANDS)).collect()}
    log = spark.createDataFrame(rows, COMMANDS)
    z, s, h = (log.where(f"key like '{k}%'") for k in "zsh")
    held = {k: [] for k in keys}
    for r in typed.ranks(typed.scores(z)).orderBy("key", "rank").collect() + typed.members(s).orderBy("member").collect():
        held[r["key"]].append(r["member"])
    for r in typed.hash_keys(h).collect():
        held[r["key"]] = r["fields"]
    assert {k: replies[1000 + j] for j, k in enumerate(keys)} == {k: resp.array(v) for k, v in held.items()}


def test_list_state_and_lengths(spark):
    rng = random.Random(5)
    rows = [(i, i, rng.choice(["LPUSH", "RPUSH", "LPOP", "RPOP"]), f"l{rng.randrange(3)}", [str(i)]) for i in range(1, 300)]
    rows = [(a, b, c, k, v if "PUSH" in c else []) for a, b, c, k, v in rows]
    model = {}
    for _, _, cmd, key, args in rows:
        held = model.setdefault(key, [])
        if cmd == "LPUSH":
            held.insert(0, args[0])
        elif cmd == "RPUSH":
            held.append(args[0])
        elif held:
            held.pop(0 if cmd == "LPOP" else -1)
    log = spark.createDataFrame(rows, COMMANDS)
    got = {}
    for r in commands.lists(log).orderBy("key", "pos").collect():
        got.setdefault(r["key"], []).append(r["value"])
    assert got == {k: v for k, v in model.items() if v}
    assert {r["key"]: r["length"] for r in typed.list_lengths(log).collect()} == {k: len(v) for k, v in model.items()}


def test_requests(spark):
    raw = resp.array(["SET", "k", "line\r\nbreak é"]) + resp.array(["GET", "k"])
    assert resp.parse(raw.encode()) == [["SET", "k", "line\r\nbreak é"], ["GET", "k"]]
    assert resp.parse(raw.encode()[:-3]) == [["SET", "k", "line\r\nbreak é"]]
    assert resp.parse(b"junk") == resp.parse(b"") == []
    df = spark.createDataFrame([(raw,), (None,)], "t string").select(resp.requests("t").alias("r"))
    assert [r["r"] for r in df.collect()] == [[["SET", "k", "line\r\nbreak é"], ["GET", "k"]], None]


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("12",), (" 12",), ("-3",), ("3000000000",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.strict_int(F.col("t"))).collect()] == [12, None, -3, None, None, None]
    assert [r[0] for r in df.select(scalars.lenient_int(F.col("t"))).collect()] == [12, 12, -3, 3000000000, None, None]
    assert df.select(scalars.after_marker(F.lit("a_b_c"), "_"), scalars.padded(F.lit(7)), scalars.checksum(F.lit("123456789")), scalars.expired(F.lit(5), 6), scalars.expired(F.lit(6), 6)).first()[:] == ("b_c", "0" * 31 + "7", 0xCBF43926, True, False)


def test_bad_requests_have_a_reply(spark):
    """No argument ends the job; each has its reply and changes nothing."""
    got = say(spark, "set k v", "Get k", "SET k", "GET", "nope k", "NOPE", "EXPIRE k soon", "EXPIRE k 12abc", "TTL k", "LPUSH l a", "LRANGE l x 1", "LRANGE l 0 x", "lrange l 0 -1", "ZADD z one m", "ZADD z 1.5 m", "zadd z 1 a 2", "ZINCRBY z 2 m", "ZINCRBY z x m", "ZRANGE z a 1", "ZRANGE z 0 (9 BYSCORE", "ZRANGE z 0 9 byscore", "ZSCORE z m")
    err = "-ERR the value is not an integer\r\n"
    assert got[:4] == ["+OK\r\n", "$1\r\nv\r\n", "-ERR wrong number of arguments for 'SET' command\r\n", "-ERR wrong number of arguments for 'GET' command\r\n"]
    assert got[4:9] == ["-ERR unknown command 'nope'\r\n", "-ERR unknown command 'NOPE'\r\n", err, ":1\r\n", ":11\r\n"]
    assert got[9:13] == [":1\r\n", err, err, resp.array(["a"])]
    assert got[13:16] == ["-ERR value is not a valid float\r\n", ":1\r\n", "-ERR wrong number of arguments for 'zadd' command\r\n"]
    assert got[16:] == [":3\r\n", err, err, "-ERR value is not a valid float\r\n", resp.array(["m"]), resp.bulk("3")]


def test_ranks_against_sorting(spark):
    rng, held, lines, want = random.Random(3), {}, [], []
    for _ in range(300):
        m, score = f"m{rng.randrange(12)}", str(rng.choice([1, 2, 2.5, -3, 10]))
        what = rng.random()
        if what < 0.5:
            lines.append(f"ZADD z {score} {m}")
            want.append(f":{int(m not in held)}\r\n")
            held[m] = score
        elif what < 0.6:
            lines.append(f"ZREM z {m}")
            want.append(f":{int(held.pop(m, None) is not None)}\r\n")
        else:
            order = sorted(held, key=lambda x: (float(held[x]), x))
            lines.append(f"ZRANK z {m}")
            want.append(resp.integer(order.index(m)) if m in held else resp.NIL)
    assert say(spark, *lines) == want


def test_requests_to_replies(spark):
    raw = [resp.array(["set", "k", "v"]) + resp.array(["GET", "k"]), resp.array(["lpush", "l", "a"]), resp.array(["RPUSH", "l", "b"]) + resp.array(["LRANGE", "l", "0", "-1"]) + "*2\r\n$3\r\nGE", "junk", resp.array(["PING"])]
    df = spark.createDataFrame([(i, 5, t) for i, t in enumerate(raw, 1)], "seq long, at long, raw string")
    got = [r["reply"] for r in commands.answer(df).orderBy("seq").collect()]
    assert got == ["+OK\r\n" + resp.bulk("v"), ":1\r\n", ":2\r\n" + resp.array(["a", "b"]), "", "+PONG\r\n"]
