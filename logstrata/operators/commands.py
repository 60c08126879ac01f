"""The command surface, in order: a log of commands folded key by key, with the reply to each.

Set-based folds (`typed`) answer what the final state is; this one answers what each command said, including pops, expiry on access
and commands of the wrong type. A key's commands depend on each other, so a key is the unit of work: rows are streamed in order of
seq, never held as a group. Commands on several keys are split by key first and their counts added up.

Names of commands don't depend on case. A command that can't be run (an unknown name, a wrong number of arguments, a missing key, text
where a number is due) has an error as its reply and changes nothing; it never ends the job. Integers are what text begins with, after white space; counters are strict.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import resp
from ..functions.resp import ERROR_NOT_FLOAT, ERROR_NOT_INTEGER, EMPTY, NIL, OK, WRONGTYPE, array, arity, bulk, integer, unknown

_STRINGS, _HASHES = {"GET", "INCR", "DECR"}, {"HSET", "HGET", "HDEL", "HKEYS", "HSETNX"}
_LISTS, _SETS = {"LPUSH", "RPUSH", "LPOP", "RPOP", "LLEN", "LRANGE"}, {"SADD", "SREM", "SISMEMBER", "SCARD", "SMEMBERS"}
_ZSETS = {"ZADD", "ZREM", "ZRANGE", "ZCARD", "ZSCORE", "ZINCRBY", "ZRANK"}
_KIND = {c: k for k, cs in (("string", _STRINGS), ("hash", _HASHES), ("list", _LISTS), ("set", _SETS), ("zset", _ZSETS)) for c in cs}
#: Least arguments (without command and key), and whether they are exact.
_ARITY = {
    "GET": (0, True), "SET": (1, True), "INCR": (0, True), "DECR": (0, True), "DEL": (0, True), "EXPIRE": (1, True), "TTL": (0, True), "HSET": (2, False), "HGET": (1, True),
    "HDEL": (1, True), "HKEYS": (0, True), "HSETNX": (2, True), "LPUSH": (1, True), "RPUSH": (1, True), "LPOP": (0, True), "RPOP": (0, True), "LLEN": (0, True), "LRANGE": (2, True),
    "ZADD": (2, False), "ZREM": (1, False), "ZRANGE": (2, False), "ZCARD": (0, True), "ZSCORE": (1, True), "ZINCRBY": (2, True), "ZRANK": (1, True),
    "SADD": (1, False), "SREM": (1, False), "SISMEMBER": (1, True), "SCARD": (0, True), "SMEMBERS": (0, True),
}
_ON_MISSING = {"GET": NIL, "HGET": NIL, "HDEL": integer(0), "HKEYS": EMPTY, "LPOP": NIL, "RPOP": NIL, "LLEN": integer(0), "LRANGE": EMPTY, "ZREM": integer(0), "ZRANGE": EMPTY}
_ON_MISSING |= {"ZCARD": integer(0), "ZSCORE": NIL, "ZRANK": NIL, "SREM": integer(0), "SISMEMBER": integer(0), "SCARD": integer(0), "SMEMBERS": EMPTY}


def _number(text: str) -> int | None:
    digits = text[1:] if text[:1] == "-" else text
    return int(text) if digits.isascii() and digits.isdigit() and -(1 << 31) <= int(text) < 1 << 31 else None


_INTEGER, _FLOAT = re.compile(r"\s*([+-]?[0-9]{1,18})"), re.compile(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?")


class Bad(ValueError):
    """An argument that isn't what it must be; its text is the reply."""


def _integer(text: str | None) -> int:
    found = _INTEGER.match(text or "")
    if not found:
        raise Bad(ERROR_NOT_INTEGER)
    return int(found[1])


def _float(text: str | None) -> float:
    if not text or not _FLOAT.fullmatch(text):
        raise Bad(ERROR_NOT_FLOAT)
    return float(text)


def _slice(items, n: int, first: int, last: int) -> list[str]:
    first, last = max(first + n if first < 0 else first, 0), min(last + n if last < 0 else last, n - 1)
    return list(islice(items, first, last + 1)) if first <= last else []


class Scores:
    """Members with their scores as given, kept in order of score and member."""

    def __init__(self):
        self.text: dict[str, str] = {}
        self.order: list[tuple[float, bytes]] = []

    def __len__(self) -> int:
        return len(self.text)

    def place(self, member: str) -> int | None:
        text = self.text.get(member)
        return None if text is None else bisect_left(self.order, (float(text), member.encode()))

    def drop(self, member: str) -> bool:
        at = self.place(member)
        if at is not None:
            del self.order[at], self.text[member]
        return at is not None

    def put(self, member: str, score: str) -> None:
        self.drop(member)
        self.text[member] = score
        insort(self.order, (float(score), member.encode()))

    def members(self, low: float | None = None, high: float | None = None) -> Iterator[str]:
        start = 0 if low is None else bisect_left(self.order, (low, b""))
        for score, member in islice(self.order, start, None):
            if high is not None and score > high:
                return
            yield member.decode()


class Key:
    """State of one key."""

    def __init__(self):
        self.kind: str | None = None
        self.value: object = None
        self.expire_at: int | None = None

    def clear(self) -> None:
        self.__init__()

    def run(self, cmd: str, args: list[str], now: int, key: str | None = "", name: str | None = None) -> str:
        """cmd in upper case; name: as it was given."""
        least, exact = _ARITY.get(cmd, (None, None))
        if least is None:
            return unknown(cmd if name is None else name)
        if key is None or len(args) < least or exact and len(args) != least or None in args:
            return arity(cmd)
        try:
            return self._run(cmd, args, now)
        except Bad as error:
            return str(error)

    def _run(self, cmd: str, args: list[str], now: int) -> str:
        gone = self.expire_at is not None and self.expire_at < now
        if cmd == "TTL":
            return integer(-2 if self.kind is None or gone else -1 if self.expire_at is None else self.expire_at - now)
        if cmd == "SET":  # keeps an expiry, even one that has passed
            self.kind, self.value = "string", args[0]
            return OK
        if cmd == "DEL":  # an expired key that nothing has touched still counts
            there = self.kind is not None
            self.clear()
            return integer(int(there))
        if gone:
            self.clear()
        if cmd == "EXPIRE":
            if self.kind is None:
                return integer(0)
            self.expire_at = now + _integer(args[0])
            return integer(1)
        if self.kind is not None and self.kind != _KIND[cmd]:
            return integer(0) if cmd == "HSETNX" else WRONGTYPE
        if self.kind is None and cmd in _ON_MISSING:
            return _ON_MISSING[cmd]
        reply = getattr(self, f"_{cmd.lower()}")(*args)
        if self.kind not in (None, "string") and not self.value:
            self.clear()
        return reply

    def _own(self, kind: str, empty: Callable):
        if self.kind is None:
            self.kind, self.value = kind, empty()
        return self.value

    def _get(self) -> str:
        return bulk(self.value)

    def _step(self, by: int) -> str:
        old = 0 if self.kind is None else _number(self.value)
        if old is None:
            return ERROR_NOT_INTEGER
        self.kind, self.value = "string", str(old + by)
        return self.value

    def _incr(self) -> str:
        return self._step(1)

    def _decr(self) -> str:
        return self._step(-1)

    def _hset(self, *pairs: str) -> str:
        if len(pairs) % 2:
            return arity("hset")
        held = self._own("hash", dict)
        before = len(held)
        held.update(zip(pairs[::2], pairs[1::2], strict=True))
        return integer(len(held) - before)

    def _hsetnx(self, field: str, value: str) -> str:
        held = self._own("hash", dict)
        new = field not in held
        held.setdefault(field, value)
        return integer(int(new))

    def _hget(self, field: str) -> str:
        return bulk(self.value.get(field))

    def _hdel(self, field: str) -> str:
        return integer(int(self.value.pop(field, None) is not None))

    def _hkeys(self) -> str:
        return array(sorted(self.value, key=str.encode))

    def _lpush(self, value: str) -> str:
        self._own("list", deque).appendleft(value)
        return integer(len(self.value))

    def _rpush(self, value: str) -> str:
        self._own("list", deque).append(value)
        return integer(len(self.value))

    def _lpop(self) -> str:
        return bulk(self.value.popleft())

    def _rpop(self) -> str:
        return bulk(self.value.pop())

    def _llen(self) -> str:
        return integer(len(self.value))

    def _lrange(self, first: str, last: str) -> str:
        return array(_slice(self.value, len(self.value), _integer(first), _integer(last)))

    def _sadd(self, *members: str) -> str:
        held = self._own("set", set)
        before = len(held)
        held.update(members)
        return integer(len(held) - before)

    def _srem(self, *members: str) -> str:
        before = len(self.value)
        self.value.difference_update(members)
        return integer(before - len(self.value))

    def _sismember(self, member: str) -> str:
        return integer(int(member in self.value))

    def _scard(self) -> str:
        return integer(len(self.value))

    def _smembers(self) -> str:
        return array(sorted(self.value, key=str.encode))

    def _zadd(self, *pairs: str) -> str:
        if len(pairs) % 2:
            return arity("ZADD")
        for score in pairs[::2]:
            _float(score)
        held = self._own("zset", Scores)
        before = len(held)
        for score, member in zip(pairs[::2], pairs[1::2], strict=True):
            held.put(member, score)
        return integer(len(held) - before)

    def _zrem(self, *members: str) -> str:
        return integer(sum(self.value.drop(m) for m in dict.fromkeys(members)))

    def _zrange(self, first: str, last: str, *how: str) -> str:
        if how[-1:] and how[-1].upper() == "BYSCORE":
            return array(list(self.value.members(_float(first), _float(last))))
        return array(_slice(self.value.members(), len(self.value), _integer(first), _integer(last)))

    def _zcard(self) -> str:
        return integer(len(self.value))

    def _zscore(self, member: str) -> str:
        return bulk(self.value.text.get(member))

    def _zincrby(self, by: str, member: str) -> str:
        new = _integer(by) + _integer(self.value.text.get(member, "0") if self.kind else "0")
        self._own("zset", Scores).put(member, str(new))
        return integer(new)

    def _zrank(self, member: str) -> str:
        place = self.value.place(member)
        return NIL if place is None else integer(place)


def epochs(log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """log with epoch, the number of FLUSHALL commands before a row: counted within ranges of width seqs, and by range."""
    flush = F.coalesce(F.upper("cmd") == "FLUSHALL", F.lit(False)).cast("bigint")
    rows = log.withColumn("slot", F.expr(f"seq div {width}"))
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("slot").agg(F.sum(flush).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("slot", "base")
    inside = Window.partitionBy("slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("inner", F.coalesce(F.sum(flush).over(inside), F.lit(0)))
    return counted.join(base, "slot").withColumn("epoch", F.col("base") + F.col("inner")).drop("slot", "base", "inner")


_PLAIN = ("FLUSHALL", "SAVE", "PING")


def by_key(log: DataFrame) -> DataFrame:
    """Commands with one key a row, and their epoch: DEL of several keys becomes several rows. cmd is in upper case, name as it was given."""
    none = F.array().cast("array<string>")
    rows = epochs(log).withColumn("name", F.coalesce("cmd", F.lit(""))).withColumn("cmd", F.upper("name")).where(~F.col("cmd").isin(*_PLAIN))
    several = F.when((F.col("cmd") == "DEL") & F.col("key").isNotNull(), F.array_distinct(F.concat(F.array("key"), F.coalesce("args", none))))
    rows = rows.withColumn("args", F.coalesce("args", none)).withColumn("key", F.explode(F.coalesce(several, F.array("key"))))
    return rows.select("seq", "at", "cmd", "name", "key", F.when(F.col("cmd") == "DEL", none).otherwise(F.col("args")).alias("args"), "epoch")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Key, bool]]:
    """(row, state before it, whether the key or epoch is new)."""
    mark, state = None, Key()
    for batch in batches:
        for row in batch.to_pylist():
            new = (row["key"], row["epoch"]) != mark
            if new:
                mark, state = (row["key"], row["epoch"]), Key()
            yield row, state, new


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_REPLIES = pa.schema([("seq", pa.int64()), ("key", pa.string()), ("reply", pa.string())])
_ITEMS = pa.schema([("key", pa.string()), ("epoch", pa.int64()), ("pos", pa.int64()), ("value", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for row, state, _ in _walk(batches):
        out.append((row["seq"], row["key"], state.run(row["cmd"], row["args"], row["at"], row["key"], row["name"])))
        if len(out) == 10_000:
            yield _batch(out, _REPLIES)
            out = []
    if out:
        yield _batch(out, _REPLIES)


def replay(log: DataFrame) -> DataFrame:
    """seq, reply of each command of the log (seq, at, cmd, key, args)."""
    ordered = by_key(log).repartition("key").sortWithinPartitions("key", "epoch", "seq")
    each = ordered.mapInArrow(_fold, "seq long, key string, reply string")
    # one reply a command; the counts of a DEL over several keys add up
    total = F.sum(F.try_to_number(F.regexp_extract("reply", r"^:(-?\d+)", 1), F.lit("S9999999999"))).cast("bigint")
    one = each.groupBy("seq").agg(F.count("*").alias("n"), F.min("reply").alias("reply"), total.alias("total"))
    told = one.select("seq", F.when(F.col("n") > 1, F.concat(F.lit(":"), F.col("total").cast("string"), F.lit("\r\n"))).otherwise(F.col("reply")).alias("reply"))
    plain = log.where(F.upper("cmd").isin(*_PLAIN)).select("seq", F.when(F.upper("cmd") == "PING", "+PONG\r\n").otherwise(OK).alias("reply"))
    return told.unionByName(plain)


#: Most requests that one text of them may hold.
REQUESTS = 1 << 20


def answer(texts: DataFrame) -> DataFrame:
    """seq, reply of each row of texts (seq, at, raw: RESP requests one after another): the replies to all its requests, joined. Requests run
    in order of seq and then of their place; a request that is cut off ends its text."""
    asked = texts.select("seq", "at", F.posexplode(resp.requests("raw")).alias("place", "said")).where(F.size("said") > 0)
    place = F.when(F.col("place") < REQUESTS, F.col("place")).otherwise(F.raise_error(F.lit("too many requests in a text")).cast("int"))
    log = asked.select((F.col("seq") * REQUESTS + place).alias("seq"), "at", F.col("said")[0].alias("cmd"), F.get("said", F.lit(1)).alias("key"), F.slice("said", 3, 1 << 30).alias("args"))
    told = replay(log).select(F.expr(f"seq div {REQUESTS}").alias("seq"), F.struct(F.col("seq").alias("at"), "reply").alias("r"))
    joined = told.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["reply"]), "").alias("reply"))
    return texts.select("seq").join(joined, "seq", "left").select("seq", F.coalesce("reply", F.lit("")).alias("reply"))


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def items(key: str, epoch: int, state: Key) -> list[tuple]:
        return [(key, epoch, i, v) for i, v in enumerate(state.value)] if state.kind == "list" else []

    out, last = [], None
    for row, state, new in _walk(batches):
        if new and last is not None:
            out += items(*last)
            if len(out) >= 10_000:
                yield _batch(out, _ITEMS)
                out = []
        state.run(row["cmd"], row["args"], row["at"], row["key"], row["name"])
        last = row["key"], row["epoch"], state
    out += items(*last) if last is not None else []
    if out:
        yield _batch(out, _ITEMS)


def lists(log: DataFrame) -> DataFrame:
    """key, pos, value of the lists that the log leaves."""
    held = by_key(log).repartition("key").sortWithinPartitions("key", "epoch", "seq").mapInArrow(_left, "key string, epoch long, pos long, value string")
    now = log.agg(F.count_if(F.upper("cmd") == "FLUSHALL")).scalar()
    return held.where(F.col("epoch") == now).select("key", "pos", "value")
