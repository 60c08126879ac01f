"""The RESP wire format: replies as text, columns of replies, and requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed replies.
OK, NIL, EMPTY = "+OK\r\n", "$-1\r\n", "*0\r\n"
WRONGTYPE = "-WRONGTYPE Operation against a key holding the wrong kind of value\r\n"
ERROR_NOT_INTEGER = "-ERR the value is not an integer\r\n"
ERROR_NOT_FLOAT = "-ERR value is not a valid float\r\n"
#: Fixed: the commands that the reply to a wrong number of arguments names in upper case; it names the others in lower case.
UPPER = frozenset("SET GET DEL INCR DECR EXPIRE TTL HSET HGET HDEL HKEYS LPUSH RPUSH LPOP RPOP LLEN LRANGE".split())


def arity(cmd: str) -> str:
    return f"-ERR wrong number of arguments for '{cmd if cmd in UPPER else cmd.lower()}' command\r\n"


def unknown(cmd: str) -> str:
    return f"-ERR unknown command '{cmd}'\r\n"


def integer(n: int) -> str:
    return f":{n}\r\n"


def bulk(text: str | None) -> str:
    return NIL if text is None else f"${len(text.encode())}\r\n{text}\r\n"


def array(items: list[str]) -> str:
    return f"*{len(items)}\r\n" + "".join(map(bulk, items))


def integer_column(c: Column) -> Column:
    return F.concat(F.lit(":"), c.cast("string"), F.lit("\r\n"))


def bulk_column(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n")), F.lit(NIL))


def array_column(c: Column) -> Column:
    return F.concat(F.lit("*"), F.size(c).cast("string"), F.lit("\r\n"), F.array_join(F.transform(c, bulk_column), ""))


def parse(raw: bytes) -> list[list[str]]:
    """Requests in raw, by their lengths; a request that is cut off, or what isn't one, ends the list."""
    out, at = [], 0

    def line() -> bytes | None:
        nonlocal at
        end = raw.find(b"\r\n", at)
        if end < 0:
            return None
        found, at = raw[at:end], end + 2
        return found

    while at < len(raw):
        head = line()
        if head is None or not head.startswith(b"*") or not head[1:].isdigit():
            break
        args = []
        for _ in range(int(head[1:])):
            size = line()
            if size is None or not size.startswith(b"$") or not size[1:].isdigit():
                return out
            n = int(size[1:])
            if at + n + 2 > len(raw) or raw[at + n : at + n + 2] != b"\r\n":
                return out
            args.append(raw[at : at + n].decode(errors="replace"))
            at += n + 2
        out.append(args)
    return out


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def requests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The requests in a column of RESP text."""
    for texts in batches:
        yield texts.map(lambda t: parse(t.encode()) if t is not None else None)
