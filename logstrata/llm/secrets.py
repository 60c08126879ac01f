"""Secret scans, in DataFrame functions alone.

Base rules find assignments, access keys and long hex runs. The method adds spans of kind `random`: each long token gets an encoding
(hex, base32, base64), and a battery of tests looks at its symbols: chi-squared uniformity over that alphabet, runs of character classes
(upper, lower, digit, sign), lag-1 serial correlation. A token that a test tells from uniform draws, by more than `limit` standard
deviations, is out. Each statistic of the others also becomes an e-value against the null "ordinary identifier", a likelihood ratio of
uniform draws to the least ordinary identifier that still counts as one:

* chi-squared: its statistic counts coinciding pairs of symbols; Poisson with the rate of the alphabet, or of COINCIDENCE.
* runs: class changes between neighbours; binomial with the rate of uniform draws, or of CHANGES: a word has some five letters.
* serial correlation: normal about 0, or about CORRELATION, which blocks of upper, lower and digits make.
* the inferred alphabet itself: the chance that an ordinary identifier's letters (hex) or digits (base32) keep within it, WITHIN.

The rates are those of text, not of any table here: the coincidence of English letters is 0.066 and lower with capitals and digits among
them; the letters a to f are 0.32 of English. All four e-values grow with a token's length, and their mean is an e-value however they depend
on each other. The e-value form of Benjamini-Hochberg over a document's tokens (reject the k largest if the k-th is m / (q k) or more)
then controls false discoveries at q, with respect to length, without any corpus-wide state.

Positions are code points. A span is the whole match. Null or empty text has no spans; base_sha256 is then that of the empty string.
Rows are independent: a null or repeated doc_id changes nothing, nor do extra columns. Every step is one pass over a row; there is no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Fixed patterns of the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Fixed order of kinds at one start.
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_BLOCK = 512
#: Code points of a chunk of text, and chunks of a block.
_CHUNK, _CHUNKS = 2048, 64

#: Fixed alphabets, in the order of their values.
BASE16 = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: By alphabet: uniform draws' rate of class changes; and of ordinary identifiers the most class changes, the least chance that two symbols
#: coincide, and the chance of a letter (of a digit) to be of the alphabet.
UNIFORM = {16: 2 * 10 * 6 / 16**2, 32: 2 * 26 * 6 / 32**2, 64: 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2}
CHANGES = {16: 0.2, 32: 0.12, 64: 0.2}
COINCIDENCE = {16: 0.09, 32: 0.06, 64: 0.055}
WITHIN = {16: 0.32, 32: 0.6, 64: 1.0}
CORRELATION = 0.3


def _running(array: str, step: str = "{a} + x") -> str:
    """SQL for what a fold by step (of {a}, the state, from 0, and x) holds before each element of an array of bigint: in blocks, each from
    the fold of what is before it, so that long arrays cost a five-hundredth of n * n additions."""
    one = step.format(a="t.s")
    inner = f"aggregate(b.part, struct(b.base AS s, cast(array() AS array<bigint>) AS o), (t, x) -> struct({one} AS s, concat(t.o, array(t.s)) AS o)).o"
    outer = f"transform(sequence(0, (size({array}) - 1) div {_BLOCK}), j -> struct(aggregate(slice({array}, 1, j * {_BLOCK}), 0L, (t, x) -> {step.format(a='t')}) AS base, slice({array}, j * {_BLOCK} + 1, {_BLOCK}) AS part))"
    return f"if(size({array}) = 0, cast(array() AS array<bigint>), flatten(transform({outer}, b -> {inner})))"


def _spans(df: DataFrame, kind: str, pattern: str, keep: str = "true", group: int = 0) -> DataFrame:
    """Adds kind: array of (s, e, v) for the leftmost matches that don't overlap and for which keep, over v (a group), holds."""
    text, none = F.col("text"), "cast(array() AS array<struct<s: bigint, e: bigint, v: string>>)"
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    df = df.withColumn("_v", F.when(F.size("_m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("_m"))
    df = df.withColumn("_l", F.expr("transform(_m, (x, i) -> cast(char_length(x) + char_length(_g[i]) AS bigint))"))
    df = df.withColumn("_r", F.expr(f"if(size(_m) = 0, cast(array() AS array<bigint>), {_running('_l')})"))
    made = "transform(_m, (x, i) -> struct(_r[i] + char_length(_g[i]) AS s, _r[i] + char_length(_g[i]) + char_length(x) AS e, _v[i] AS v))"
    return df.withColumn(kind, F.expr(f"if(size(_m) = 0, {none}, filter({made}, x -> {keep.format(v='x.v')}))")).drop("_m", "_g", "_v", "_l", "_r")


def _tested(df: DataFrame, limit: float) -> DataFrame:
    """Adds `_c`: of the tokens in `_tok`, those in which the battery finds nothing against uniform draws: (s, e, bits), bits: log2 of the e-value."""
    coded = """transform(filter(_tok, x -> x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'), x -> named_struct('s', x.s, 'e', x.e, 'v', regexp_replace(x.v, '=+$', ''),
        'k', case when lower(x.v) rlike '^[0-9a-f]+$' and (x.v = lower(x.v) or x.v = upper(x.v)) then 16 when x.v rlike '^[A-Z2-7]+=*$' then 32 else 64 end))"""
    df = df.withColumn("_t", F.expr(coded))
    value = f"instr(case x.k when 16 then '{BASE16}' when 32 then '{BASE32}' else '{BASE64}' end, translate(if(x.k = 16, lower(c), c), '-_', '+/')) - 1"
    df = df.withColumn("_t", F.expr(f"transform(_t, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'k', x.k, 'n', char_length(x.v), 'x', transform(filter(split(x.v, ''), c -> c != ''), c -> cast({value} AS double))))"))
    # counts of each symbol, character classes, and the moments of neighbours
    classes = "transform(x.x, y -> case x.k when 16 then if(y < 10, 2, 1) when 32 then if(y < 26, 0, 2) else if(y < 26, 0, if(y < 52, 1, if(y < 62, 2, 3))) end)"
    stats = f"""transform(filter(_t, x -> x.n >= 16), x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'n', cast(x.n AS double),
        'sq', aggregate(transform(sequence(0, x.k - 1), q -> size(filter(x.x, y -> y = q))), 0D, (a, y) -> a + cast(y AS double) * y),
        'c', {classes}, 'mean', aggregate(x.x, 0D, (a, y) -> a + y) / x.n, 'x', x.x))"""
    df = df.withColumn("_t", F.expr(stats))
    neighbours = "zip_with(slice(x.{c}, 1, size(x.{c}) - 1), slice(x.{c}, 2, size(x.{c})), (p, q) -> {f})"
    changes = neighbours.format(c="c", f="if(p = q, 0, 1)")
    products = neighbours.format(c="x", f="(p - x.mean) * (q - x.mean)")
    moments = f"""transform(_t, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'n', x.n, 'sq', x.sq, 'r', aggregate({changes}, 0D, (a, y) -> a + y),
        'inside', cast(size(filter(x.c, y -> (x.k = 16 and y = 1) or (x.k = 32 and y = 2))) AS double),
        'var', aggregate(x.x, 0D, (a, y) -> a + (y - x.mean) * (y - x.mean)), 'cov', aggregate({products}, 0D, (a, y) -> a + y)))"""
    df = df.withColumn("_t", F.expr(moments))

    def rate(of: dict[int, float]) -> str:
        return "case x.k " + " ".join(f"when {k} then {v!r}D" for k, v in of.items()) + " end"

    # the three deviations from uniform draws; serial correlation is out of bounds where all symbols are the same
    tests = f"""transform(_t, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'n', x.n, 'sq', x.sq, 'r', x.r, 'inside', x.inside,
        'chi', (x.k / x.n * x.sq - x.n - (x.k - 1)) / sqrt(2D * (x.k - 1)),
        'runs', (x.r - (x.n - 1) * {rate(UNIFORM)}) / sqrt((x.n - 1) * {rate({k: v * (1 - v) for k, v in UNIFORM.items()})}),
        'serial', if(x.var > 0, (x.cov / x.var + 1 / x.n) * sqrt(x.n), 1e9D)))"""
    df = df.withColumn("_t", F.expr(tests))
    # log2 of the e-values; pairs: (sq - n) / 2 of n (n - 1) / 2 coincide
    log = {k: (math.log2(1 / k / c), (c - 1 / k) / math.log(2)) for k, c in COINCIDENCE.items()}
    pairs = f"((x.sq - x.n) / 2 * {rate({k: v[0] for k, v in log.items()})} + x.n * (x.n - 1) / 2 * {rate({k: v[1] for k, v in log.items()})})"
    odds = {k: (math.log2(UNIFORM[k] / c), math.log2((1 - UNIFORM[k]) / (1 - c))) for k, c in CHANGES.items()}
    runs = f"(x.r * {rate({k: v[0] for k, v in odds.items()})} + (x.n - 1 - x.r) * {rate({k: v[1] for k, v in odds.items()})})"
    serial = f"({math.log2(math.e)!r}D * ({CORRELATION**2 / 2!r}D * x.n - {CORRELATION!r}D * sqrt(x.n) * x.serial))"
    inside = f"(x.inside * {rate({k: -math.log2(v) + 0.0 for k, v in WITHIN.items()})})"
    kept = f"filter(_t, x -> abs(x.chi) <= {limit}D and abs(x.runs) <= {limit}D and abs(x.serial) <= {limit}D)"
    df = df.withColumn("_t", F.expr(f"transform({kept}, x -> named_struct('s', x.s, 'e', x.e, 'v', array({pairs}, {runs}, {serial}, {inside})))"))
    # the mean of the e-values, in logarithms
    mean = "array_max(x.v) + log2(aggregate(x.v, 0D, (a, y) -> a + power(2D, y - array_max(x.v))) / size(x.v))"
    return df.withColumn("_c", F.expr(f"transform(_t, x -> named_struct('s', x.s, 'e', x.e, 'bits', {mean}))")).drop("_t")


def find_secrets(docs: DataFrame, *columns: str, q: float = 0.01, limit: float = 3.5) -> DataFrame:
    """doc_id, text, the columns named, and assign, access, hex, random: arrays of (s, e, v).

    q: the false-discovery rate within a document; limit: the standard deviations at which a test of the battery rejects."""
    df = texts(docs, *columns)
    df = _spans(df, "assign", ASSIGN, "char_length({v}) >= 6", group=2)
    df = _spans(df, "access", ACCESS)
    df = _spans(df, "hex", HEX)
    df = _tested(_spans(df, "_tok", TOKEN), limit)
    # e-BH over all tokens, m of them: the k-th largest evidence must reach log2(m / (q k)); the largest such k sets the bar
    df = df.withColumn("_e", F.expr("reverse(sort_array(transform(_c, x -> x.bits)))"))
    df = df.withColumn("_bar", F.expr(f"array_min(filter(_e, (b, i) -> b >= log2(size(_tok) / ({q}D * (i + 1)))))"))
    free = "not exists(concat(assign, access, hex), b -> b.s < x.e and x.s < b.e)"
    df = df.withColumn("random", F.expr(f"if(_bar is null, cast(array() AS array<struct<s: bigint, e: bigint>>), transform(filter(_c, x -> x.bits >= _bar and {free}), x -> struct(x.s AS s, x.e AS e)))"))
    return df.drop("_c", "_e", "_bar", "_tok")


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, by start and then kind as listed, comma-joined."""
    each = ", ".join(f"transform({k}, x -> struct(x.s AS s, {KINDS.index(k)} AS k, x.e AS e))" for k in kinds)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(concat({each})), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs."""
    found = find_secrets(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs, all columns and rows, with every span (overlapping ones merged) replaced by mask; n_chars follows the text. Null stays null."""
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    found = find_secrets(whole, "_row")
    spans = "array_sort(concat(" + ", ".join(f"transform({k}, x -> struct(x.s AS s, x.e AS e))" for k in KINDS) + "))"
    found = found.withColumn("_all", F.expr(spans)).withColumn("_ends", F.expr("transform(_all, x -> x.e)")).withColumn("_before", F.expr(_running("_ends", "greatest({a}, x)")))
    # a span that begins after all before it have ended begins a masked range, which ends where those before the next one do
    found = found.withColumn("_first", F.expr("filter(transform(_all, (x, i) -> if(i = 0 or x.s >= _before[i], i, -1)), i -> i >= 0)"))
    found = found.withColumn("_all", F.expr("transform(_first, (i, j) -> struct(_all[i].s AS s, coalesce(get(_before, get(_first, j + 1)), array_max(_ends)) AS e))"))
    # by chunks of the text, so that a range costs no more than its chunks; a range's mask stands in the chunk where it begins
    def near(ranges: str, c: str, n: int) -> str:
        return f"filter({ranges}, r -> r.s < ({c} + 1) * {n}L and r.e > {c} * {n}L)"

    there = F.size("_all") > 0
    found = found.withColumn("_chunks", F.when(there, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    blocks = f"transform(sequence(0, (size(_chunks) - 1) div {_CHUNKS}), b -> struct(b AS b, {near('_all', 'b', _CHUNK * _CHUNKS)} AS w))"
    found = found.withColumn("_parts", F.when(there, F.expr(blocks)))
    chunk = f"struct(c AS c, _chunks[c] AS text, {near('z.w', 'c', _CHUNK)} AS own)"
    found = found.withColumn("_parts", F.expr(f"flatten(transform(_parts, z -> transform(filter(sequence(z.b * {_CHUNKS}, z.b * {_CHUNKS} + {_CHUNKS} - 1), c -> c < size(_chunks)), c -> {chunk})))"))
    local = f"struct(greatest(r.s - f.c * {_CHUNK}, 0L) AS s, least(r.e - f.c * {_CHUNK}, {_CHUNK}L) AS e, if(r.s >= f.c * {_CHUNK}, '{mask}', '') AS m)"
    found = found.withColumn("_parts", F.expr(f"transform(_parts, f -> struct(f.text AS text, transform(f.own, r -> {local}) AS own))"))
    last = "if(i = 0, 0L, g.own[i - 1].e)"
    pieces = f"concat(array_join(transform(g.own, (r, i) -> concat(substring(g.text, cast({last} + 1 AS int), cast(r.s - {last} AS int)), r.m)), ''), substring(g.text, cast(g.own[size(g.own) - 1].e + 1 AS int)))"
    clean = F.expr(f"array_join(transform(_parts, g -> if(size(g.own) = 0, g.text, {pieces})), '')")
    text = F.when(F.col("_row.text").isNull(), F.lit(None).cast("string")).when(F.size("_all") == 0, F.col("_row.text")).otherwise(clean)
    out = found.select(F.col("_row"), text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_text") == F.col("_row.text"), F.col("_row.n_chars")).otherwise(F.char_length("_text").cast("long"))} if "n_chars" in rest else {"text": F.col("_text")}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
