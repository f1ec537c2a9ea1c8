"""Secret scans: fixed forms, and a battery of randomness tests for strings of any form.

All of it is SQL on columns.  Base kinds: ``assign``, ``access``, ``hex`` (``BASE``).  Other runs of
20 or more code characters with a letter and a digit are candidates.  For the
encoding it seems to be in, a candidate gets three tests of being random: chi-squared
uniformity over the alphabet, the number of runs above and below the alphabet's middle, and the
correlation of neighbours.  Fisher's sum of the three is its score: the lower, the more random.

What is controlled is the share of false secrets.  The null hypothesis of a candidate is that it is structured: words
and numbers put together.  How such strings score is counted, by class of encoding and length, over strings of that kind
made from the table's texts (``structured``): a text's own words outside of long code runs (a text without: ``WORDS``), from places drawn by
a digest, in the encodings and lengths that the candidates have.  A candidate's p-value is
the part of its class's structured strings with a score as low.  Within each class the Benjamini-Hochberg rule at ``level``
finds the secrets, of kind ``random``.  Short strings, on which the tests have little power, are found only if they
stand out all the same.

Every class that has a candidate gets structured strings, of all its lengths, at least ``LEAST`` or so of each form; how many more, goes with the number
of texts (``plan_of``).  A candidate may have any length: the last class is open, and from 1024 characters on its structured strings have up to
1448.  Longer ones would only score higher, so the share of false secrets stays bounded there.  Texts are read a second time if there are candidates.

Null and empty texts have no spans.  Rows that repeat are scanned each.  An empty table gives an empty result; texts may have any
length; extra columns do not matter.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import name, written
from tidelog.llm.spans import matches

#: Pattern and least length of the base kinds, in the order of ties.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 16),
    "hex": (r"[0-9a-f]{32,}", 32),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encoding: the strings that are in it, and its alphabet in order.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + _LOWER[:6]),
    "base32": ("^[A-Z2-7]+$", _LOWER.upper() + "234567"),
    "base36": ("^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    "base64": ("", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
}
_STEPS = 4  # of Fisher's sum to one bin
_LAST = 20  # class of lengths, without an upper end
#: Structured strings: forms by encoding, and the words of texts that have none.
FORMS = {"base64": ("dashed", "camel"), "base36": ("lower", "upper"), "hex": ("hex",), "base32": ("base32",)}
WORDS = "user data file name config path server client image report account order product customer message content update version release project"
#: Structured strings of each form in a class that has candidates, in small tables; characters of each form that a text gives, at most, in large ones.
LEAST, CHARS = 1000, 128


def _normal_tail(z: str) -> str:
    """P(Z > z), within 0.0002."""
    return f"1 / (1 + exp(least(1.5976 * ({z}) + 0.070566 * pow({z}, 3), 700)))"


def battery(m: str) -> str:
    """SQL for a struct of encoding, length and Fisher's sum, in bins, of string ``m``."""
    kind = "CASE " + " ".join(f"WHEN {m} RLIKE '{p}' THEN '{k}'" for k, (p, _) in ENCODINGS.items() if p) + " ELSE 'base64' END"
    folded = f"CASE WHEN {m} RLIKE '^[0-9A-Z]+$' AND ({kind}) IN ('hex', 'base36') THEN lower({m}) ELSE translate({m}, '-_', '+/') END"
    alphabet = "CASE e.kind " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (_, a) in ENCODINGS.items()) + " END"
    # bound step by step, so that nothing is worked out twice
    bind = lambda value, var, body: f"element_at(transform(array({value}), {var} -> {body}), 1)"
    places = f"transform(filter(split(e.t, ''), c -> c <> ''), c -> instr({alphabet}, c) - 1)"
    # the sum of squared counts: the i-th of equal values in order adds 2 i - 1
    squares = "aggregate(sort_array(v.x), named_struct('last', -1, 'i', 0, 'sum', 0D), (a, c) -> named_struct('last', c, 'i', CASE WHEN c = a.last THEN a.i + 1 ELSE 1 END, 'sum', a.sum + CASE WHEN c = a.last THEN 2 * a.i + 1 ELSE 1 END), a -> a.sum)"
    # one walk: characters of the upper half, changes of half, products of neighbours
    start = "named_struct('last', cast(null as int), 'high', 0D, 'turns', 1D, 'products', 0D)"
    step = (
        "(a, c) -> named_struct('last', c, 'high', a.high + CASE WHEN 2 * c >= v.k THEN 1 ELSE 0 END, 'turns', a.turns + CASE WHEN (2 * c >= v.k) <> (2 * a.last >= v.k) THEN 1 ELSE 0 END, "
        "'products', a.products + coalesce((c - (v.k - 1) / 2D) * (a.last - (v.k - 1) / 2D), 0D))"
    )
    counted = f"named_struct('n', v.n, 'k', v.k, 'squares', {squares}, 'w', aggregate(v.x, {start}, {step}))"
    mean = "named_struct('c', c, 'df', c.k - 1D, 'chi', c.k / c.n * c.squares - c.n, 'runs', 1 + 2D * c.w.high * (c.n - c.w.high) / c.n)"
    spread = "sqrt(greatest((r.runs - 1) * (r.runs - 2) / (r.c.n - 1), 0.01))"
    tests = (
        f"array((pow(r.chi / r.df, 1D/3) - (1 - 2 / (9D * r.df))) / sqrt(2 / (9D * r.df)), abs(r.c.w.turns - r.runs) / {spread}, "
        "abs(r.c.w.products) / ((r.c.k * r.c.k - 1) / 12D * sqrt(r.c.n - 1D)))"
    )
    # the first is one-sided
    logs = f"ln(greatest({_normal_tail('z[0]')}, 1e-20)) + ln(greatest(2 * {_normal_tail('z[1]')}, 1e-20)) + ln(greatest(2 * {_normal_tail('z[2]')}, 1e-20))"
    score = f"greatest(0, cast(floor(-2 * {_STEPS} * ({logs})) as int))"
    value = bind(counted, "c", bind(mean, "r", bind(tests, "z", score)))
    tested = f"named_struct('kind', e.kind, 'length', v.n, 'bin', {value})"
    return bind(f"named_struct('kind', {kind}, 't', {folded})", "e", bind(f"named_struct('x', {places}, 'n', length(e.t), 'k', length({alphabet}))", "v", tested))


def _step(length: str) -> str:
    return f"cast(least(floor(log2({length}) * 2), {_LAST}) as int)"


def _class(kind: str, length: str) -> str:
    return f"concat({kind}, ':', {_step(length)})"


def plan_of(rows: DataFrame) -> list[tuple[str, int, int, float]]:
    """Form, least length, end of lengths and strings a text, for each form of each class that has candidates: some 80 at most.

    A text's characters of a form are shared evenly among the classes, so longer strings are fewer; a small table's texts give several strings each."""
    wanted = rows.select(F.explode("candidates").alias("c")).select("c.kind", F.expr(_step("c.length")).alias("step")).distinct().collect()
    total = rows.count() if wanted else 0
    plan = []
    for kind, step in sorted(wanted):
        lo, end = max(20, math.ceil(2 ** (step / 2))), math.ceil(2 ** ((step + 1) / 2))
        rate = min(1.0, 2 * CHARS / sum(w.kind == kind for w in wanted) / (lo + end))
        plan += [(form, lo, end, max(rate, LEAST / total)) for form in FORMS[kind]]
    return plan


def structured(df: DataFrame, plan: list[tuple[str, int, int, float]]) -> DataFrame:
    """``strings``: for each row of doc_id and text that gives any, strings put together from words of the text and numbers, by ``plan``."""
    bind = lambda value, var, body: f"element_at(transform(array({value}), {var} -> {body}), 1)"
    digest = lambda *of: f"shiftrightunsigned(xxhash64({', '.join(of)}), 1)"
    forms = ", ".join(f"named_struct('form', '{f}', 'lo', {lo}, 'end', {end}, 'rate', {rate!r}D)" for f, lo, end, rate in plan)
    # a whole number of strings, whose mean is the rate
    several = f"slice(sequence(1, cast(q.rate as int) + 1), 1, cast(q.rate + {digest('o', 'q.form', 'q.lo')} % 1000003 / 1000003D as int))"
    drawn = f"flatten(transform(array({forms}), q -> transform({several}, j -> named_struct('form', q.form, 'd', {digest('o', 'q.form', 'q.lo', 'j')}, 'lo', q.lo, 'end', q.end))))"
    own = "regexp_extract_all(regexp_replace(text, '[A-Za-z0-9+/_-]{20,}', ' '), '[A-Za-z]+', 0)"
    words = bind(own, "w", f"CASE WHEN size(w) > 0 THEN w ELSE split('{WORDS}', ' ') END")
    # units of up to 16 words, a year and a number, until the length is reached
    lower = "lower(concat(u.y, array_join(slice(u.w, 1, 2), ''), u.i, array_join(slice(u.w, 3, 16), '')))"
    dashed = "concat(u.y, concat_ws(s.sep, slice(u.w, 1, 3), u.i, slice(u.w, 4, 16)))"
    camel = "concat(u.y, concat_ws(u.i, array(array_join(transform(slice(u.w, 1, 2), x -> initcap(x)), ''), array_join(transform(slice(u.w, 3, 16), x -> initcap(x)), ''))))"
    unit = f"CASE s.form WHEN 'dashed' THEN {dashed} WHEN 'camel' THEN {camel} ELSE {lower} END"
    some = "named_struct('w', slice(words, cast(1 + h % greatest(size(words) - 16, 1) as int), 16), 'y', cast(1990 + h div 1009 % 40 as string), 'i', cast(h div 40009 % 10000 as string))"
    units = f"transform(sequence(1, s.n div CASE s.form WHEN 'hex' THEN 16 ELSE 48 END + 1), k -> {bind(digest('s.d', 'k'), 'h', bind(some, 'u', unit))})"
    coded = "CASE s.form WHEN 'upper' THEN upper(t) WHEN 'hex' THEN regexp_replace(t, '[^0-9a-f]', '') WHEN 'base32' THEN translate(upper(t), '0189', 'OIBG') ELSE t END"
    cut = bind(f"array_join({units}, s.sep)", "t", bind(coded, "c", "substr(repeat(c, cast(s.n div length(c) + 1 as int)), 1, s.n)"))
    about = "named_struct('form', r.form, 'd', r.d, 'n', cast(r.lo + r.d div 17 % (r.end - r.lo) as int), 'sep', CASE WHEN r.form <> 'dashed' THEN '' WHEN r.d % 3 = 0 THEN '-' WHEN r.d % 3 = 1 THEN '_' ELSE '/' END)"
    draws = bind("xxhash64(doc_id, text)", "o", drawn)
    rows = df.select("text", F.expr(draws).alias("draws")).where("size(draws) > 0").select("draws", F.expr(words).alias("words"))
    return rows.select(F.expr(f"transform(draws, r -> {bind(about, 's', cut)})").alias("strings"))


def limits_of(rows: DataFrame, level: float) -> dict[str, int]:
    """Class -> the greatest bin that the Benjamini-Hochberg rule calls random.

    At most 1106 bins in each of some 50 classes; counts are partial aggregates."""
    each = lambda c, a, b: rows.select(F.explode(c).alias("c")).select(F.expr(_class("c.kind", "c.length")).alias("class"), F.col("c.bin").alias("bin"), F.lit(a).alias("n"), F.lit(b).alias("nulls"))
    bins = each("candidates", 1, 0).unionAll(each("nulls", 0, 1)).groupBy("class", "bin").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))
    by = Window.partitionBy("class")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select("class", "bin", "n", *(F.sum(c).over(w).alias(f"{c}_{k}") for c in ("n", "nulls") for k, w in (("upto", upto), ("all", by))))
    rule = (F.col("nulls_upto") + 1) * F.col("n_all") <= level * F.col("n_upto") * (F.col("nulls_all") + 1)
    return {r["class"]: r["bin"] for r in ranked.where(rule & (F.col("n") > 0)).groupBy("class").agg(F.max("bin").alias("bin")).collect()}


def _joined(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.lo, ':', s.hi)), ',')"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row."""
    source = df.select(name(id_col).alias("doc_id"), F.coalesce(name(text_col), F.lit("")).alias("text"))
    own = lambda kind, no: f"transform(filter({matches('text', BASE[kind][0], 2 if kind == 'assign' else 0)}, x -> length(x.g) >= {BASE[kind][1]}), x -> named_struct('lo', x.lo, 'no', {no}, 'hi', x.hi, 'kind', '{kind}'))"
    found = source.select("doc_id", "text", *(F.expr(own(k, i)).alias(k) for i, k in enumerate(BASE)))
    base = F.concat(*BASE)
    coded = f"filter({matches('text', CANDIDATE)}, x -> x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]' AND NOT exists(base, b -> b.lo < x.hi AND x.lo < b.hi))"
    found = found.select("doc_id", "text", base.alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE))
    tested = f"transform({coded}, x -> element_at(transform(array({battery('x.m')}), t -> named_struct('lo', x.lo, 'hi', x.hi, 'kind', t.kind, 'length', t.length, 'bin', t.bin)), 1))"
    rows = written(found.select("doc_id", *(f"n_{k}" for k in BASE), "base", F.expr(tested).alias("candidates")), "secrets")
    limits = {}
    if plan := plan_of(rows):
        # written, or a filter that Spark infers for the explosion works all of it out twice
        nulls = written(structured(source, plan).select(F.expr(f"transform(strings, m -> {battery('m')})").alias("nulls")), "structured")
        kinds = "array<struct<kind:string,length:int,bin:int>>"
        none = F.expr(f"cast(array() as {kinds})")
        tests = F.expr("transform(candidates, c -> named_struct('kind', c.kind, 'length', c.length, 'bin', c.bin))")
        both = rows.select(tests.alias("candidates"), none.alias("nulls")).unionAll(nulls.select(none, "nulls"))
        limits = limits_of(both, level)
    limit = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv)) if limits else F.expr("cast(map() as map<string,int>)")
    random = f"transform(filter(candidates, c -> c.bin <= coalesce(limits[{_class('c.kind', 'c.length')}], -1)), c -> named_struct('lo', c.lo, 'no', 3, 'hi', c.hi, 'kind', 'random'))"
    rows = rows.withColumn("limits", limit).withColumn("random", F.expr(random))
    return rows.select(
        "doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("concat(base, random)")).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
