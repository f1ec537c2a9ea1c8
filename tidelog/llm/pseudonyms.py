"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

Card numbers (Luhn), telephone and social security numbers, IPv4 addresses and dates (of the
calendar, 1900 to 2099) are numbered within their format and permuted by a keyed Feistel network: the halves of
a number are below ``a`` and ``b``, and each round adds a keyed digest of one to the other.  The
map is one to one on each format and never leaves it, so equal values stay linked across documents, different
ones stay apart, and a pseudonym is again a valid card, number or date.  A number keeps its separators,
a card its first digit, a telephone number its country's first digit.  E-mail addresses have no numeric
format; each becomes a keyed digest at a domain that cannot exist.

Cards are looked for at every place and in every fixed grouping, and checked before the text is cut into
matches, so that no number beside one hides it.  What fails its check (a Luhn sum, a day that is not in the calendar) stays
and is not counted.  Where two forms begin at one place, the first of e-mail, IP, dates, cards, social security and telephone counts.
Day-first dates are tried before month-first ones.

The key is a parameter or the session's ``spark.tidelog.pseudonym.secret``; there is no default.  It is read from a
one-row relation, so that plans do not show it.

Null texts stay null, empty texts and texts without personal data stay as they are.  Rows that repeat are changed alike, an empty
table stays empty, a text of any length is one value.  Columns of any name pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, name
from tidelog.llm.spans import literal

#: The forms.  No group captures.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.[0-9])",
    "iso": r"(?<![\w-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![\w-])",
    "day": r"(?<![\w/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)(?:19|20)[0-9]{2}(?![\w/])",
    "ssn": r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])",
    "plus1": r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)",
    "plus": r"(?<![\w+])\+[2-9](?:[0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:(?:[ .-]?[0-9]{2}){4}|(?:[ .-]?[0-9]{3,4}){2,3})|[0-9]?[ .-]?(?:\(0\) ?)?[0-9]{2,5}[ .-]?[0-9]{3,8}|[0-9]{7,14})(?!\w)",
    "phone": r"(?<![\w+])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)",
}
#: Groups of a card's digits; each with one separator throughout, or none.
GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
CARDS = ["[0-9]{13,19}", *(s.join(f"[0-9]{{{n}}}" for n in g) for g in GROUPS for s in (" ", "-"))]
_FIRST, _LAST = ("|".join(f"(?:{FORMS[f]})" for f in own) for own in (("email", "ip", "iso", "day"), ("ssn", "plus1", "plus", "phone")))
ROUNDS = 10
#: Days from 1900-01-01 through 2099-12-31, and two factors of that number.
_DAYS = (17, 4297)
#: Turns of walking on until a value is in its form again; each turn fails for 2 of 5 values at most.
_WALK = 60


def _let(value: str, var: str, body: str) -> str:
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def feistel(x: str, a: str, b: str, form: str, key: str) -> str:
    """SQL for the permutation of 0 <= x < a * b; ``key`` is SQL too."""
    digest = f"cast(conv(substr(sha2(concat({key}, '|{form}|', i, '|', s.r), 256), 1, 14), 16, 10) as bigint)"
    step = f"(s, i) -> named_struct('l', s.r, 'r', pmod(s.l + {digest}, CASE WHEN i % 2 = 0 THEN f.a ELSE f.b END))"
    body = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', f.x div f.b, 'r', f.x % f.b), {step}, s -> s.l * f.b + s.r)"
    return _let(f"named_struct('x', cast({x} as bigint), 'a', cast({a} as bigint), 'b', cast({b} as bigint))", "f", body)


def _digits(d: str, form: str, key: str) -> str:
    """SQL: a string of the same number of digits."""
    half = f"cast(pow(10, length({d}) div 2) as bigint)"
    rest = f"cast(pow(10, length({d}) - length({d}) div 2) as bigint)"
    return f"lpad(cast({feistel(d, half, rest, form, key)} as string), length({d}), '0')"


def _luhn(d: str) -> str:
    """SQL: the Luhn sum of a digit string, its last digit counted once."""
    at = f"cast(substr({d}, length({d}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, j) -> t + CASE WHEN j % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)"


def _plain(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _filled(template: str, digits: str) -> str:
    """SQL: ``template`` with its digits replaced, in order, by ``digits``."""
    step = "(s, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN named_struct('o', concat(s.o, substr(q.d, s.n + 1, 1)), 'n', s.n + 1) ELSE named_struct('o', concat(s.o, c), 'n', s.n) END"
    return _let(f"named_struct('d', {digits}, 't', {template})", "q", f"aggregate(split(q.t, ''), named_struct('o', '', 'n', 0), {step}, s -> s.o)")


def cards(text: str) -> str:
    """SQL: the valid cards of a text, longest first, wherever they begin."""
    at = lambda form: f"regexp_extract_all({text}, {literal(rf'(?<!\w)(?=({form})(?!\w))')}, 1)"
    valid = _let(_plain("c"), "d", f"{_luhn('d')} % 10 = 0")
    any_form = literal(r"[0-9](?:[ -]?[0-9]){12}")
    return f"CASE WHEN {text} RLIKE {any_form} THEN array_distinct(filter(concat({', '.join(map(at, CARDS))}), c -> {valid})) ELSE cast(array() as array<string>) END"


def _area(d: str, form: str, key: str) -> str:
    """SQL for ten digits: those that begin with 2 to 9 are permuted among themselves, and the others too."""
    high = feistel(f"cast({d} as bigint) - 2000000000", "800", "10000000", form, key)
    low = feistel(d, "200", "10000000", form + "0", key)
    return f"CASE WHEN {d} >= '2' THEN cast(2000000000 + {high} as string) ELSE lpad(cast({low} as string), 10, '0') END"


def pseudonym(m: str, own: str, key: str) -> str:
    """SQL for what replaces the match ``m``; null if it fails its check.  ``own``: the text's valid cards."""
    is_form = lambda form: f"{m} RLIKE {literal('^(?:' + FORMS[form] + ')$')}"
    email = f"concat('u', substr(sha2(concat({key}, '|email|', lower({m})), 256), 1, 16), '@masked.invalid')"
    number = f"aggregate(split({m}, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))"
    ip = _let(feistel(number, "65536", "65536", "ip", key), "y", "concat_ws('.', y div 16777216, y div 65536 % 256, y div 256 % 256, y % 256)")
    start = "DATE'1900-01-01'"
    moved = lambda t: f"date_add({start}, cast({feistel(f'datediff({t}, {start})', *map(str, _DAYS), 'date', key)} as int))"
    # days above 12 are permuted among themselves: on until the next one
    late = lambda t: f"aggregate(sequence(1, {_WALK}), {moved(t)}, (w, j) -> CASE WHEN day(w) > 12 THEN w ELSE {moved('w')} END)"
    parsed = lambda y, mo, d: f"try_to_date(concat_ws('-', substr({m}, {y}, 4), substr({m}, {mo}, 2), substr({m}, {d}, 2)), 'yyyy-MM-dd')"
    # the day in the order it was written in, between the same signs
    shown = lambda first, second: f"concat(date_format(w, '{first}'), substr({m}, 3, 1), date_format(w, '{second}'), substr({m}, 6, 1), date_format(w, 'yyyy'))"
    iso = _let(parsed(1, 6, 9), "t", f"CASE WHEN t IS NOT NULL THEN cast({moved('t')} as string) END")
    day = (
        f"CASE WHEN {parsed(7, 4, 1)} IS NOT NULL THEN {_let(moved(parsed(7, 4, 1)), 'w', shown('dd', 'MM'))} "
        f"WHEN {parsed(7, 1, 4)} IS NOT NULL THEN {_let(late(parsed(7, 1, 4)), 'w', shown('MM', 'dd'))} END"
    )
    head = f"concat(substr(g, 1, 1), {_digits('substr(g, 2, length(g) - 2)', 'card', key)})"
    card = _let(_plain(m), "g", _let(head, "h", _filled(m, f"concat(h, cast((10 - {_luhn('concat(h, ' + repr('0') + ')')} % 10) % 10 as string))")))
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area, each = "cast(substr(g, 1, 3) as int)", 99 * 9999
    rank = f"({area} - 1 - CASE WHEN {area} > 666 THEN 1 ELSE 0 END) * {each}L + (cast(substr(g, 4, 2) as int) - 1) * 9999 + cast(substr(g, 6) as int) - 1"
    unranked = f"concat(lpad(y div {each} + 1 + CASE WHEN y div {each} > 664 THEN 1 ELSE 0 END, 3, '0'), lpad(y % {each} div 9999 + 1, 2, '0'), lpad(y % 9999 + 1, 4, '0'))"
    ssn = _let(_plain(m), "g", _let(feistel(rank, "898", str(each), "ssn", key), "y", _filled(m, unranked)))
    plus1 = _let(_plain(m), "g", _let("substr(g, 2)", "h", _filled(m, f"concat('1', {_area('h', 'phone', key)})")))
    plus = _let(_plain(m), "g", f"CASE WHEN length(g) BETWEEN 8 AND 15 THEN {_filled(m, f'concat(substr(g, 1, 1), {_digits("substr(g, 2)", "plus", key)})')} END")
    phone = _let(_plain(m), "g", _filled(m, _area("g", "phone", key)))
    return (
        f"CASE WHEN array_contains({own}, {m}) THEN {card} WHEN {is_form('email')} THEN {email} WHEN {is_form('ip')} THEN {ip} WHEN {is_form('iso')} THEN {iso} "
        f"WHEN {is_form('day')} THEN {day} WHEN {is_form('ssn')} THEN {ssn} WHEN {is_form('plus1')} THEN {plus1} WHEN {is_form('plus')} THEN {plus} ELSE {phone} END"
    )


def replaced(text: str, key: str) -> str:
    """SQL for a struct of the text with pseudonyms and of how many it got."""
    cut = rf"concat({literal(_FIRST + '|')}, CASE WHEN size(z.own) = 0 THEN '' ELSE concat({literal(r'(?<!\w)(?:')}, array_join(z.own, '|'), {literal(r')(?!\w)|')}) END, {literal(_LAST)})"
    parts = f"named_struct('m', regexp_extract_all({text}, y.p, 0), 'p', split({text}, y.p, -1), 'own', y.own)"
    made = f"named_struct('m', x.m, 'p', x.p, 'r', transform(x.m, m -> {pseudonym('m', 'x.own', key)}))"
    out = "named_struct('text', concat(array_join(zip_with(slice(w.p, 1, size(w.m)), zip_with(w.r, w.m, (r, m) -> coalesce(r, m)), (b, r) -> concat(b, r)), ''), element_at(w.p, -1)), 'n', cast(size(filter(w.r, r -> r IS NOT NULL)) as bigint))"
    body = _let(f"named_struct('own', {cards(text)})", "z", _let(f"named_struct('own', z.own, 'p', {cut})", "y", _let(parts, "x", _let(made, "w", out))))
    some = literal(f"{_FIRST}|{_LAST}|{CARDS[0]}|[0-9]{{4}}[ -][0-9]{{4,6}}[ -][0-9]{{4,5}}")
    return f"CASE WHEN {text} RLIKE {some} THEN {body} ELSE named_struct('text', {text}, 'n', 0L) END"


def pseudonymise(df: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; ``count_col``: adds how many were replaced (or takes that column's place)."""
    spark = df.sparkSession
    key = key or spark.conf.get("spark.tidelog.pseudonym.secret", None)
    if not key:
        raise ValueError("no key: give one, or set spark.tidelog.pseudonym.secret")
    k, z = fresh(df.columns, "k"), fresh(df.columns, "z")
    secret = spark.sql("SELECT k FROM VALUES (:k) AS t(k)", args={"k": key}).scalar()
    text = "`" + text_col.replace("`", "``") + "`"
    made = df.withColumn(k, secret).withColumn(z, F.expr(replaced(text, k)))
    kept = [c for c in df.columns if count_col is None or c.lower() != count_col.lower()]
    columns = [F.col(f"{z}.text").alias(c) if c == text_col else name(c) for c in kept]
    return made.select(*columns, *([F.col(f"{z}.n").alias(count_col)] if count_col else []))
