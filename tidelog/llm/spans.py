"""Where a pattern matches, with DataFrame functions only."""

from __future__ import annotations


def literal(text: str) -> str:
    """A SQL string literal."""
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL for the array of (lo, hi, m, g): code points from lo up to hi, the match, its group.

    Texts without a match cost one scan."""
    p = literal(pattern)
    found = f"arrays_zip(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    # the length of what precedes each match, summed up
    step = (
        "(a, x) -> named_struct('at', a.at + length(x['0']) + length(x['1']), 'out', array_append(a.out, "
        "named_struct('lo', a.at + length(x['0']), 'hi', a.at + length(x['0']) + length(x['1']), 'm', x['1'], 'g', x['2'])))"
    )
    empty = "cast(array() as array<struct<lo:int,hi:int,m:string,g:string>>)"
    return f"CASE WHEN {text} RLIKE {p} THEN aggregate({found}, named_struct('at', 0, 'out', {empty}), {step}, a -> a.out) ELSE {empty} END"
