"""Spans of pattern matches in code points, with built-in functions only.

``split`` gives the text between matches and ``regexp_extract_all`` the matches;
one pass over both adds up the lengths. Patterns are written so that Java's matcher
neither recurses nor runs from every place of a long run: possessive quantifiers,
and a look-behind that lets a match begin only where a run does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
CONTEXT = 32  # code points of the text before a match that are kept with it


def find_spans(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None, gate: Column | None = None, context: bool = False) -> Column:
    """Matches as an array of start, end (exclusive), value and what stands before.

    ``valid`` drops matches by their value; ``gate`` says whether a text can have
    any match at all.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        between,
        matches,
        lambda p, m: F.struct(
            F.char_length(p).alias("gap"),
            F.char_length(m).alias("size"),
            m.alias("value"),
            (F.right(p, F.lit(CONTEXT)) if context else F.lit("")).alias("before"),
        ),
    )
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before")))
        out = F.concat(acc["out"], span)
        if valid is not None:
            out = F.when(valid(x["value"]), out).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return found if gate is None else F.when(gate, found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def named(kind: str, spans: Column) -> Column:
    """kind:start:end of each span, in order."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)
