"""Folded forms of text by expressions: compatibility decomposition, lower case, white space as blanks.

The decompositions come from a table that is built by rule from the Unicode data of the standard library, a row
for each code point beyond ASCII that folds to something else.  A text is folded by one replacement for each of
its distinct code points of that kind; folded strings fold to themselves, so the order does not matter.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points beyond ASCII that count as white space.
SPACES = "                 　﻿"
FORMS = ("light", "heavy", "dense")
_BLANK = r"[ \t\n\x0B\f\r]"


def fold(char: str) -> str:
    """A code point decomposed and lower-cased, white space as a blank; a soft hyphen is nothing."""
    out = unicodedata.normalize("NFKD", char).replace("­", "").lower()
    return "".join(" " if c in SPACES else c for c in out)


@lru_cache(1)
def fold_table() -> dict[str, str]:
    """Every code point beyond ASCII that does not fold to itself."""
    points = (chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    return {c: f for c in points if (f := fold(c)) != c}


#: Code points below this (Latin, Greek, Cyrillic and others) have a table of their own, which is small.
NEAR = "\u0600"


@lru_cache(2)
def _slots(near: bool) -> tuple[str, list[str]]:
    """Code points of a part of the table, those of longest folded strings first, and for the first, second, ... character
    of folded strings these characters; code points without one come last, as ``translate`` takes them out."""
    rows = sorted(((c, f) for c, f in fold_table().items() if (c < NEAR) == near), key=lambda x: -len(x[1]))
    return "".join(c for c, _ in rows), ["".join(f[k] for _, f in rows if len(f) > k) for k in range(len(rows[0][1]))]


def fold_char(char: Column) -> Column:
    """The folded form of one code point."""

    def looked_up(near: bool) -> Column:
        points, slots = _slots(near)
        return F.when(F.translate(char, points, "") != "", char).otherwise(F.concat(*[F.translate(char, points, s) for s in slots]))

    return F.when(char < "\u0080", F.lower(char)).when(char < NEAR, looked_up(True)).otherwise(looked_up(False))


def fold_pairs(text: Column) -> Column:
    """Array of (c, f): the distinct code points beyond ASCII of ``text`` and what they fold to."""
    others = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    return F.transform(others, lambda c: F.struct(c.alias("c"), fold_char(c).alias("f")))


def folded_by(text: Column, pairs: Column) -> Column:
    """``text`` with all its code points folded, white space as it is; ``pairs`` are the ``fold_pairs`` of it or of more."""
    return F.lower(F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["c"], p["f"])))


def folded(text: Column) -> Column:
    return folded_by(text, fold_pairs(text))


def squeezed(raw: Column, form: str) -> Column:
    """The form of a folded text: ``light``; ``heavy``, where all but a-z and 0-9 is a blank; ``dense``, heavy without
    blanks.  Runs of blanks are one, with none at the ends."""
    if form == "dense":
        return F.regexp_replace(raw, "[^a-z0-9]+", "")
    pattern = _BLANK + "+" if form == "light" else "[^a-z0-9]+"
    return F.trim(F.regexp_replace(raw, pattern, " "))


def place_of(text: Column, pairs: Column, form: Column, number: Column, size: Column) -> Column:
    """struct(begin, end): the places in ``text`` where a span begins, or ends, with the character of that number in its
    form, which has ``size`` characters.  A blank goes with the character after it, and what comes after the form with the text's end.

    The form of a prefix grows with the prefix, so the shortest one that has the character is sought between two prefixes.
    A code point mostly makes one character at most, so the next prefix to try is as many code points from the longer, or
    the shorter, as characters are missing there; every third one is half way, whatever code points make.
    """
    chars = F.char_length(text)

    def reach(k: Column) -> Column:
        raw = folded_by(F.substring(text, F.lit(1), k), pairs)
        return F.char_length(F.when(form == "light", squeezed(raw, "light")).when(form == "heavy", squeezed(raw, "heavy")).otherwise(squeezed(raw, "dense")))

    def bounds(low: Column, low_has: Column, high: Column, high_has: Column) -> Column:
        return F.struct(low.alias("low"), low_has.alias("low_has"), high.alias("high"), high_has.alias("high_has"))

    last = F.least(number, size - 1)

    def narrow(acc: Column, turn: Column) -> Column:
        from_high, from_low = acc["high"] - acc["high_has"] + last, acc["low"] + last + 1 - acc["low_has"]
        guess = F.when(turn % 3 == 0, from_high).when(turn % 3 == 1, from_low).otherwise(F.floor((acc["low"] + acc["high"]) / 2).cast("int"))
        k = F.greatest(acc["low"] + 1, F.least(acc["high"] - 1, guess))
        tried = F.transform(F.array(reach(k)), lambda has: F.when(has > last, bounds(acc["low"], acc["low_has"], k, has)).otherwise(bounds(k, has, acc["high"], acc["high_has"])))[0]
        return F.when(acc["high"] - acc["low"] > 1, tried).otherwise(acc)

    steps = F.sequence(F.lit(0), 3 * F.ceil(F.log2(chars + 1)).cast("int") + 2)
    high = F.when(size == 0, chars).otherwise(F.aggregate(steps, bounds(F.lit(0), F.lit(0), chars, size), narrow)["high"])
    return F.transform(F.array(high), lambda end: F.struct(F.when(number < size, end - 1).otherwise(chars).alias("begin"), end.alias("end")))[0]
