"""Text expressions.  All are Column in, Column out, and null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no relevance.
STOP_WORDS = """
a an and are as at be by for from has he in is it its of on that the to was were will with this but they have
had what when where who which why how not all can been being each few more most other some such no nor too very
just into out if then than so also do did does our we us me my you your
""".split()

#: What counts as white space in expressions.
BLANKS = " \t\n\x0b\f\r"


def terms(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def tokenize(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of two characters or more that are no stop words."""
    return F.filter(terms(text), lambda w: ~is_stop_word(w))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markdown_inline(text: Column) -> Column:
    """Without images, link targets, a leading heading mark and emphasis marks."""
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\A\s*#+\s*", "")
    return collapse(F.regexp_replace(text, "[*_`~]", ""))


def normalize_heading(text: Column) -> Column:
    return F.lower(strip_markdown_inline(text))


def shorten(text: Column, most: int = 120) -> Column:
    """At most ``most`` characters; longer text ends in three dots."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def excerpt(text: Column) -> Column:
    return shorten(strip_markdown_inline(text))


def strip_to_prose(text: Column) -> Column:
    """Without code, formulas, callouts, quotes, images, links and marks."""
    for pattern, to in (
        (r"(?s)```.*?```", " "), (r"(?s)\$\$.*?\$\$", " "), (r"\$[^$\n]+\$", " "), (r"(?m)^>\s*\[![^\]]+\][^\n]*$", " "),
        (r"(?m)^>\s?", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", " "), (r"[>*`|]", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return collapse(text)


def comparison_text(text: Column) -> Column:
    return F.lower(strip_to_prose(text))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_leading_headings(text: Column) -> Column:
    # possessive: otherwise each heading takes a part of the stack
    return _trim(F.regexp_replace(_trim(unix_lines(text)), r"\A(?:#{1,6}\s+[^\n]+\n\s*)++", ""))


def normalize_markdown(text: Column) -> Column:
    text = F.regexp_replace(strip_leading_headings(text), r"[ \t](?<![ \t]{2})[ \t]*+\n", "\n")  # tries a run of blanks once
    return _trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_remote(text: Column) -> Column:
    return _trim(F.regexp_replace(unix_lines(text), r"\n{3,}", "\n\n"))


def strip_images(text: Column) -> Column:
    return normalize_remote(F.regexp_replace(_trim(unix_lines(text)), r"!\[[^\]]*\]\([^)]*\)", ""))


def upgrade_inline_math(text: Column) -> Column:
    """A line that holds a single $formula$ becomes a display block."""
    return F.regexp_replace(text, r"(?m)^[ \t]*\$(?!\$)([^$\n]+)\$[ \t]*$", "\\$\\$\n$1\n\\$\\$")


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


trim_all = _trim


def fnv1a(text: Column) -> Column:
    """FNV-1a with 32 bits over code points, as 8 hexadecimal digits."""
    chars = F.when(F.char_length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    value = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def context_around(page: Column, selection: Column, window: int = 500, elaborate: Column | None = None) -> Column:
    """``window`` characters on both sides of the first hit (three times as many if ``elaborate``); without one, of
    the hit with white space collapsed; else empty."""
    reach = F.lit(window) if elaborate is None else F.when(elaborate, window * 3).otherwise(window)

    def cut(text: Column, needle: Column) -> Column:
        at = F.instr(text, needle)
        first = F.greatest(at - reach, F.lit(1))
        return F.when((at > 0) & (needle != ""), F.substring(text, first, at - first + F.char_length(needle) + reach))

    return F.coalesce(cut(page, selection), cut(collapse(page), collapse(selection)), F.lit(""))


def selection_kind(selection: Column) -> Column:
    trimmed = _trim(selection)
    return F.when((F.char_length(trimmed) <= 30) & ~trimmed.rlike(r"\s"), "word").otherwise("sentence")


def first_sentence_reason(abstract: Column, fallback: str = "Shares a citation with the paper and treats a related topic.") -> Column:
    """The first sentence of 20 to 260 characters, else the first 220 characters; the fallback without any."""
    text = _trim(F.coalesce(abstract, F.lit("")))
    sentence = F.regexp_extract(text, r"\A[^.!?。！？\n]{20,260}[.!?。！？]", 0)
    return F.when(text == "", fallback).otherwise(_trim(F.when(sentence != "", sentence).otherwise(F.substring(text, 1, 220))))


def jaccard_trigrams(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of character trigrams; null where both have none."""

    def grams(x: Column) -> Column:
        last = F.char_length(x) - 2
        return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    ga, gb = grams(a), grams(b)
    union = F.size(F.array_union(ga, gb))
    return F.when(union > 0, F.size(F.array_intersect(ga, gb)) / union)
