"""Predicates and scores by rule.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, comparison_text, strip_to_prose, trim_all

# Patterns of page layout.
STOP_HEADINGS = [r"(?i)\A\s*\d*\.?\s*references\s*\z", r"(?i)\A\s*\d*\.?\s*appendix\b", r"(?i)\A\s*\d*\.?\s*acknowledgm", r"(?i)\A\s*\d+[.:]?\s+references\b"]
CAPTION = r"(?i)\A\s*(figure|fig\.|table|tbl\.)\s*\d+"
MATH_FONTS = ["math", "cmmi", "cmsy", "cmex", "cmr", "symbol", "stix", "asana", "cambria math", "msbm", "msam", "eufm", "rsfs", "lmmath", "latinmodern-math", "xits", "dejavu math"]
MATH_SYMBOLS = "[∑∏∫∂√≤≥≠≈∈∉⊂⊃∪∩∀∃→←↔⇒⇐⊆⊇±×÷∞∝∇αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]"
SECTION_TAGS = [
    ("abstract", "abstract"),
    ("introduction", "introduction"),
    ("related_work", r"related\s*work|background|literature\s*review"),
    ("method", "method|approach|methodology|model|framework|proposed"),
    ("experiment", "experiment|evaluation|results|empirical|experimental"),
    ("conclusion", r"conclusion|conclusions|discussion|future\s*work"),
]
# Status codes and words of failures.
RETRYABLE = [408, 409, 425, 429, 500, 502, 503, 504, 529]
OVERLOAD_WORDS = ["overloaded", "overload", "rate limit", "too many requests", "server busy", "capacity"]
TRUNCATION_WORDS = ["length", "max_tokens", "max tokens", "max_output_tokens", "output_length", "token_limit", "token limit"]
# Sections that are left out of a plan.
IGNORABLE = [
    r"\breferences?\b", r"\bbibliography\b", "参考文献", r"\bappendix\b", "附录", r"\bsupplement(?:ary|al)?\b", "补充材料", "补充说明", "补充实验",
    r"\backnowledg(?:e)?ments?\b", "致谢", r"\bauthor contributions?\b", "作者贡献", r"\bethics?(?: statement)?\b", "伦理声明", r"\bdata availability\b", "数据可用性",
]


def any_of(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_stop_heading(text: Column) -> Column:
    t = trim_all(text)
    return (F.char_length(t) <= 120) & any_of(t, STOP_HEADINGS)


def is_caption(text: Column) -> Column:
    return trim_all(text).rlike(CAPTION)


def is_math_font(family: Column, name: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(family, F.lit("")), F.lit("\n"), F.coalesce(name, F.lit(""))))
    out = F.lit(False)
    for p in MATH_FONTS:
        out = out | F.contains(both, F.lit(p))
    return out


def is_formula_fragment(text: Column, height: Column, median: Column, family: Column, name: Column) -> Column:
    t = trim_all(text)
    n = F.char_length(t)
    return (n > 0) & (is_math_font(family, name) | ((n <= 3) & t.rlike(MATH_SYMBOLS)) | ((height > 0) & (height < median * 0.65) & (n <= 5)))


def is_table_cell(text: Column, height: Column, median: Column) -> Column:
    t = trim_all(text)
    n = F.char_length(t)
    numeric = n - F.char_length(F.regexp_replace(t, r"[\d.%±,\-/]", ""))
    return (n > 0) & (n <= 20) & (numeric / n > 0.7) & (height > 0) & (height <= median * 1.1)


def is_heading(text: Column, height: Column, median: Column) -> Column:
    n = F.char_length(trim_all(text))
    return (n > 0) & (n <= 120) & ((height > median * 1.35) | ((height > median * 1.15) & (n < 50)))


def heading_tag(text: Column) -> Column:
    t = trim_all(text)
    out = F.lit("other")
    for tag, names in reversed(SECTION_TAGS):
        out = F.when(t.rlike(rf"(?i)\A\s*\d*\.?\s*({names})\s*\z"), tag).otherwise(out)
    return out


def strip_formula_delimiters(formula: Column) -> Column:
    for p in (r"\A\$\$?", r"\$\$?\z", r"\A\\\[", r"\\\]\z", r"\A\\begin\{equation\*?\}", r"\\end\{equation\*?\}\z"):
        formula = F.regexp_replace(formula, p, "")
    return trim_all(formula)


def is_trivial_formula(formula: Column) -> Column:
    inner = F.regexp_replace(strip_formula_delimiters(formula), r"\s+", "")
    n = F.char_length(inner)
    return (
        F.when(n <= 2, True).when(inner.rlike(r"[=<>+\-*/]"), False).when(inner.rlike(r"\\(?:frac|sum|prod|operatorname|mathrm|softmax|argmax|argmin)"), False)
        .when(inner.rlike(r"[()\[\]{}]") & (n >= 8), False).when(inner.rlike(r"[\^_]") & (n >= 6), False)
        .otherwise(inner.rlike(r"\A\\?[A-Za-z]+(?:_[A-Za-z0-9{}]+|\^[A-Za-z0-9{}]+)*\z"))
    )


def visible_length(content: Column) -> Column:
    for p, to in ((r"(?s)```.*?```", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\\[a-zA-Z]+(\{[^}]*\})*", ""), (r"[#>*_`~|\-\\{}\[\]()]", " ")):
        content = F.regexp_replace(content, p, to)
    return F.char_length(collapse(content))


def is_substantive(content: Column, path: Column) -> Column:
    n = visible_length(content)
    last = F.lower(trim_all(F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))))
    return (n >= 80) | ((last != "document") & (n >= 30))


def _haystack(path: Column, excerpt: Column, content: Column, most: int) -> Column:
    return F.lower(F.concat(F.array_join(path, " "), F.lit(" "), excerpt, F.lit(" "), F.substring(content, 1, most)))


def is_ignorable(path: Column, excerpt: Column, content: Column) -> Column:
    return any_of(_haystack(path, excerpt, content, 240), IGNORABLE)


def is_source_leak(answer: Column, source: Column) -> Column:
    a, s = comparison_text(answer), comparison_text(source)
    start = F.substring(s, 1, 160)
    return (a != "") & (s != "") & ((a == s) | ((F.char_length(a) >= 120) & F.contains(s, a)) | ((F.char_length(start) >= 80) & F.contains(a, start)))


def has_chinese(text: Column) -> Column:
    return text.rlike("[\\u3400-\\u9fff]")


def lacks_language(answer: Column, language: str) -> Column:
    prose = strip_to_prose(answer)
    return (F.char_length(prose) >= 24) & ~has_chinese(prose) if language == "zh-CN" else F.lit(False)


def is_insufficient(answer: Column, source: Column, language: str = "en", least: int = 60) -> Column:
    """For sections; formulas take ``least`` 40."""
    t = trim_all(answer)
    return (t == "") | lacks_language(t, language) | is_source_leak(t, source) | (F.char_length(strip_to_prose(t)) < least)


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def is_overloaded(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    word = F.lit(False)
    for w in OVERLOAD_WORDS:
        word = word | F.contains(low, F.lit(w))
    return F.when(status.isin(429, 529), True).when(status == 503, word).otherwise(word & (status.isNull() | is_retryable(status)))


def is_truncated(stop_reason: Column) -> Column:
    low = F.lower(trim_all(F.coalesce(stop_reason, F.lit(""))))
    out = F.lit(False)
    for w in TRUNCATION_WORDS:
        out = out | F.contains(low, F.lit(w))
    return out


# What an error says that a later try may not.
TRANSPORT_WORDS = ["timeout", "timed out", "network", "econnreset", "econnrefused", "socket hang up", "fetch failed", "temporarily unavailable"]
# The layout of dates in headers, without the day of the week.
HTTP_DATE, HTTP_LAYOUT = r"\A[A-Za-z]{3}, *(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", "d MMM yyyy HH:mm:ss xx"


def is_transport_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    word = F.lit(False)
    for w in TRANSPORT_WORDS:
        word = word | F.contains(low, F.lit(w))
    return word


def asked_delay_ms(retry_after: Column, now: Column | None = None) -> Column:
    """What a server asks to wait, as seconds or as a date (then from ``now``, the present by default); null otherwise."""
    value = trim_all(retry_after)
    seconds = F.when(value.rlike(r"\A\+?(\d+\.?\d*|\.\d+)\z"), F.round(value.try_cast("double") * 1000))
    dated = F.nullif(F.regexp_extract(value, HTTP_DATE, 1), F.lit(""))
    at = F.coalesce(F.try_to_timestamp(F.concat(dated, F.lit(" +0000")), F.lit(HTTP_LAYOUT)), F.when(value.rlike(r"\A\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value)))
    left = F.unix_millis(at) - F.unix_millis(F.current_timestamp() if now is None else now)
    return F.coalesce(seconds, F.when(left.isNotNull(), F.greatest(left, F.lit(0)))).cast("long")


def retry_delay_ms(attempt: Column, retry_after: Column | None = None, base: int = 1000, most: int = 8000, now: Column | None = None) -> Column:
    """Doubling delays, or what the server asks for, up to ``most``."""
    own = F.lit(base) * F.pow(F.lit(2), F.greatest(attempt, F.lit(0)))
    asked = F.lit(None).cast("long") if retry_after is None else asked_delay_ms(retry_after, now)
    return F.least(F.coalesce(asked, own), F.lit(most)).cast("long")


def retry_token_budget(tokens: Column, most: int = 3200) -> Column:
    return F.least(F.lit(most), F.greatest(tokens + 400, tokens * 2))


def one_of(value: Column, allowed: list[str], fallback: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(fallback)


def hex_color(value: Column, fallback: str = "#ffd400") -> Column:
    """Six lower-case digits; three are doubled."""
    v = F.lower(trim_all(value))
    return F.when(v.rlike(r"\A#[0-9a-f]{6}\z"), v).when(v.rlike(r"\A#[0-9a-f]{3}\z"), F.regexp_replace(v, "([0-9a-f])", "$1$1")).otherwise(fallback)


def color_number(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 2, 6), 16, 10).cast("int")


def aliases(names: Column, fallback: list[str]) -> Column:
    """Trimmed, without repeats in other case (the first spelling stays); the fallback if none is left."""
    clean = F.filter(F.transform(names, trim_all), lambda x: x != "")
    first = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.when(F.size(first) > 0, first).otherwise(F.array(*[F.lit(f) for f in fallback]))
