"""Parsing of model responses: JSON salvage, text of both response shapes, failures, streamed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions.text import collapse, trim_all

FENCE = r"\A```(?:[A-Za-z0-9_-]+)?\s*\n?"


def json_or_inner(text: Column) -> Column:
    """VARIANT of the whole text, else of the part from the first { to the last }; else null."""
    t = trim_all(text)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(t), F.when(inner != "", F.try_parse_json(inner)))


def _before_last(text: Column, mark: str) -> Column:
    """What is before the last ``mark``; all without one."""
    after = F.char_length(F.substring_index(text, mark, -1))
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.lit(1), F.char_length(text) - after - len(mark))).otherwise(text)


def unfence(text: Column) -> Column:
    """The body of a single code fence, also of one that is not closed."""
    t = trim_all(text)
    body = F.regexp_replace(t, FENCE, "")
    body = _before_last(body, "```")
    return F.when(t.rlike(FENCE), trim_all(body)).otherwise(t)


def dangling_fence(text: Column) -> Column:
    return F.regexp_count(text, F.lit("```")) % 2 == 1


def looks_truncated(text: Column) -> Column:
    """JSON by its looks that does not parse and has no closing bracket."""

    def cut(x: Column) -> Column:
        t, u = x["whole"], x["inner"]
        json_fence = t.rlike(r"(?i)\A```json\b")
        alike = json_fence | u.rlike(r"\A[\[{]") | u.rlike(r'"(?:markdown|revisionRequests|sectionPlans|formulaPointerIds|tutorialTitle)"\s*:')
        return (t != "") & json_or_inner(t).isNull() & json_or_inner(u).isNull() & alike & ((json_fence & dangling_fence(t)) | ~u.rlike(r"[}\]]\s*\z"))

    return _once(_whole_and_inner(text), cut)


def salvaged_field(text: Column, name: str = "markdown") -> Column:
    """The string value of a field in broken JSON, up to its closing quote or the end, unescaped; else empty."""
    begin = F.regexp_extract(text, rf'"{name}"\s*:\s*"', 0)
    rest = F.when(begin != "", F.substring(text, F.instr(text, begin) + F.char_length(begin), F.char_length(text))).otherwise("")
    plain = F.regexp_replace(rest, r"(?s)\\.", "__")  # escaped pairs, so that a quote ends the value; as long as the rest
    end = F.instr(plain, '"')
    size = F.when(end > 0, end - 1).otherwise(F.char_length(plain) - plain.endswith("\\").cast("int"))  # half a pair goes
    raw = F.substring(rest, F.lit(1), size)
    whole = F.regexp_replace(raw, r"\n", "\\\\n")
    return trim_all(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), whole, F.lit('"}')), "$.v"), F.lit("")))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole_and_inner(text: Column) -> Column:
    """struct(whole, inner): a text trimmed, and that without a fence around it."""
    return _once(trim_all(text), lambda t: F.struct(t.alias("whole"), unfence(t).alias("inner")))


def markdown_of(raw: Column) -> Column:
    """Markdown from a response: a JSON string or its field markdown, salvaged from broken JSON, unfenced, or as it is;
    empty for JSON without it."""

    def direct(v: Column) -> Column:
        own = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_string_field(v, "markdown"))
        return F.nullif(trim_all(F.coalesce(own, F.lit(""))), F.lit(""))

    def found(x: Column) -> Column:
        rest = F.when(x["inner"].rlike(r"\A[\[{]"), "").otherwise(x["inner"])
        return F.coalesce(_once(json_or_inner(x["whole"]), direct), F.nullif(salvaged_field(x["inner"]), F.lit("")), _once(json_or_inner(x["inner"]), direct), rest)

    return _once(_whole_and_inner(raw), found)


def strip_thinking(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))


def response_text(provider: Column, body: Column) -> Column:
    """struct(text, stop_reason, truncated) of a response body in either shape."""
    v = F.try_parse_json(body)
    anthropic = provider == "anthropic"

    def text_at(path: str) -> Column:
        content = F.try_variant_get(v, path, "variant")
        blocks = F.try_variant_get(content, "$", "array<variant>")
        texts = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).otherwise(F.try_variant_get(b, "$.text", "string")))
        joined = F.array_join(F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
        return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit("{}")))

    def first_at(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])

    own = ("$.finish_reason", "$.finishReason", "$.stop_reason", "$.stopReason")
    stop = F.when(anthropic, first_at("$.stop_reason", "$.stopReason")).otherwise(first_at(*[f"$.choices[0]{p[1:]}" for p in own], *own))
    text = F.when(v.isNull(), "{}").otherwise(strip_thinking(F.when(anthropic, text_at("$.content")).otherwise(text_at("$.choices[0].message.content"))))
    return F.struct(text.alias("text"), stop.alias("stop_reason"), rules.is_truncated(stop).alias("truncated"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _string_field(v: Column, *names: str) -> Column:
    """The first of the fields of an object that is a string and not blank, trimmed."""
    found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(F.schema_of_variant(x) == "STRING", F.nullif(trim_all(F.try_variant_get(x, "$", "string")), F.lit(""))) for x in found])


def nested_string(v: Column, name: str, depth: int = 6) -> Column:
    """The first string that is not blank under a key which is ``name`` but for case, blanks, - and _, in objects and
    lists up to ``depth`` deep; a level's own keys (in alphabetical order) before what is below them."""
    entries = F.filter(F.map_entries(_fields(v)), lambda e: (F.lower(F.regexp_replace(e["key"], r"[\s_-]", "")) == name) & (F.schema_of_variant(e["value"]) == "STRING"))
    own = F.filter(F.transform(entries, lambda e: trim_all(F.try_variant_get(e["value"], "$", "string"))), lambda x: x != "")
    if depth == 1:
        return F.get(own, F.lit(0))
    below = F.coalesce(F.map_values(_fields(v)), F.try_variant_get(v, "$", "array<variant>"))
    found = F.array_compact(F.transform(below, lambda x: nested_string(x, name, depth - 1)))
    return F.coalesce(F.get(own, F.lit(0)), F.get(found, F.lit(0)))


# Headers that name a request.
REQUEST_HEADERS = ["x-request-id", "request-id", "anthropic-request-id"]


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0))


def failure(status: Column, body: Column, headers: Column | None = None) -> Column:
    """struct(error_type, message, request_id, overloaded, retryable) of a failed call.

    Fields of the object ``error`` come before those beside it; a body without a message is its own, collapsed, 240
    characters of it.  The request id is sought throughout the body, then in the headers (a map).
    """

    def told(v: Column) -> Column:
        nested = F.try_variant_get(v, "$.error", "variant")
        nested = F.when(F.schema_of_variant(nested).startswith("OBJECT"), nested)
        plain = F.substring(collapse(F.coalesce(body, F.lit(""))), 1, 240)
        message = F.coalesce(_string_field(nested, "message", "detail", "error"), _string_field(v, "message", "detail", "error_description"), plain)
        request = [nested_string(v, "requestid")] + ([header(headers, h) for h in REQUEST_HEADERS] if headers is not None else [])
        return F.struct(F.coalesce(_string_field(nested, "type", "code"), _string_field(v, "type", "code")).alias("kind"), message.alias("message"), F.coalesce(*request).alias("request"))

    def judged(x: Column) -> Column:
        over = rules.is_overloaded(status, F.concat_ws(" ", x["kind"], x["message"]))
        return F.struct(x["kind"].alias("error_type"), x["message"].alias("message"), x["request"].alias("request_id"), over.alias("overloaded"), (rules.is_retryable(status) | over).alias("retryable"))

    return _once(_once(F.try_parse_json(body), told), judged)


def parse_highlights(responses: DataFrame) -> DataFrame:
    """(id, body, ...) to a row for each highlight: string type, string text of 10 characters or more."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$.highlights", "array<variant>")
    rows = responses.select(*[c for c in responses.columns if c != "body"], F.posexplode(listed).alias("pos", "h"))

    def text(name: str) -> Column:
        value = F.try_variant_get("h", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    rows = rows.select("*", text("exact_text").alias("exact_text"), text("type").alias("type")).drop("h")
    return rows.where(F.col("type").isNotNull() & (F.char_length(trim_all(F.col("exact_text"))) >= 10))


def recommendations(responses: DataFrame) -> DataFrame:
    """(id, body, ...) to (…, pos, paper_id, reason) for each entry of the list ``recommendations`` that names a paper;
    both trimmed, a reason that is missing or no string is empty."""
    listed = F.try_variant_get(F.try_parse_json(unfence(F.col("body"))), "$.recommendations", "array<variant>")
    rows = responses.select(*[c for c in responses.columns if c != "body"], F.posexplode(listed).alias("pos", "r"))
    rows = rows.select("*", _string_field(F.col("r"), "paperId").alias("paper_id"), F.coalesce(_string_field(F.col("r"), "reason"), F.lit("")).alias("reason"))
    return rows.drop("r").where("paper_id is not null")


def stream_token(line: Column, provider: Column) -> Column:
    """The text that a streamed line adds; null for other lines and the end mark."""
    data = F.when(line.startswith("data: "), trim_all(F.substring(line, 7, 1 << 30)))
    payload = F.when(data != "[DONE]", data)
    return F.when(provider == "anthropic", F.get_json_object(payload, "$.delta.text")).otherwise(F.get_json_object(payload, "$.choices[0].delta.content"))


def provider_of(url: Column) -> Column:
    low = F.lower(F.regexp_replace(trim_all(url), r"/+\z", ""))
    host = F.regexp_extract(low, r"\A[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(F.contains(low, F.lit("anthropic")) | F.contains(host, F.lit("claude")) | F.contains(low, F.lit("/v1/messages")) | low.endswith("/messages"), "anthropic").otherwise("openai")


def chosen_provider(url: Column, setting: Column) -> Column:
    """The provider that a setting names, else the one that the address tells (setting auto, or none)."""
    return F.when(setting.isin("anthropic", "openai"), setting).otherwise(provider_of(url))


def request_url(provider: Column, url: Column) -> Column:
    """The address of a provider's calls from a base address, which may have it already."""
    base = F.regexp_replace(url, r"/+\z", "")
    messages = F.when(base.rlike(r"(?i)/messages\z"), base).when(base.rlike(r"(?i)/v1\z"), F.concat(base, F.lit("/messages"))).otherwise(F.concat(base, F.lit("/v1/messages")))
    return F.when(provider == "anthropic", messages).when(base.rlike(r"(?i)/chat/completions\z"), base).otherwise(F.concat(base, F.lit("/chat/completions")))


# The version that one provider's calls name.
ANTHROPIC_VERSION = "2023-06-01"


def request_headers(provider: Column, key: Column) -> Column:
    """A map of the headers of a provider's calls."""
    kind = F.lit("Content-Type"), F.lit("application/json")
    anthropic = F.create_map(*kind, F.lit("x-api-key"), key, F.lit("anthropic-version"), F.lit(ANTHROPIC_VERSION))
    return F.when(provider == "anthropic", anthropic).otherwise(F.create_map(*kind, F.lit("Authorization"), F.concat(F.lit("Bearer "), key)))


def request_body(provider: Column, model: Column, system: Column, user: Column, max_tokens: Column, temperature: Column, as_json: bool = True, thinking: bool = False) -> Column:
    """The JSON body of a call in the provider's shape; ``as_json`` asks for a JSON answer, and ``thinking`` for a
    process of 512 tokens, where the shape has a field for it."""
    asked = [model.alias("model"), max_tokens.alias("max_tokens"), temperature.alias("temperature")]
    block = F.struct(F.lit("text").alias("type"), user.alias("text"))
    anthropic = F.to_json(F.struct(*asked, system.alias("system"), F.array(F.struct(F.lit("user").alias("role"), F.array(block).alias("content"))).alias("messages")))
    extra = [F.lit(thinking).alias("enable_thinking")] + ([F.lit(512).alias("thinking_budget_tokens")] if thinking else [])
    extra += [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if as_json else []
    messages = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user))])
    openai = F.to_json(F.struct(*asked, *extra, messages.alias("messages")))
    return F.when(provider == "anthropic", anthropic).otherwise(openai)


def formula_block(formula: Column) -> Column:
    """A formula as a display block; empty for none."""
    t = trim_all(formula)
    inner = trim_all(F.regexp_replace(F.regexp_replace(t, r"\A\$\$?", ""), r"\$\$?\z", ""))
    return F.when(t.rlike(r"(?s)\A\$\$.*\$\$\z"), t).when(inner != "", F.concat(F.lit("$$\n"), inner, F.lit("\n$$"))).otherwise("")
