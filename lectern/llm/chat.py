"""Chat formatting with tool-call linking.  DataFrame functions only.

An assistant message whose text is a JSON object with ``tool_calls`` (a list of objects with id, name,
arguments and, optionally, after: ids whose results the call needs) makes calls; a message of role ``tool``
whose text is a JSON object with ``tool_call_id`` is a result.  Calls and results are joined by
conversation and identifier, put in topological order, arguments are checked against schemas, and every
message, call and result becomes one line of canonical JSON (sorted keys, no blanks).  What else a message with
calls or a result holds, such as content beside calls, becomes a message line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import drop, prepare, small, table

#: Types that a schema may name, as prefixes of what Spark calls a JSON value's type.
JSON_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def _canonical(value: Column) -> Column:
    return F.to_json(value)


def _others(value: Column, *names: str) -> Column:
    """JSON of an object's fields but for ``names``; null if there are no others."""
    kept = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: ~k.isin(*names))
    return F.when(F.size(kept) > 0, F.to_json(kept, {"ignoreNullFields": "false"}))


def as_tool_log(messages: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) read as a log of calls and results, for tables without any.

    A user's message is a call of the tool ``reply``, made by the assistant, with arguments prompt (the text) and
    chars; its id is q and the turn.  It needs the result of the call half as many turns into the conversation
    (of the same parity).  An assistant's message is the result of the call of the turn before.  All other
    messages stay.  So that every case occurs, one message in 16 by the first digit of its text's md5 looks ahead (0: the call
    also needs the one two turns later), has the id of the call two turns before (1), lacks chars (2) or needs an
    id that no call has (3).  A null turn gives null ids; a null text a call without prompt.
    """
    turn, lot = F.col("turn").cast("long"), F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")

    def name(at: Column) -> Column:
        return F.concat(F.lit("q"), at.cast("string"))

    half = 2 * F.floor(turn / 4) + turn % 2
    needs = F.array_compact(F.array(F.when(half < turn, name(half)), F.when(lot == 0, name(turn + 2)), F.when(lot == 3, F.lit("none"))))
    own = F.when((lot == 1) & (turn >= 2), name(turn - 2)).otherwise(name(turn))
    arguments = F.struct(F.when(lot != 2, F.char_length("text")).alias("chars"), F.col("text").alias("prompt"))
    call = F.to_json(F.struct(F.array(F.struct(needs.alias("after"), arguments.alias("arguments"), own.alias("id"), F.lit("reply").alias("name"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.col("text").alias("content"), name(turn - 1).alias("tool_call_id")))
    by_user, by_assistant = F.col("role") == "user", F.col("role") == "assistant"
    role = F.when(by_user, "assistant").when(by_assistant, "tool").otherwise(F.col("role"))
    return messages.select("conv_id", "turn", role.alias("role"), F.when(by_user, call).when(by_assistant, result).otherwise(F.col("text")).alias("text"))


#: Calls of a conversation that are ordered by one fold over their array, at most.
FOLD_CALLS = 1000
KEY = ("k_conv", "k_id")


def _ordered(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(k_conv, k_id, ready, free, depth) of calls (k_conv, k_id, turn, answer) that can be made, given needs (k_conv, k_id,
    need), by conversation: its calls are an array, and in each round those whose needs are met join the ones that are
    done; the fold does nothing once a round brings none."""
    lists = needs.groupBy(*KEY).agg(F.collect_list("need").alias("needs"))
    each = F.struct("turn", "k_id", "answer", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    rows = calls.join(lists, list(KEY), "left").groupBy("k_conv").agg(F.array_sort(F.collect_list(each)).alias("calls"))
    ids = F.transform("calls", lambda c: c["k_id"])
    rows = rows.select("k_conv", "calls", F.transform("calls", lambda c: F.transform(c["needs"], lambda x: (F.array_position(ids, x) - 1).cast("int"))).alias("needed"))
    call = lambda i: F.get("calls", i)

    def state(ready: Column, freed: Column, depth: Column) -> Column:
        return F.struct(ready.cast("long").alias("ready"), freed.cast("long").alias("free"), depth.cast("int").alias("depth"))

    first = F.transform("needed", lambda n, i: F.when(F.size(n) == 0, state(call(i)["turn"], F.greatest(call(i)["turn"], call(i)["answer"]), F.lit(0))))

    def step(acc: Column, _: Column) -> Column:
        def moved(s: Column, i: Column) -> Column:
            met = F.transform(F.get("needed", i), lambda j: F.get(acc["done"], j))
            after, depth = F.array_max(F.transform(met, lambda m: m["free"])), F.array_max(F.transform(met, lambda m: m["depth"])) + 1
            new = state(F.greatest(call(i)["turn"], after), F.greatest(call(i)["turn"], after, call(i)["answer"]), depth)
            return F.when(s.isNotNull() | F.exists(met, lambda m: m.isNull()), s).otherwise(new)

        after = F.array(F.transform(acc["done"], moved))
        count = lambda d: F.size(F.filter(d, lambda s: s.isNotNull()))
        return F.when(acc["more"], F.transform(after, lambda d: F.struct(d.alias("done"), (count(d) > count(acc["done"])).alias("more")))[0]).otherwise(acc)

    walked = F.aggregate(F.sequence(F.lit(1), F.size("calls")), F.struct(first.alias("done"), F.lit(True).alias("more")), step)["done"]
    out = rows.select("k_conv", F.explode(F.zip_with("calls", walked, lambda c, s: F.struct(c["k_id"].alias("k_id"), s.alias("s")))).alias("x"))
    return out.where("x.s is not null").select("k_conv", "x.k_id", "x.s.ready", "x.s.free", "x.s.depth")


def _by_levels(done: DataFrame, base_turn: DataFrame, needs: DataFrame) -> DataFrame:
    """``done`` with the calls of ``needs`` that can be made: a round of joins for each level, which is written once."""
    key, levels = list(KEY), 1
    waiting = table(needs.select(*key).distinct(), "waiting")
    while not waiting.isEmpty():
        met = needs.join(waiting, key, "left_semi").join(done.select("k_conv", F.col("k_id").alias("need"), "free", F.col("depth").alias("d")), ["k_conv", "need"], "left")
        met = met.groupBy(*key).agg(F.max(F.col("d").isNull()).alias("open"), F.max("free").alias("after_turn"), F.max("d").alias("d")).where("not open")
        new = met.join(base_turn, key).select(*key, F.greatest("turn", "after_turn").alias("ready"), F.greatest("turn", "after_turn", "answer").alias("free"), (F.col("d") + 1).alias("depth"))
        new, levels = table(new, f"done-{levels}"), levels + 1
        if new.isEmpty():
            break
        left = table(waiting.join(new, key, "left_anti"), "waiting")
        drop(waiting)
        done, waiting = done.unionByName(new), left
    return done


def format_chats(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """For each message of ``messages`` (conv_id, turn, role, text), or each call in it: conv_id, turn, idx,
    role, kind (message, call, result), call_id, linked_turn, ready_turn, depth, status, line.

    ``schemas`` (name, param, type, required) restricts arguments; names it lacks are not checked.
    linked_turn is the turn of a call's first result, or of a result's call.  In a conversation,
    (ready_turn, depth, turn, idx) is a topological order: a call comes after the results it needs, a
    result after its call.  depth counts the calls that must come before.

    status: ok; unanswered (a call without result); orphan (a result without call); repeated (an id used
    by an earlier call of the conversation: the first is linked); missing (a call that needs an unknown
    id); cycle (calls that wait for each other, or for such calls: each stays at its turn); invalid
    (arguments break the schema).  Text that is no such JSON, null and empty text are messages; null
    conv_id, turn and role are values like others.  Repeated rows give repeated lines.  Texts of any length are taken
    whole.  An empty table gives no lines.

    A line is canonical JSON: sorted keys, no blanks; a field whose column is null (conv_id, role, turn, text, a call's
    id, name, arguments or after) is left out, a null inside a message's own JSON stays.  Numbers keep their
    value, not their spelling: 1.0 is written as 1.

    A calling or answering message with more fields than these also gives a line of kind message, idx -1: its content
    (of a calling one) and all other fields under ``fields``; a call's own other fields are under ``fields`` of its line.
    """
    spark = messages.sparkSession
    prepare(spark)
    base = messages.select("conv_id", "turn", "role", "text")
    looks = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    parsed = base.withColumn("v", F.when(looks & F.col("role").isin("assistant", "tool"), F.try_parse_json("text")))
    calls_in = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    result_of = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    parsed = parsed.withColumn("calls", calls_in).withColumn("result_of", result_of)
    plain = parsed.where("coalesce(size(calls), 0) <= 0 and result_of is null")
    line = _canonical(F.struct(F.col("text").alias("content"), "conv_id", "role", "turn"))
    none = F.lit(None)
    out = plain.select("conv_id", "turn", F.lit(0).alias("idx"), "role", F.lit("message").alias("kind"), none.cast("string").alias("call_id"), none.cast("long").alias("linked_turn"), F.col("turn").cast("long").alias("ready_turn"), F.lit(0).alias("depth"), F.lit("ok").alias("status"), line.alias("line"))

    acts = table(parsed.where("size(calls) > 0 or result_of is not null").select("conv_id", "turn", "role", "text", F.to_json("v").alias("body"), "result_of", F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls")), "tool-messages")
    if acts.isEmpty():
        return out
    acts = acts.withColumn("v", F.parse_json("body"))
    content = F.when(F.col("n_calls") > 0, F.to_json(F.try_variant_get("v", "$.content", "variant")))
    fields = F.when(F.col("n_calls") > 0, _others(F.col("v"), "tool_calls", "content")).otherwise(_others(F.col("v"), "tool_call_id", "content"))
    beside = acts.withColumn("content", content).withColumn("fields", fields).where("content is not null or fields is not null")
    line = _canonical(F.struct(F.parse_json("content").alias("content"), "conv_id", F.parse_json("fields").alias("fields"), "role", "turn"))
    out = out.unionByName(beside.select("conv_id", "turn", F.lit(-1).alias("idx"), "role", F.lit("message").alias("kind"), none.cast("string").alias("call_id"), none.cast("long").alias("linked_turn"), F.col("turn").cast("long").alias("ready_turn"), F.lit(0).alias("depth"), F.lit("ok").alias("status"), line.alias("line")))
    calls = acts.where("n_calls > 0").select("conv_id", "turn", "role", F.posexplode(F.variant_get("v", "$.tool_calls", "array<variant>")).alias("idx", "c"))
    calls = calls.select(
        "conv_id", "turn", "role", "idx",
        F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"),
        F.to_json(F.try_variant_get("c", "$.arguments", "variant")).alias("arguments"), F.coalesce(F.try_variant_get("c", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
        F.to_json(F.try_variant_get("c", "$.after", "variant")).alias("after_json"), _others(F.col("c"), "id", "name", "arguments", "after").alias("fields"),
    )
    calls = table(calls, "calls")
    results = acts.where("result_of is not null").select("conv_id", "turn", "role", F.col("result_of").alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    results = table(results, "results")

    key = list(KEY)

    def keyed(df: DataFrame) -> DataFrame:
        """With the identifier to join by; a null conversation is one like others."""
        return df.withColumn("k_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))).withColumn("k_id", F.col("call_id"))

    firsts = keyed(calls).where("k_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "idx")).alias("first"))
    answers = keyed(results).groupBy(*key).agg(F.min("turn").alias("answer"))
    # invalid arguments
    if schemas is not None:
        rules = small(table(schemas.select(F.col("name").alias("r_name"), "param", "type", "required"), "schemas"))
        value = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")
        told = F.schema_of_variant(F.get(F.map_values(F.map_filter(value, lambda k, _: k == F.col("param"))), F.lit(0)))
        wanted = F.coalesce(*[F.when(F.col("type") == t, F.lit(f"^({names})")) for t, names in JSON_TYPES.items()], F.lit(""))
        bad = calls.join(rules, F.col("name") == F.col("r_name")).where((F.col("required") & told.isNull()) | (told.isNotNull() & ~F.regexp_like(told, wanted)))
        bad = bad.select("conv_id", "turn", "idx").distinct().withColumn("invalid", F.lit(True))
        flags = table(bad.withColumnsRenamed({"conv_id": "b_conv", "turn": "b_turn", "idx": "b_idx"}), "invalid-calls")
        calls = calls.join(flags, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("turn").eqNullSafe(F.col("b_turn")) & (F.col("idx") == F.col("b_idx")), "left").drop("b_conv", "b_turn", "b_idx")
    else:
        calls = calls.withColumn("invalid", F.lit(None).cast("boolean"))
    calls = keyed(calls).join(firsts, key, "left").join(answers, key, "left")
    own = F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("first.idx") == F.col("idx")), F.lit(True))
    calls = table(calls.withColumn("own", own), "linked-calls")

    # topological order: a call is ready once all results that it needs are
    needs = calls.where("own").select("k_conv", "k_id", F.explode(F.array_distinct("after")).alias("need"))
    known = calls.where("own and k_id is not null").select("k_conv", F.col("k_id").alias("need"))
    lost = needs.join(known, ["k_conv", "need"], "left_anti").select(*key).distinct().withColumn("lost", F.lit(True))
    needs = table(needs.join(known, ["k_conv", "need"]).distinct(), "needs")
    base_turn = calls.where("own and k_id is not null").groupBy(*key).agg(F.max("turn").cast("long").alias("turn"), F.max("answer").cast("long").alias("answer"))
    base_turn = table(base_turn, "own-calls")
    # conversations of few calls are ordered each by a fold, all others by a round of joins for each level
    sizes = table(needs.select("k_conv").distinct().join(base_turn, "k_conv").groupBy("k_conv").agg(F.count("*").alias("n")), "sizes")
    few, many = sizes.where(F.col("n") <= FOLD_CALLS).select("k_conv"), sizes.where(F.col("n") > FOLD_CALLS).select("k_conv")
    free = base_turn.join(needs.select(*key).distinct(), key, "left_anti").select(*key, F.col("turn").alias("ready"), F.greatest("turn", "answer").alias("free"), F.lit(0).alias("depth"))
    folded = _ordered(base_turn.join(few, "k_conv", "left_semi"), needs.join(few, "k_conv", "left_semi"))
    done = table(free.join(few, "k_conv", "left_anti").unionByName(folded), "done")
    if not many.isEmpty():
        done = _by_levels(done, base_turn, needs.join(many, "k_conv", "left_semi"))
    calls = calls.join(done.select(*key, "ready", "depth"), key, "left").join(lost, key, "left")
    status = (
        F.when(~F.col("own"), "repeated").when(F.col("invalid"), "invalid").when(F.col("lost"), "missing")
        .when(F.col("ready").isNull() & F.col("k_id").isNotNull(), "cycle").when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    )
    ready = F.when(F.col("own"), F.coalesce("ready", "turn")).otherwise(F.col("turn")).cast("long")
    line = _canonical(F.struct(F.parse_json("after_json").alias("after"), F.parse_json("arguments").alias("arguments"), "conv_id", F.parse_json("fields").alias("fields"), F.col("call_id").alias("id"), F.lit("call").alias("kind"), "name", "role", "turn"))
    made = calls.select("conv_id", "turn", "idx", "role", F.lit("call").alias("kind"), "call_id", F.when(F.col("own"), F.col("answer")).cast("long").alias("linked_turn"), ready.alias("ready_turn"), F.when(F.col("own"), F.coalesce("depth", F.lit(0))).otherwise(0).alias("depth"), status.alias("status"), line.alias("line"))
    linked = keyed(results).join(firsts, key, "left").join(done.select(*key, "ready", "depth"), key, "left")
    line = _canonical(F.struct(F.parse_json("content").alias("content"), "conv_id", F.col("call_id").alias("id"), F.lit("result").alias("kind"), "role", "turn"))
    given = linked.select("conv_id", "turn", F.lit(0).alias("idx"), "role", F.lit("result").alias("kind"), "call_id", F.col("first.turn").cast("long").alias("linked_turn"), F.greatest(F.col("turn").cast("long"), F.coalesce("ready", "first.turn", "turn").cast("long")).alias("ready_turn"), (F.coalesce("depth", F.lit(0)) + F.when(F.col("first").isNotNull(), 1).otherwise(0)).alias("depth"), F.when(F.col("first").isNull(), "orphan").otherwise("ok").alias("status"), line.alias("line"))
    return out.unionByName(made).unionByName(given)
