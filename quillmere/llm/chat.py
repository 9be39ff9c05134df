"""Tool-call linking in chats. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import discard, settle

#: {tool: {argument: (JSON type, required)}}; types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (a JSON text), as an array of texts in a fixed order.

    The registry of tools is part of the program, so it becomes an expression and no join.
    """
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    known = F.array().cast("array<string>")
    by_tool = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, fields in sorted(schemas.items(), reverse=True):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            own = F.try_variant_get(value, f"$['{field}']", "variant")
            missing = ~F.array_contains(keys, field)
            wrong = ~missing & ~F.coalesce(F.schema_of_variant(own), F.lit("VOID")).rlike(_TYPES[kind])
            checks.append(F.when(missing & F.lit(required), F.lit(f"missing {field}")).when(wrong, F.lit(f"{field} is no {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(fields))) if fields else known)), lambda k: F.concat(F.lit("unexpected "), k))
        by_tool = F.when(name == tool, F.concat(F.filter(F.array(*checks) if checks else known, lambda e: e.isNotNull()), extra)).otherwise(by_tool)
    return F.when(value.isNull() | ~F.schema_of_variant(value).rlike("^OBJECT"), F.array(F.lit("arguments are no object"))).otherwise(by_tool)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link calls with their results, order them, check their arguments, and write them out.

    calls: conv_id, turn, call_index, call_id, name, arguments (JSON text), depends (array of
    call_ids). results: conv_id, turn, call_id, content.

    * Linking is a hash join on (conv_id, call_id). Several results of a call count as the one
      with the smallest turn, then the smallest content; they are reduced before the shuffle.
    * Order: (turn, level, call_index) sorts a conversation so that every call comes after those
      it depends on. A call may depend on calls of earlier turns, and on calls of its own turn;
      level is the longest chain of the latter. Levels are peeled off round by round, as many
      rounds as the longest chain within one turn; without such a chain there is no round. A
      dependency on a later turn, on itself, on no call, or in a circle is an error. No
      conversation is ever collected or sorted in one place.
    * Canonical JSON: keys sorted at every depth, no spaces, numbers as parsed, no null members.

    Returns conv_id, turn, level, call_index, call_id, name, linked, status (the first of
    invalid, unanswered, ok that holds), errors (array), message (canonical JSON; arguments that are no JSON stand as
    text). Null depends count as none; a null call_id or conv_id never links. Calls that share
    an id are each linked with its result, and depend on the last of them. Empty tables give no
    rows; results of no call are returned by orphans(). Other columns are not read.
    """
    calls = calls.select("conv_id", "turn", "call_index", "call_id", "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))
    first = results.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_result"))
    needs = calls.select("conv_id", F.col("turn").alias("_turn"), "call_id", F.explode("depends").alias("_dep")).where("call_id is not null").distinct()
    place = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.max("turn").alias("_dep_turn")).withColumnRenamed("call_id", "_dep")
    checked = needs.join(place, ["conv_id", "_dep"], "left")
    reason = F.when(F.col("_dep_turn").isNull(), "no call ").when((F.col("_dep") == F.col("call_id")) | (F.col("_dep_turn") > F.col("_turn")), "not earlier ")
    bad = checked.where(reason.isNotNull()).groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat(reason, "_dep"))).alias("_order_errors"))
    edges = checked.where(reason.isNull() & (F.col("_dep_turn") == F.col("_turn"))).select("conv_id", "call_id", "_dep")
    levels = _levels(edges)
    out = calls.join(first, ["conv_id", "call_id"], "left").join(bad, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
    errors = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("_order_errors", F.array().cast("array<string>")), F.when(F.col("_level") < 0, F.array(F.lit("circular"))).otherwise(F.array().cast("array<string>")))
    linked = F.col("_result").isNotNull()
    parsed = F.try_parse_json(F.col("arguments"))
    body = lambda value: F.to_json(F.struct(value.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("_result.content").alias("result"), "turn"))
    return out.withColumn("errors", errors).select(
        "conv_id",
        "turn",
        F.greatest(F.coalesce("_level", F.lit(0)), F.lit(0)).alias("level"),
        "call_index",
        "call_id",
        "name",
        linked.alias("linked"),
        F.when(F.size("errors") > 0, "invalid").when(~linked, "unanswered").otherwise("ok").alias("status"),
        "errors",
        F.when(parsed.isNotNull(), body(parsed)).otherwise(body(F.col("arguments"))).alias("message"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def orphan_rows(calls: DataFrame, results: DataFrame) -> DataFrame:
    """orphans() in the columns of link(), with the status `orphan`."""
    none = lambda kind: F.lit(None).cast(kind)
    message = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), "turn"))
    return orphans(calls, results).select("conv_id", "turn", none("int").alias("level"), none("int").alias("call_index"), "call_id", none("string").alias("name"), F.lit(False).alias("linked"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"), message.alias("message"))


def _levels(edges: DataFrame) -> DataFrame:
    """Longest chain of dependencies below each call (conv_id, call_id, _level); -1 in a circle.

    Calls whose dependencies are all placed are taken out level by level: as many rounds as the
    longest chain within one turn, which one message bounds. A round's edges are deleted when
    the next ones are written.
    """
    done = edges.select("conv_id", "call_id", F.lit(0).alias("_level")).where(F.lit(False))
    left, depth = settle(edges, "edges"), 0
    count = left.count()
    while count:
        depth += 1
        blocked = left.select("conv_id", F.col("call_id").alias("_dep")).distinct()
        kept = settle(left.join(blocked, ["conv_id", "_dep"], "left_semi"), "edges")
        now = kept.count()
        circle = now == count
        placed = left if circle else left.join(blocked, ["conv_id", "_dep"], "left_anti")
        done = done.unionByName(settle(placed.select("conv_id", "call_id", F.lit(-1 if circle else depth).alias("_level")).distinct(), "levels"))
        discard(left)
        left, count = kept, 0 if circle else now
    discard(left)
    worst = F.when(F.min("_level") < 0, F.lit(-1)).otherwise(F.max("_level"))
    return done.groupBy("conv_id", "call_id").agg(worst.alias("_level"))


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written as JSON in messages (conv_id, turn, role, text).

    An assistant's text {"tool_calls": [{"id", "name", "arguments": {...}, "depends_on": [...]}]}
    holds calls; a tool's text {"tool_call_id", "content"} is a result. Other texts hold neither.
    """
    shape = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
    made = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.from_json("text", shape)["tool_calls"]).alias("call_index", "_call"))
    calls = made.select("conv_id", "turn", "call_index", F.col("_call.id").alias("call_id"), F.col("_call.name").alias("name"), F.col("_call.arguments").alias("arguments"), F.col("_call.depends_on").alias("depends"))
    answer = F.from_json("text", "struct<tool_call_id: string, content: string>")
    results = messages.where("role = 'tool'").select("conv_id", "turn", answer["tool_call_id"].alias("call_id"), answer["content"].alias("content")).where("call_id is not null")
    return calls, results


#: Tools that plain chats are written with.
CHAT_TOOLS: Schemas = {"read": {"text": ("string", True), "turn": ("integer", True)}, "count": {"words": ("integer", True), "limit": ("integer", True)}, "reply": {"prompt": ("string", True), "turn": ("integer", True)}, "configure": {"prompt": ("string", True)}}


def from_chat(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats (conv_id, turn, role, text).

    A system's turn is a call of `configure`. A user's turn is three calls: `read` (its text),
    which depends on the `reply` two turns earlier, or on `configure` in turn 1; `count` (its
    words, and half of them as a limit), which depends on `read`; and `reply`, which depends on
    both. An id is "conversation:turn:tool". An assistant's turn is the result of the `reply` or
    `configure` of the turn before it, and its first line that of its `read`.
    """
    key = lambda turn, tool: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"), F.lit(f":{tool}"))
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    half = F.concat(F.floor(words / 2).cast("string"), F.when(words % 2 == 0, "").otherwise(".5"))
    none = F.array().cast("array<string>")
    call = lambda at, tool, arguments, depends: F.struct(F.lit(at).alias("call_index"), key(turn, tool).alias("call_id"), F.lit(tool).alias("name"), arguments.alias("arguments"), depends.alias("depends"))
    earlier = F.when(turn >= 2, F.array(key(turn - 2, "reply"))).when(turn == 1, F.array(key(turn - 1, "configure"))).otherwise(none)
    user = F.array(
        call(0, "read", F.to_json(F.struct(text.alias("text"), turn)), earlier),
        call(1, "count", F.concat(F.lit('{"limit":'), half, F.lit(',"words":'), words.cast("string"), F.lit("}")), F.array(key(turn, "read"))),
        call(2, "reply", F.to_json(F.struct(text.alias("prompt"), turn)), F.array(key(turn, "read"), key(turn, "count"))),
    )
    system = F.array(call(0, "configure", F.to_json(F.struct(text.alias("prompt"))), none))
    made = messages.where(F.col("role").isin("user", "system")).select("conv_id", "turn", F.explode(F.when(F.col("role") == "user", user).otherwise(system)).alias("_c"))
    # which tool an answer belongs to is known by the calls there are, so it is offered to each
    answer = lambda tool, content: F.struct(key(turn - 1, tool).alias("call_id"), content.alias("content"))
    offered = F.array(answer("configure", F.col("text")), answer("read", F.split("text", "\n")[0]), answer("reply", F.col("text")))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(offered).alias("_r")).select("conv_id", "turn", "_r.call_id", "_r.content")
    results = results.where(~F.endswith("call_id", F.lit(":read")) | F.col("content").isNotNull())
    # of the three, those of the other kind of turn are no orphans if the turn has calls at all
    asked = messages.where(F.col("role").isin("user", "system")).groupBy("conv_id", (turn + 1).alias("turn")).agg(F.max(F.col("role") == "user").alias("_user"), F.max(F.col("role") == "system").alias("_system"))
    fits = F.coalesce(F.when(F.endswith("call_id", F.lit(":configure")), F.col("_system")).otherwise(F.col("_user")), F.lit(True))
    results = results.join(asked, ["conv_id", "turn"], "left").where(fits).select("conv_id", "turn", "call_id", "content")
    return made.select("conv_id", "turn", "_c.*"), results


def all_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages hold as JSON, and those that from_chat() makes of all other messages."""
    is_call = (F.col("role") == "assistant") & F.get_json_object("text", "$.tool_calls").isNotNull()
    is_result = (F.col("role") == "tool") & F.get_json_object("text", "$.tool_call_id").isNotNull()
    plain = messages.where(~F.coalesce(is_call | is_result, F.lit(False)))
    (a, b), (c, d) = from_messages(messages), from_chat(plain)
    return a.unionByName(c.select(*a.columns)), b.unionByName(d)
