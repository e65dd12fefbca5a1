"""Chat formatting with tool calls: link calls to results, order them, validate arguments, write canonical JSON.

Messages are rows (conv_id, turn, role, text). The text of an assistant message may be a JSON object with ``tool_calls``, a
list of ``{"id", "name", "arguments", "after"?}``; the text of a ``tool`` message is ``{"tool_call_id", "content"}``. ``link`` returns
a row per call: its result by a hash join on (conversation, identifier), its place in topological order (``after`` names
the call of the same conversation that it needs), and the faults of its arguments against the schemas. ``format_messages`` returns a
row per message with its position and its canonical JSON (keys sorted, no blanks), calls in topological order.

Depth is found by pointer jumping: each round doubles how far every call looks back, so a chain of length n takes log2 n
joins, and calls that never reach a call without ``after`` are in a cycle. Only expressions, joins and groupings are
used; nothing is gathered per conversation, so a conversation may be of any size.

Defined cases: a message that is no such object, or has null or empty text, is plain text; a null conversation is one of its
own; of several results of an identifier the first (turn, then text) is linked and all are counted; of repeated identifiers of a
conversation the first call stands, later ones are marked ``repeated``; a result without a call is ``orphan`` text; a call
without a result has a null one; ``after`` without such a call counts as none and is a fault; repeated rows repeat messages;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standpoint.session import cut_lineage

#: Tool -> argument -> (type, required). Types are those of JSON: string, integer, number, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
CALL = "struct<id:string,name:string,arguments:variant,after:string>"
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def _body(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv, turn, at, id, name, arguments, after), one row per call; ``id`` null where it is missing."""
    v = messages.where("role = 'assistant'").select("conv", "turn", _body(F.col("text")).alias("v")).where("v IS NOT NULL")
    items = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    c = v.select("conv", "turn", F.posexplode(items).alias("at", "c"))
    return c.select("conv", "turn", "at", *[F.try_variant_get("c", f"$.{n}", "string").alias(n) for n in ("id", "name")],
                    F.try_variant_get("c", "$.arguments", "variant").alias("arguments"), F.try_variant_get("c", "$.after", "string").alias("after"))


def results_of(messages: DataFrame) -> DataFrame:
    """(conv, turn, id, content) of well-formed tool messages."""
    v = messages.where("role = 'tool'").select("conv", "turn", _body(F.col("text")).alias("v"))
    return v.select("conv", "turn", F.try_variant_get("v", "$.tool_call_id", "string").alias("id"),
                    F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content")).where("id IS NOT NULL")


def faults(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with the arguments of a call, in order of the schema's arguments, unknown ones last."""

    def wrong_type(field: Column, kind: str) -> Column:
        got = F.schema_of_variant(field)
        if kind == "number":
            return ~(got.isin("BIGINT", "DOUBLE", "FLOAT") | got.startswith("DECIMAL"))
        if kind in ("array", "object"):
            return ~got.startswith(kind.upper() + "<")
        return got != KINDS[kind]

    def of(fields: Mapping[str, tuple[str, bool]]) -> Column:
        found = []
        for f, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$['{f}']", "variant")
            found.append(F.when(value.isNull(), F.lit(f"missing {f}") if required else F.lit(None)).when(wrong_type(value, kind), F.lit(f"type of {f}")))
        keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        unknown = F.transform(F.sort_array(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown "), k))
        return F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), unknown)

    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False))
    out = F.array(F.lit("no such tool"))
    for tool, fields in sorted(schemas.items()):
        out = F.when(name.eqNullSafe(F.lit(tool)), F.when(is_object, of(fields)).otherwise(F.array(F.lit("arguments are no object")))).otherwise(out)
    return out


def depths(calls: DataFrame) -> DataFrame:
    """(conv, id, depth, cyclic) of calls (conv, id, after), ids distinct in a conversation."""
    own = calls.select("conv", "id").withColumn("there", F.lit(True))
    known = calls.join(own.select("conv", F.col("id").alias("after"), "there"), ["conv", "after"], "left")
    state = cut_lineage(known.select("conv", "id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")))
    n, reach = state.count(), 1
    while reach <= n and state.where("up IS NOT NULL").limit(1).count():
        above = state.select("conv", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = cut_lineage(state.join(above, ["conv", "up"], "left").select("conv", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        reach *= 2
    return state.select("conv", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def prepared(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
                           F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def link(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, at, id, name, arguments, after, depth, cyclic, repeated, n_results, result_turn, result, faults)."""
    m = cut_lineage(prepared(messages))
    first = Window.partitionBy("conv", "id").orderBy("turn", "at", F.to_json("arguments"))
    calls = cut_lineage(calls_of(m).withColumn("repeated", (F.row_number().over(first) > 1) & F.col("id").isNotNull()).withColumn("bad", faults(F.col("name"), F.col("arguments"), schemas))
                        .withColumn("arguments", F.to_json("arguments")))
    depth = depths(calls.where("NOT repeated AND id IS NOT NULL").select("conv", "id", "after"))
    results = results_of(m).groupBy("conv", "id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("r"))
    ids = depth.select("conv", F.col("id").alias("after"), F.lit(True).alias("after_known"))
    out = (calls.join(depth, ["conv", "id"], "left").join(results, ["conv", "id"], "left").join(ids, ["conv", "after"], "left"))
    lost = F.when(F.col("after").isNotNull() & F.col("after_known").isNull(), F.array(F.lit("after is unknown"))).otherwise(F.array().cast("array<string>"))
    cycle = F.when(F.col("cyclic"), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "turn", "at", "id", "name", "arguments", "after", "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        "repeated", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.when(~F.col("repeated"), F.col("r.turn")).alias("result_turn"),
        F.when(~F.col("repeated"), F.col("r.content")).alias("result"), F.concat("bad", lost, cycle).alias("faults"))


def canonical(json: Column) -> Column:
    """Keys sorted at every level, no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def format_messages(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, depth, at, role, json): one row per message and per call; a message that
    only makes calls, without content of its own, is its calls. Ordering by (conv_id, turn, depth, at) reads a
    conversation with the calls of a turn in topological order, those in a cycle last. A call's JSON holds its result and faults."""
    linked = link(messages, schemas)
    m = prepared(messages)
    # None without a list of calls; otherwise the message stays where it has content, or no call to stand for it
    asked = F.when(F.col("role") == "assistant", F.try_variant_get(_body(F.col("text")), "$.tool_calls", "array<variant>"))
    content = F.try_variant_get(_body(F.col("text")), "$.content", "variant")
    said = F.when(~F.is_variant_null(content), F.coalesce(F.try_variant_get(content, "$", "string"), F.to_json(content)))
    is_result = F.coalesce((F.col("role") == "tool") & F.try_variant_get(_body(F.col("text")), "$.tool_call_id", "string").isNotNull(), F.lit(False))
    stays = asked.isNull() | (F.size(asked) == 0) | (F.coalesce(said, F.lit("")) != "")
    plain = m.where(stays & ~is_result).select(
        "conv_id", "turn", F.lit(-1).cast("long").alias("depth"), F.lit(0).alias("at"), "role",
        F.to_json(F.struct(F.coalesce(F.when(asked.isNull(), F.col("text")).otherwise(said), F.lit("")).alias("content"), F.coalesce("role", F.lit("")).alias("role"))).alias("json"))
    argument = F.coalesce(F.col("arguments"), F.lit("null"))
    known = F.to_json(F.struct(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name")))
    text = F.concat(F.lit('{"arguments":'), argument, F.lit(',"faults":'), F.to_json("faults"), F.lit(","), F.substring(known, 2, 1 << 30).substr(F.lit(1), F.length(known) - 2),
                    F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    calls = linked.select("conv_id", "turn", F.coalesce("depth", F.lit(2**62)).alias("depth"), "at", F.lit("call").alias("role"), canonical(text).alias("json"))
    ids = linked.where("id IS NOT NULL").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "id").distinct()
    orphans = results_of(m).join(ids, ["conv", "id"], "left_anti").select(
        F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "turn", F.lit(-1).cast("long").alias("depth"), F.lit(0).alias("at"), F.lit("orphan").alias("role"),
        F.to_json(F.struct(F.coalesce("content", F.lit("null")).alias("content"), "id")).alias("json"))
    return plain.unionByName(calls).unionByName(orphans)


#: The tools of the registered query.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"key": ("string", True), "exact": ("boolean", True)},
    "measure": {"value": ("number", True), "unit": ("string", False)},
}


def with_tool_calls(conversations: DataFrame) -> DataFrame:
    """The conversations with a tool exchange derived from every assistant turn: the table holds none. The turn gets three
    calls about its own first letters, the second and third after one before it, some with wrong arguments, unknown tools, lost
    references, repeated identifiers or missing results, as its number decides; results come in the next turn."""
    m = conversations.select("conv_id", (F.col("turn") * 3).alias("turn"), "role", "text")
    a = m.where("role = 'assistant'")
    k = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7))
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"[\p{L}]+", 0)
    length = F.length(F.coalesce("text", F.lit(""))).cast("string")
    calls = F.concat(
        F.lit('{"tool_calls":[{"id":"'), name, F.lit('a","name":"search","arguments":{"query":"'), word, F.lit('","limit":'), F.when(k == 0, F.lit('"five"')).otherwise(F.lit("5")),
        F.lit('}},{"id":"'), name, F.when(k == 1, F.lit("a")).otherwise(F.lit("b")), F.lit('","name":"'), F.when(k == 2, F.lit("guess")).otherwise(F.lit("measure")),
        F.lit('","after":"'), name, F.when(k == 3, F.lit("z")).otherwise(F.lit("a")), F.lit('","arguments":{"value":'), length, F.lit(',"unit":"chars"}},{"name":"lookup","id":"'), name,
        F.lit('c","after":"'), name, F.when(k == 4, F.lit("c")).otherwise(F.lit("b")), F.lit('","arguments":{'), F.when(k == 5, F.lit("")).otherwise(F.lit('"exact":true,')), F.lit('"key":"'), word, F.lit('"}}]}'))
    asked = a.select("conv_id", (F.col("turn") + 1).alias("turn"), "role", calls.alias("text"))
    given = a.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit("tool").alias("role"), F.explode(F.when(k == 6, F.array(F.lit("a"), F.lit("q"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).alias("x"), name.alias("n"), word.alias("w"))
    given = given.select("conv_id", "turn", "role", F.concat(F.lit('{"tool_call_id":"'), "n", "x", F.lit('","content":{"found":"'), "w", F.lit('"}}')).alias("text"))
    return m.unionByName(asked).unionByName(given)
