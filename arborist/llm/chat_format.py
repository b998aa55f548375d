"""Chat formatting: link tool calls with results, order, validate, serialise.

Native: DataFrame and SQL functions only.

Input rows are messages (conv_id, turn, role, text). Three kinds carry JSON:

* a message with ``{"tools": [{"name", "parameters": {"properties", "required"}}]}``
  declares tools of its conversation;
* an assistant's ``{"tool_calls": [{"id", "name", "arguments", "depends_on"?}]}``
  makes calls; ``depends_on`` names calls that must come first;
* a tool's ``{"tool_call_id", "content"}`` is a result.

Every other message is plain, an assistant's without calls among them
(``tool_calls`` empty or null). Content beside calls is a plain message of its
own before them. Calls and results meet in a hash join on
(conv_id, id). Order is topological: a call's level is one more than the
deepest call it depends on, its place (``order_turn``) is the latest turn
among itself and those calls, and a result follows its call wherever it stood.
Calls are placed round by round: those that wait for no call first, then those
whose calls are all placed, until a round places none. What waits even then
lies on a cycle or depends on one and is marked. There are as many rounds as
levels, at any depth; each writes only the calls that still wait or that it
places.

One row per message, call and result goes out with its sort key
(order_turn, phase, level, seq); nothing is collected per conversation, so one
conversation may hold any share of the rows. ``line`` is canonical JSON: keys
sorted, no white space, as variants are printed.

Status: plain, tools; ok, or missing / unknown / type (argument missing, not
declared, of another type), undeclared (no such tool), cyclic, duplicate
(same id again: the first call in order of turn, place and canonical JSON
counts, equal rows once) for calls; of tools declared twice under a name the
first in that order counts;
ok, orphan (no such call) for results; invalid for JSON of a call or result
that lacks what it needs. Null text is serialised as null; null conv_id or
turn is kept and never links; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

KEYS = ("conv_id", "order_turn", "phase", "level", "seq")
#: JSON schema types and the variant types they admit.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$", "null": "^VOID$"}


def _json(messages: DataFrame) -> DataFrame:
    v = F.when(F.col("text").rlike(r"^\s*\{"), F.expr("try_parse_json(text)"))
    return messages.select("conv_id", "turn", "role", "text", v.alias("v")).withColumns(
        {
            "calls": F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"),
            "said": F.expr("try_variant_get(v, '$.content', 'variant')"),
            "tools": F.expr("try_variant_get(v, '$.tools', 'array<variant>')"),
            "result_of": F.expr("try_variant_get(v, '$.tool_call_id', 'string')"),
        }
    ).withColumn(
        "kind",
        F.when((F.col("role") == "assistant") & (F.size("calls") > 0), "call")
        .when((F.col("role") == "tool"), F.when(F.col("result_of").isNotNull(), "result").otherwise("invalid"))
        .when(F.col("tools").isNotNull(), "tools")
        .otherwise("plain"),
    )


def _levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, id, turn, deps) with level, order_turn, cyclic."""
    edges = calls.select("conv_id", "id", F.explode(F.array_distinct("deps")).alias("dep"))
    now = calls.select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("order_turn"))
    edges = edges.join(calls.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"])
    if not edges.head(1):
        return now.withColumn("cyclic", F.lit(False))
    edges = written(edges, "call-edges")
    spark, folder, depth = calls.sparkSession, f"{shared_dir(calls.sparkSession)}/call-levels-{uuid.uuid4().hex}", 0
    waits = edges.groupBy("conv_id", "id").agg(F.count("*").alias("waits"))
    now = now.join(waits, ["conv_id", "id"], "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long")))
    while True:
        now.write.parquet(f"{folder}/{depth}")
        done = spark.read.schema(now.schema).parquet(f"{folder}/{depth}")
        placed, open_ = done.where("waits = 0"), done.where("waits > 0")
        if not open_.head(1) or not placed.head(1):
            break
        up = (
            edges.join(placed.select("conv_id", F.col("id").alias("dep"), "level", "order_turn"), ["conv_id", "dep"])
            .groupBy("conv_id", "id")
            .agg((F.max("level") + 1).alias("l"), F.max("order_turn").alias("o"), F.count("*").alias("met"))
        )
        now = open_.join(up, ["conv_id", "id"], "left").select(
            "conv_id", "id", F.greatest("level", F.coalesce("l", F.lit(0))).alias("level"), F.greatest("order_turn", "o").alias("order_turn"), (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")
        )
        depth += 1
    every = spark.read.schema(done.schema).parquet(*(f"{folder}/{i}" for i in range(depth + 1))).where("waits = 0")
    return every.unionByName(open_).select("conv_id", "id", "level", "order_turn", (F.col("waits") > 0).alias("cyclic"))


def _wrong(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, id, fault of calls whose arguments break their tool's schema."""
    params = tools.where("fields is not null").select("conv_id", "name", F.explode("fields").alias("param", "spec"), "required")
    params = params.select("conv_id", "name", "param", F.expr("try_variant_get(spec, '$.type', 'string')").alias("type"), F.array_contains("required", F.col("param")).alias("must"))
    args = calls.select("conv_id", "id", "name", F.explode_outer("args").alias("param", "value"))
    given = args.where("param is not null").withColumn("got", F.expr("schema_of_variant(value)"))
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    g, p = given.alias("g"), params.alias("p")
    same = (F.col("g.conv_id") == F.col("p.conv_id")) & (F.col("g.name") == F.col("p.name")) & (F.col("g.param") == F.col("p.param"))
    pattern = F.try_element_at(known, F.col("p.type"))
    of_given = g.join(p, same, "left").select(
        "g.conv_id", "g.id", F.when(F.col("p.param").isNull(), "unknown").when(pattern.isNotNull() & ~F.rlike(F.col("g.got"), pattern), "type").alias("fault")
    )
    needed = calls.join(params.where("must"), ["conv_id", "name"]).select("conv_id", "id", "param")
    missing = needed.join(given.select("conv_id", "id", "param"), ["conv_id", "id", "param"], "left_anti").select("conv_id", "id", F.lit("missing").alias("fault"))
    required_only = tools.select("conv_id", "name", F.explode("required").alias("param"))
    undeclared_need = calls.join(required_only, ["conv_id", "name"]).join(given.select("conv_id", "id", "param"), ["conv_id", "id", "param"], "left_anti")
    missing = missing.unionByName(undeclared_need.select("conv_id", "id", F.lit("missing").alias("fault")))
    nowhere = calls.join(tools.select("conv_id", "name").distinct(), ["conv_id", "name"], "left_anti").select("conv_id", "id", F.lit("undeclared").alias("fault"))
    faults = of_given.where("fault is not null").unionByName(missing).unionByName(nowhere)
    return faults.groupBy("conv_id", "id").agg(F.min("fault").alias("fault"))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, order_turn, phase, level, seq, kind, call_id, status, line: a row per message, call and result."""
    rows = _json(messages)
    plain = rows.where("kind in ('plain', 'tools', 'invalid')").select(
        "conv_id", F.col("turn").alias("order_turn"), F.lit(0).alias("phase"), F.lit(0).alias("level"), F.lit(0).alias("seq"), "kind",
        F.lit(None).cast("string").alias("call_id"), F.col("kind").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("line"),
    )
    marked = rows.where("kind in ('call', 'result', 'tools')")
    if not marked.select("kind").head(1):
        return plain
    beside = rows.where("kind = 'call' and said is not null and not is_variant_null(said)").select(
        "conv_id", F.col("turn").alias("order_turn"), F.lit(0).alias("phase"), F.lit(0).alias("level"), F.lit(0).alias("seq"), F.lit("plain").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"), F.to_json(F.struct(F.col("said").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("line"),
    )
    plain = plain.unionByName(beside)
    get = lambda path, kind: F.expr(f"try_variant_get(c, '$.{path}', '{kind}')")
    calls = (
        rows.where("kind = 'call'")
        .select("conv_id", "turn", "role", F.posexplode("calls").alias("seq", "c"))
        .select(
            "conv_id", "turn", "role", "seq", get("id", "string").alias("id"), get("name", "string").alias("name"), get("arguments", "variant").alias("arguments"),
            get("arguments", "map<string,variant>").alias("args"), F.coalesce(get("depends_on", "array<string>"), F.array().cast("array<string>")).alias("deps"), F.to_json("c").alias("json"),
        )
    )
    place = F.struct("turn", "seq", "json", "role")
    firsts = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(place).alias("f"))
    calls = calls.join(firsts, ["conv_id", "id"], "left").withColumn("again", F.col("id").isNotNull() & F.col("conv_id").isNotNull() & ~place.eqNullSafe(F.col("f")))
    linked = written(calls.where("id is not null and name is not null and conv_id is not null and not again").drop("f"), "calls")
    linked = linked.dropDuplicates(["conv_id", "id"])
    declared = rows.where("kind = 'tools'").select("conv_id", "turn", F.posexplode("tools").alias("seq", "c")).select("conv_id", "turn", "seq", get("name", "string").alias("name"), F.to_json("c").alias("json"))
    declared = declared.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "seq", "json")).alias("f")).select("conv_id", "name", F.expr("parse_json(f.json)").alias("c"))
    tools = declared.select("conv_id", "name", get("parameters.properties", "map<string,variant>").alias("fields"), get("parameters.required", "array<string>").alias("required"))
    checked = linked.join(_levels(linked), ["conv_id", "id"]).join(_wrong(linked, tools), ["conv_id", "id"], "left")
    status = F.when(F.col("cyclic"), "cyclic").otherwise(F.coalesce("fault", F.lit("ok")))
    checked = written(checked.select("conv_id", "id", "turn", "role", "seq", "name", "arguments", "level", "order_turn", status.alias("status")), "checked-calls")
    call_line = F.to_json(F.struct(F.col("arguments").alias("arguments"), F.col("id"), F.col("name"), F.col("role")), {"ignoreNullFields": "false"})
    good = checked.select(
        "conv_id", "order_turn", F.lit(1).alias("phase"), "level", "seq", F.lit("call").alias("kind"), F.col("id").alias("call_id"), "status", call_line.alias("line")
    )
    bad = calls.where("id is null or name is null or conv_id is null or again").select(
        "conv_id", F.col("turn").alias("order_turn"), F.lit(1).alias("phase"), F.lit(0).alias("level"), "seq", F.lit("call").alias("kind"), F.col("id").alias("call_id"),
        F.when(F.col("again"), "duplicate").otherwise("invalid").alias("status"), call_line.alias("line"),
    )
    results = rows.where("kind = 'result'").select("conv_id", "turn", "role", F.col("result_of").alias("id"), F.expr("try_variant_get(v, '$.content', 'variant')").alias("content"))
    r = results.join(checked.select("conv_id", "id", "order_turn", "level", "seq", F.lit(True).alias("known")), ["conv_id", "id"], "left")
    result_line = F.to_json(F.struct("content", "role", F.col("id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    back = r.select(
        "conv_id", F.greatest(F.coalesce("order_turn", "turn"), F.when(F.col("known").isNull(), F.col("turn"))).alias("order_turn"), F.lit(1).alias("phase"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("seq", F.lit(0)).alias("seq"), F.lit("result").alias("kind"), F.col("id").alias("call_id"),
        F.when(F.col("known"), "ok").otherwise("orphan").alias("status"), result_line.alias("line"),
    )
    return plain.unionByName(good).unionByName(bad).unionByName(back)


def op2(conversations: DataFrame) -> DataFrame:
    """Every message, call and result; tables without calls give plain messages."""
    return formatted(conversations)


#: For tables without tool calls, as SQL states plain messages only; tests hold linking against brute force.
OP2_SQL = """
SELECT conv_id, turn AS order_turn, 0::INTEGER AS phase, 0::INTEGER AS level, 0::INTEGER AS seq, 'plain' AS kind, NULL::VARCHAR AS call_id, 'plain' AS status,
  to_json({'content': text, 'role': role})::VARCHAR AS line
FROM conversations
"""
