"""Chat formatting with tool calls: link, order, validate and serialise, in DataFrame operations only.

Calls and results meet in a hash join on conversation and identifier, calls that name other calls are put in topological
order by pointer doubling (a chain of n calls takes log n rounds, see ``depths``), arguments are checked field by field against a table of schemas, and every message becomes one line of
canonical JSON (keys sorted at every depth, no blanks). Nothing is gathered by conversation: a message is a row, and
``(depth, turn)`` is its place, so one conversation may hold any share of all rows.

Tables:

* messages ``(conv_id, turn, role, text, call_id, name, arguments)``: ``arguments`` is JSON text of an object; its
  optional field ``after`` lists identifiers of calls that must come first. A row of role ``tool`` answers ``call_id``.
* schemas ``(name, field, kind, required)``: ``kind`` is a JSON type name (string, integer, number, boolean, array,
  object, null). Its size is that of the tools' description; it is joined, never collected.

Defined results: arguments that are null, no JSON, no object or hold a key twice -> status ``bad_json``; a call of an
unknown tool -> ``unknown_tool``; a missing, superfluous or ill-typed field -> ``bad_arguments``; calls without answer
-> ``linked`` false; results without call -> ``linked`` false; names in ``after`` that no call bears are ignored;
calls in or behind a cycle get depth -1; a null text is JSON null; identifiers hold within
their conversation (rows with a null conv_id form one), and calls or results that share one are each linked;
rows with a null call_id are plain messages; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

MESSAGE = ["conv_id", "turn", "role", "text", "call_id", "name", "arguments"]
SCHEMA_ROWS = [
    ("search", "query", "string", True),
    ("search", "turn", "integer", True),
    ("search", "after", "array", False),
    ("score", "query", "string", True),
    ("score", "turn", "integer", True),
    ("score", "points", "integer", True),
    ("score", "after", "array", False),
]


def _kind(value) -> F.Column:
    """JSON type name of a variant."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "STRING", "string")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "number")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def depths(calls: DataFrame, edges: DataFrame, widest: int = 128) -> DataFrame:
    """(id, depth) of ``calls(id)``: 0 without predecessors, else one more than the deepest; -1 in or behind a cycle.

    ``edges(id, before)`` name calls only. A row ``(id, before, w, base)`` says: the depth is at least ``base`` and at least
    that of ``before`` plus ``w``. In a round, an edge to a call of known depth becomes a bound, and one to a call with a
    single edge left jumps over it, so a chain of n calls takes log n rounds. A call whose predecessors have ``widest``
    edges in all, or fewer, jumps over all of them at once (no call ever gets more edges than that, or than it began
    with); the others wait for their last edge. Each round is written, so no plan holds more than one. In every round at
    least one open call becomes known, but for those that depend on a cycle.
    """
    far = F.lit(1 << 40)  # bounds of a cycle do not overflow
    state = calls.distinct().join(edges.distinct(), "id", "left").select("id", "before", F.when(F.col("before").isNotNull(), 1).cast("long").alias("w"), F.lit(0).cast("long").alias("base"))
    state, left = written(state, "order"), None
    while True:
        edge = F.when(F.col("before").isNotNull(), F.struct("before", "w"))
        info = state.groupBy("id").agg(F.count("before").alias("n"), F.max("base").alias("least"), F.collect_list(edge).alias("next"))
        now = info.where("n > 0").count()
        if now == 0 or now == left:
            return info.select("id", F.when(F.col("n") == 0, F.col("least")).otherwise(-1).cast("int").alias("depth"))
        left = now
        known = info.select(F.col("id").alias("before"), "n", "least", F.when(F.col("n") <= widest, F.col("next")).alias("next"))
        met = state.where("before is not null").join(known, "before")
        met = met.withColumn("fan", F.sum(F.greatest("n", F.lit(1))).over(Window.partitionBy("id")))
        jumps = (F.col("n") <= 1) | (F.col("fan") <= widest)
        over = F.transform("next", lambda e: F.struct(e["before"].alias("before"), F.least(F.col("w") + e["w"], far).alias("w")))
        to = F.when(~jumps, F.array(F.struct("before", "w"))).otherwise(over)
        bound = F.when(jumps, F.least(F.greatest("base", F.col("least") + F.col("w")), far)).otherwise(F.col("base"))
        met = met.select("id", F.explode_outer(to).alias("e"), bound.alias("base")).select("id", "e.before", "e.w", "base")
        rows = met.unionByName(state.where("before is null"))
        state = written(rows.groupBy("id", "before").agg(F.max("w").alias("w"), F.max("base").alias("base")), "order")


def judged_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(row, status, canonical) for ``calls(row, name, arguments)``, checked field by field."""
    rows = calls.select("row", "name", F.try_parse_json("arguments").alias("v"))
    rows = rows.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    rows = rows.withColumn("canonical", F.to_json("v"))
    fields = rows.where("v is not null").select("row", "name", F.explode(F.from_json("canonical", "map<string,variant>")).alias("field", "value"))
    fields = fields.select("row", "name", "field", _kind(F.col("value")).alias("kind"))
    allowed = schemas.select("name", "field", F.col("kind").alias("wanted"), "required")
    met = fields.join(allowed, ["name", "field"], "left")
    fits = (F.col("kind") == F.col("wanted")) | ((F.col("wanted") == "number") & (F.col("kind") == "integer"))
    by_row = met.groupBy("row").agg(F.sum(F.when(fits, 0).otherwise(1)).alias("wrong"), F.sum(F.when(F.col("required"), 1).otherwise(0)).alias("required_met"))
    tools = schemas.groupBy("name").agg(F.sum(F.col("required").cast("int")).alias("required_all"))
    out = rows.select("row", "name", "canonical").join(by_row, "row", "left").join(tools, "name", "left")
    status = (
        F.when(F.col("canonical").isNull(), "bad_json")
        .when(F.col("required_all").isNull(), "unknown_tool")
        .when((F.coalesce("wrong", F.lit(0)) > 0) | (F.coalesce("required_met", F.lit(0)) < F.col("required_all")), "bad_arguments")
        .otherwise("ok")
    )
    return out.select("row", status.alias("status"), "canonical")


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, role, call_id, depth, linked, status, json): one row for each message."""
    rows = messages.select(*[F.col(f"`{c}`") for c in MESSAGE])
    rows = rows.withColumn("row", F.md5(F.to_json(F.struct("name", "arguments"))))
    within = lambda c: F.to_json(F.struct("conv_id", F.col(c).alias("call_id")))  # noqa: E731  identifiers hold within a conversation
    rows = rows.withColumn("key", within("call_id"))
    is_call = F.col("call_id").isNotNull() & (F.col("role") == "assistant")
    is_result = F.col("call_id").isNotNull() & (F.col("role") == "tool")
    calls, results = rows.where(is_call), rows.where(is_result)
    answered = results.select("key").distinct().withColumn("met", F.lit(True))
    named = calls.select(F.col("key").alias("id"))
    judged = written(judged_arguments(calls.select("row", "name", "arguments").distinct(), schemas), "judged")
    wanted = calls.select(F.col("key").alias("id"), "conv_id", F.explode(F.from_json(F.get_json_object("arguments", "$.after"), "array<string>")).alias("other"))
    wanted = wanted.where("other is not null").select("id", within("other").alias("before")).join(named.withColumnRenamed("id", "before"), "before", "left_semi")
    order = written(depths(named, wanted.select("id", "before")), "depths").withColumnRenamed("id", "key")
    calls = calls.join(answered, "key", "left").join(judged, "row", "left").join(order, "key", "left")
    results = results.join(order, "key", "left").withColumn("met", F.col("depth").isNotNull())
    line = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in sorted(x.items())]), {"ignoreNullFields": "false"})
    text = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    quoted = lambda c: F.regexp_replace(text(c), r"^\[|\]$", "")
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", quoted("arguments")), F.lit(',"content":'), quoted("text"), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"role":"assistant"}'))
    base = ["conv_id", "turn", "role", "call_id"]
    met = F.coalesce("met", F.lit(False)).alias("linked")
    none = F.lit(None)
    a = calls.select(*base, "depth", met, "status", call_json.alias("json"))
    b = results.select(*base, "depth", met, F.when(F.col("met"), "ok").otherwise("orphan").alias("status"), line(content=F.col("text"), role=F.col("role"), tool_call_id=F.col("call_id")).alias("json"))
    plain = rows.where(~F.coalesce(is_call | is_result, F.lit(False)))
    c = plain.select("conv_id", "turn", "role", none.cast("string").alias("call_id"), none.cast("int").alias("depth"), F.lit(False).alias("linked"), F.lit("message").alias("status"), line(content=F.col("text"), role=F.col("role")).alias("json"))
    return a.unionByName(b).unionByName(c)


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages with tool calls, by a fixed rule.

    Each assistant turn calls a tool with its whole text (``score`` where the text's length divides by three, else
    ``search``), after the call of its conversation two turns before; ``points`` is given from the third turn on. A
    user turn after the first answers the call of the turn before it.
    """
    ident = lambda d: F.concat(F.lit("call-"), (F.col("turn") - d).cast("string"))
    size = F.length("text")
    points = F.when(F.col("turn") > 2, F.concat(F.lit(',"points":'), size.cast("string"))).otherwise("")
    arguments = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "query": '), F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", ""), points, F.lit(', "after": ["'), ident(2), F.lit('"]}'))
    call, answer = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    return conversations.select(
        "conv_id", "turn", F.when(answer, "tool").otherwise(F.col("role")).alias("role"), F.when(~call, F.col("text")).alias("text"),
        F.when(call, ident(0)).when(answer, ident(1)).alias("call_id"), F.when(call, F.when(size % 3 == 0, "score").otherwise("search")).alias("name"), F.when(call, arguments).alias("arguments"),
    )


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMA_ROWS, "name string, field string, kind string, required boolean")


def op10_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(as_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), tool_schemas(spark))


OP10_SQL = """
WITH RECURSIVE base AS (
  SELECT conv_id, turn, text, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role,
         CASE WHEN role = 'assistant' THEN 'call-' || turn
              WHEN role = 'user' AND turn > 0 THEN 'call-' || (turn - 1) END AS call_id
  FROM conversations),
calls AS (
  SELECT *, CASE WHEN length(text) % 3 = 0 THEN 'score' ELSE 'search' END AS name FROM base WHERE role = 'assistant'),
deep AS (
  SELECT conv_id, turn, 0 AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, d.depth + 1 FROM deep d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
a AS (
  SELECT c.conv_id, c.turn, c.role, c.call_id, d.depth,
         EXISTS (SELECT 1 FROM base r WHERE r.role = 'tool' AND r.conv_id = c.conv_id AND r.call_id = c.call_id) AS linked,
         CASE WHEN name = 'score' AND c.turn <= 2 OR name = 'search' AND c.turn > 2 THEN 'bad_arguments' ELSE 'ok' END AS status,
         '{"arguments":{"after":["call-' || (c.turn - 2) || '"]'
         || CASE WHEN c.turn > 2 THEN ',"points":' || length(text) ELSE '' END
         || ',"query":' || to_json(text)::varchar || ',"turn":' || c.turn || '},"content":null,"id":"' || c.call_id
         || '","name":"' || name || '","role":"assistant"}' AS json
  FROM calls c JOIN deep d ON d.conv_id = c.conv_id AND d.turn = c.turn),
b AS (
  SELECT r.conv_id, r.turn, r.role, r.call_id, d.depth, d.depth IS NOT NULL AS linked,
         CASE WHEN d.depth IS NULL THEN 'orphan' ELSE 'ok' END AS status,
         '{"content":' || to_json(text)::varchar || ',"role":"tool","tool_call_id":"' || r.call_id || '"}' AS json
  FROM base r LEFT JOIN deep d ON d.conv_id = r.conv_id AND d.turn = r.turn - 1 WHERE r.role = 'tool'),
c AS (
  SELECT conv_id, turn, role, CAST(NULL AS varchar) AS call_id, CAST(NULL AS integer) AS depth, FALSE AS linked,
         'message' AS status, '{"content":' || to_json(text)::varchar || ',"role":' || to_json(role)::varchar || '}' AS json
  FROM base WHERE call_id IS NULL)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c
"""
