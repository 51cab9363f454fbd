"""Chat formatting by tool-call linking; DataFrame functions only.

Calls and results are joined by conversation and call id. Arguments are checked
against the tool's schema, calls get a level (one more than the calls they wait
for) so that ordering by level, call turn and id is a topological order, and each
exchange is written as canonical JSON: sorted keys, no white space.

Of several calls with one id the one of smallest turn, name and arguments
counts, of several results that of smallest turn and content; ``repeats`` counts
the rest. Both are reduced by partial aggregates before the join, so that a key
which repeats very often is no burden. A call without an id gets ``turn:<n>``, and
``turn:null`` without a turn; a result without an id answers nothing and is left out.
Rows without a conversation id belong to one conversation of their own. Null or
malformed arguments are reported in ``errors``; a null result content is an empty
text. Calls that wait for one another in a circle, or for such, have a null level and
the error ``cycle``. References to calls that don't exist don't hold a call back. An
empty table gives no rows. Columns other than those named, and their names, don't matter.

Levels take rounds: the logarithm of the longest run of calls that each wait for one
other, and then, in conversations of more than ``PACKED`` calls that wait for several,
one round for each level of these. Smaller ones are placed at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY = ["conv", "call_id"]
#: A conversation of no more calls that wait for several, and of no more edges between them, is placed as one row.
PACKED = 128, 1024


@dataclass(frozen=True)
class Param:
    """``type``: string, integer, number, boolean, array or object."""

    type: str
    required: bool = True
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None


_TYPES = {
    "string": "STRING", "integer": "(TINYINT|SMALLINT|INT|BIGINT)", "number": "(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)",
    "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>",
}

#: The stated set of tools of the query over ``conversations``.
REPLY = {"reply": {"prompt": Param("string", min_length=1, max_length=300), "turn": Param("integer", minimum=0)}}


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict[str, Param]]) -> Column:
    """Sorted array of what is wrong with a call's arguments."""
    v = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    none = F.lit(None).cast("string")
    per_tool = F.array(F.lit("unknown tool")).cast("array<string>")
    for tool, params in tools.items():
        found = []
        for p, spec in sorted(params.items()):
            raw = F.try_variant_get(v, f"$['{p}']", "variant")
            kind, text = F.schema_of_variant(raw), F.try_variant_get(v, f"$['{p}']", "string")
            absent = raw.isNull() | (kind == "VOID")
            if spec.required:
                found.append(F.when(absent, F.lit(f"{p}: missing")))
            typed = kind.rlike(f"^{_TYPES[spec.type]}$")
            found.append(F.when(~absent & ~typed, F.lit(f"{p}: not {spec.type}")))
            if spec.min_length is not None:
                found.append(F.when(typed & (F.length(text) < spec.min_length), F.lit(f"{p}: too short")))
            if spec.max_length is not None:
                found.append(F.when(typed & (F.length(text) > spec.max_length), F.lit(f"{p}: too long")))
            if spec.minimum is not None:
                found.append(F.when(typed & (F.try_variant_get(v, f"$['{p}']", "double") < spec.minimum), F.lit(f"{p}: too small")))
        keys = F.json_object_keys(arguments)
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in params]).cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        wrong = F.array_sort(F.concat(F.array_compact(F.array(*found, none)), F.coalesce(extra, F.array().cast("array<string>"))))
        per_tool = F.when(name == tool, wrong).otherwise(per_tool)
    return F.when(~is_object, F.array(F.lit("arguments: no object"))).otherwise(per_tool)


def levels(calls: DataFrame) -> DataFrame:
    """The calls with a column ``level``: one more than the highest level waited for.

    ``calls``: ``conv, call_id, after`` and others, one row for each key, no key null. Runs of
    calls that each wait for one other are jumped over by pointer doubling, in rounds of
    the logarithm of their length. Only calls that wait for several are then placed, over
    edges that lead from such a call to the head of a run: a small conversation in one
    projection, a large one level by level. A round reads the calls that still wait and those
    of the round before, never those that wait for nothing or are done. What waits in a circle, or for such a call, gets a null level.
    """
    lean = common.materialise(calls.select(*KEY, "after"), "calls")
    edges = lean.select(*KEY, F.explode(F.array_distinct("after")).alias("after")).filter("after IS NOT NULL")
    waits = edges.join(lean.select("conv", F.col("call_id").alias("after")), ["conv", "after"], "left_semi")
    waits = common.materialise(waits.groupBy(*KEY).agg(F.collect_list("after").alias("after")), "waits")
    common.discard(lean)
    if waits.isEmpty():
        return calls.withColumn("level", F.lit(0))
    # head and distance of every call that waits for one other; open while the head is such a call as well
    single = waits.filter(F.size("after") == 1).select(*KEY, F.col("after")[0].alias("head"), F.lit(1).alias("far"))
    more = single.select("conv", F.col("call_id").alias("head"), F.lit(True).alias("more"))
    run = common.materialise(single.join(more, ["conv", "head"], "left").select(*KEY, "head", "far", F.col("more").isNotNull().alias("open")), "run")
    for _ in range(run.count().bit_length() + 1):
        if run.filter("open").isEmpty():
            break
        nxt = run.select("conv", F.col("call_id").alias("head"), F.col("head").alias("head2"), F.col("far").alias("far2"), F.col("open").alias("open2"))
        moved = run.filter("open").join(nxt, ["conv", "head"]).select(*KEY, F.col("head2").alias("head"), (F.col("far") + F.col("far2")).alias("far"), F.col("open2").alias("open"))
        before, run = run, common.materialise(run.filter("NOT open").union(moved), "run")
        common.discard(before)
    placed = _placed(waits, run).withColumn("several", F.lit(True))
    at = placed.select("conv", F.col("call_id").alias("head"), "level", "several")
    of_run = F.when(~F.col("open"), F.when(F.col("several"), F.col("level")).otherwise(0) + F.col("far"))
    known = placed.select(*KEY, "level", "several").union(run.join(at, ["conv", "head"], "left").select(*KEY, of_run, F.lit(True))).withColumnRenamed("several", "waits")
    return calls.join(known, KEY, "left").withColumn("level", F.when(F.col("waits"), F.col("level")).otherwise(0)).drop("waits")


def _placed(waits: DataFrame, run: DataFrame) -> DataFrame:
    """``conv, call_id, level`` of the calls that wait for several, null if it can't be told."""
    several = waits.filter(F.size("after") > 1)
    edges = several.select(*KEY, F.explode("after").alias("to"))
    edges = edges.join(run.select("conv", F.col("call_id").alias("to"), "head", "far", "open"), ["conv", "to"], "left")
    edges = edges.select(*KEY, F.coalesce("head", "to").alias("head"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.coalesce("open", F.lit(False)).alias("circle"))
    edges = edges.join(several.select("conv", F.col("call_id").alias("head"), F.lit(True).alias("later")), ["conv", "head"], "left")
    ahead = F.when(F.col("circle") | F.col("later"), F.struct("head", "far"))
    # level: the highest by what is known; ahead: heads without a level yet
    state = edges.groupBy(*KEY).agg(F.max(F.when(ahead.isNull(), F.col("far"))).alias("level"), F.collect_set(ahead).alias("ahead"))
    state = common.materialise(state, "state")
    n = state.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.size("ahead")).alias("m"))
    large = common.materialise(n.filter((F.col("n") > PACKED[0]) | (F.col("m") > PACKED[1])).select("conv"), "large")
    if large.isEmpty():
        return _packed(state)
    return _packed(state.join(large, "conv", "left_anti")).union(_by_rounds(state.join(large, "conv", "left_semi")))


def _packed(state: DataFrame) -> DataFrame:
    """Levels of conversations that fit an array: as many relaxations as calls, in one projection.

    Null stands for no level yet, and for none at all in the end.
    """
    packs = state.groupBy("conv").agg(F.collect_list(F.struct("call_id", "level", "ahead")).alias("calls"))
    at = lambda ids: lambda e: F.struct(F.array_position(ids, e["head"]).cast("int").alias("at"), e["far"].alias("far"))
    ids = F.transform("calls", lambda c: c["call_id"])
    packs = packs.withColumn("ids", ids).withColumn("calls", F.transform("calls", lambda c: F.struct(c["level"].alias("level"), F.transform(c["ahead"], at(F.col("ids"))).alias("ahead"))))
    # array_position gives 0 where a head has no level ever; -1 is then no index, and get() null
    level_of = lambda of: lambda e: F.get(of, e["at"] - 1) + e["far"]
    step = lambda of: F.transform("calls", lambda c: F.when(~F.exists(c["ahead"], lambda e: F.get(of, e["at"] - 1).isNull()), F.greatest(c["level"], F.array_max(F.transform(c["ahead"], level_of(of))))))
    start = F.transform("calls", lambda c: F.lit(None).cast("int"))
    packs = packs.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.size("calls")), start, lambda of, _: step(of)))
    return packs.select("conv", F.inline(F.arrays_zip(F.col("ids").alias("call_id"), F.col("levels").alias("level")))).toDF(*KEY, "level")


def _by_rounds(state: DataFrame) -> DataFrame:
    """The same for conversations of any size, a round of jobs for each level."""
    state = common.materialise(state, "state")
    spark, path = state.sparkSession, common.fresh_path(state.sparkSession, "placed")
    common.delete_at_exit(spark, path)
    while True:
        done, left = state.filter(F.size("ahead") == 0).select(*KEY, "level"), state.filter(F.size("ahead") > 0)
        stuck = done.isEmpty()
        if stuck:
            done = left.select(*KEY, F.lit(None).cast("int").alias("level"))
        done.write.mode("append").parquet(path)
        if stuck or left.isEmpty():
            common.discard(state)
            return spark.read.schema(done.schema).parquet(path)
        now = done.select("conv", F.col("call_id").alias("head"), F.col("level").alias("at"))
        edges = left.select(*KEY, "level", F.explode("ahead").alias("e")).select(*KEY, "level", "e.head", "e.far").join(now, ["conv", "head"], "left")
        ahead = F.when(F.col("at").isNull(), F.struct("head", "far"))
        nxt = edges.groupBy(*KEY).agg(F.max(F.greatest("level", F.col("at") + F.col("far"))).alias("level"), F.collect_set(ahead).alias("ahead"))
        before, state = state, common.materialise(nxt, "state")
        common.discard(before)


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict[str, Param]]) -> DataFrame:
    """One row for each call id of a conversation.

    ``calls``: ``conv_id, turn, call_id, name, arguments, after`` (ids it waits
    for, may be null); ``results``: ``conv_id, turn, call_id, content``.
    """
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))  # never null: a key of joins
    named = F.coalesce("call_id", F.concat(F.lit("turn:"), F.coalesce(F.col("turn").cast("string"), F.lit("null"))))
    c = calls.select("conv_id", conv.alias("conv"), "turn", named.alias("call_id"), "name", "arguments", "after").groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("nc"), F.max("conv_id").alias("conv_c")
    )
    r = results.filter("call_id IS NOT NULL").select("conv_id", conv.alias("conv"), "turn", "call_id", "content")
    r = r.groupBy(*KEY).agg(F.min(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("r"), F.count("*").alias("nr"), F.max("conv_id").alias("conv_r"))
    both = levels(c.withColumn("after", F.col("c.after"))).join(r, KEY, "full_outer")
    is_call = F.col("c").isNotNull()
    errors = F.when(is_call, argument_errors(F.col("c.name"), F.col("c.arguments"), tools)).otherwise(F.array().cast("array<string>"))
    errors = F.array_compact(F.concat(errors, F.array(F.when(is_call & F.col("level").isNull(), F.lit("cycle")))))
    status = (
        F.when(~is_call, "orphan result").when(F.col("r").isNull(), "no result").when(F.col("r.turn") < F.col("c.turn"), "result first").otherwise("linked")
    )
    said = F.struct(
        F.coalesce(F.try_parse_json("c.arguments"), F.when(is_call, F.try_parse_json(F.lit("null")))).alias("arguments"),
        F.col("call_id").alias("id"), F.col("level"), F.col("c.name").alias("name"), F.col("r.content").alias("result"),
    )
    return both.select(
        F.coalesce("conv_c", "conv_r").alias("conv_id"), "call_id", F.lit("exchange").alias("kind"), F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"), "level",
        status.alias("status"), F.array_join(errors, "; ").alias("errors"),
        (F.coalesce("nc", F.lit(0)) + F.coalesce("nr", F.lit(0)) - is_call.cast("long") - F.col("r").isNotNull().cast("long")).alias("repeats"),
        F.to_json(said).alias("json"),
    )


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns.

    A user turn calls the tool ``reply`` with its text; the assistant turn that
    follows is the result. A call waits for the user turn two before it, if any. Rows
    without a turn are neither: ``report`` has them as messages.
    """
    t = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")).filter("turn IS NOT NULL")
    name = lambda n: F.concat(F.lit("call_"), n.cast("string"))
    calls = t.filter("role = 'user'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"))).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"),
    )
    return calls, t.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def report(conversations: DataFrame) -> DataFrame:
    """Exchanges, and every other turn as a message of its own."""
    calls, results = from_turns(conversations)
    rest = conversations.filter("role IS NULL OR role NOT IN ('user', 'assistant') OR turn IS NULL")
    nothing = F.lit(None)
    rest = rest.select(
        "conv_id", nothing.cast("string").alias("call_id"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("call_turn"), nothing.cast("long").alias("result_turn"),
        nothing.cast("int").alias("level"), F.lit("message").alias("status"), F.when(F.col("turn").isNull(), "turn: missing").otherwise("").alias("errors"), F.lit(0).cast("long").alias("repeats"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return link(calls, results, REPLY).unionByName(rest)


ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL),
c AS (SELECT conv_id, 'call_' || turn AS call_id, min(turn) AS turn, min(text) AS text, count(*) AS n FROM t WHERE role = 'user' GROUP BY 1, 2),
r AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(turn) AS turn, min(coalesce(text, '')) AS content, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1, 2),
l AS (
  SELECT conv_id, call_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS p WHERE p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.call_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.turn = l.turn + 2),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn, l.level, c.text, r.content,
    coalesce(c.n, 0) + coalesce(r.n, 0) - (c.turn IS NOT NULL)::INT - (r.turn IS NOT NULL)::INT AS repeats
  FROM c FULL JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id LEFT JOIN l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.call_id = l.call_id)
SELECT conv_id, call_id, 'exchange' AS kind, call_turn, result_turn, level,
  CASE WHEN call_turn IS NULL THEN 'orphan result' WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END AS status,
  CASE WHEN call_turn IS NULL THEN '' WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: too short' WHEN length(text) > 300 THEN 'prompt: too long' ELSE '' END AS errors,
  repeats::BIGINT AS repeats,
  '{' || concat_ws(',', CASE WHEN call_turn IS NOT NULL THEN '"arguments":{' || concat_ws(',', '"prompt":' || to_json(text)::VARCHAR, '"turn":' || call_turn) || '}' END,
    '"id":' || to_json(call_id)::VARCHAR, '"level":' || level, CASE WHEN call_turn IS NOT NULL THEN '"name":"reply"' END, '"result":' || to_json(content)::VARCHAR) || '}' AS json
FROM j
UNION ALL
SELECT conv_id, NULL, 'message', turn, NULL, NULL, 'message', CASE WHEN turn IS NULL THEN 'turn: missing' ELSE '' END, 0, '{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR turn IS NULL
"""

#: A stated set of tools for ``orders_as_calls``.
SHOP = {"order": {"priority": Param("string", min_length=6), "status": Param("string", max_length=1), "total": Param("number", minimum=1000)}}


def orders_as_calls(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A table of exchanges: every order is a call, every item of it a result.

    Each hundred of order numbers is a conversation. An urgent order waits for those
    1, 2 and 5 numbers before it, as far as they are in it, one of high priority for
    the one before; results beyond the first of an order are repeats.
    """
    name = lambda n: F.concat(F.lit("o"), n.cast("string"))
    k = F.col("o_orderkey")
    calls = orders.select(
        F.floor(k / 100).alias("conv_id"), k.cast("long").alias("turn"), name(k).alias("call_id"), F.lit("order").alias("name"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))).alias("arguments"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(name(k - 1), name(k - 2), name(k - 5))).when(F.col("o_orderpriority") == "2-HIGH", F.array(name(k - 1))).alias("after"),
    )
    of = F.col("l_orderkey")
    results = lineitem.select(F.floor(of / 100).alias("conv_id"), (of + F.col("l_linenumber")).cast("long").alias("turn"), name(of).alias("call_id"), F.col("l_returnflag").alias("content"))
    return link(calls, results, SHOP).drop("kind", "json")


ORDERS_ORACLE = """
WITH RECURSIVE c AS (SELECT o_orderkey // 100 AS conv_id, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS total FROM orders),
e AS (SELECT a.conv_id, a.k, b.k AS to_k FROM c a JOIN c b ON a.conv_id = b.conv_id AND (b.k = a.k - 1 AND a.p IN ('1-URGENT', '2-HIGH') OR b.k IN (a.k - 2, a.k - 5) AND a.p = '1-URGENT')),
path AS (SELECT k, 0 AS d FROM c UNION SELECT e.k, path.d + 1 FROM path JOIN e ON e.to_k = path.k),
lv AS (SELECT k, max(d) AS level FROM path GROUP BY 1),
r AS (SELECT l_orderkey AS k, min(l_orderkey + l_linenumber) AS turn, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c.conv_id, 'o' || c.k AS call_id, c.k AS call_turn, r.turn AS result_turn, lv.level, CASE WHEN r.k IS NULL THEN 'no result' ELSE 'linked' END AS status,
  concat_ws('; ', CASE WHEN length(p) < 6 THEN 'priority: too short' END, CASE WHEN length(s) > 1 THEN 'status: too long' END, CASE WHEN total < 1000 THEN 'total: too small' END) AS errors,
  greatest(coalesce(r.n, 0) - 1, 0)::BIGINT AS repeats
FROM c JOIN lv ON lv.k = c.k LEFT JOIN r ON r.k = c.k
"""
