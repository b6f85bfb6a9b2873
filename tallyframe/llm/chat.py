"""Chat formatting: tool calls linked to their results, checked, ordered and serialised.

Calls and results are hash-joined by (conversation, identifier). Arguments are parsed as
variants; each top-level argument is compared with the schema of its tool. A call runs
after the calls that it depends on: (place, round, position) is a topological order of a
conversation. Where dependencies point to earlier positions, the positions are that order
(place is the position, round 0). A dependency on a later call makes a block of all calls
from the one to the other, and blocks that overlap are one; its calls share a place, and a
call's round is one more than the greatest of the calls in the block that it needs. Rounds are found by
sweeps over a block from its end and from its beginning, so chains of any length in either direction
take one; a path that turns back and forth needs more, which follow one another within the row. Calls on a cycle, and those of the
block that need them, have round null. Canonical JSON has sorted keys, no blanks and one
form for each number, without an exponent and without zeros at its end (``1.0`` and ``1`` are ``1``, ``1e10`` is
``10000000000``, ``2.5e-7`` is ``0.00000025``); a number of more than 38 digits is the nearest double. DataFrame functions only.

Defined results: a call without a result has result null and linked false; of several
results of one call the first by position is linked, of several calls with one
identifier the first by position stands for it, and n_repeats says how many there were;
arguments that are no JSON object are invalid and serialised as null; a call of an
unknown tool is invalid; a missing conversation or identifier links with nothing and
leaves the call out of the order; empty tables give no rows; extra columns are ignored. A conversation may have any
length: its calls are joined and numbered by shuffles; a block of calls that need later ones is one row; paths within it that turn
back and forth take a sweep for each turn, and each SWEEPS of them a Spark job; very long arguments and results are handled whole, each in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import salted_lookup, written

#: Tool schemas are broadcast up to this many fields; beyond it they are joined by a salted shuffle.
BROADCAST_FIELDS = 10_000
#: Positions of a conversation that are sorted together.
SPAN = 4096
#: Sweeps (there and back) over a block before what they have found is written.
SWEEPS = 256
#: Levels of a sweep that are appended to one array before the next one is begun, since an append copies its array.
PIECE = 256


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(number: Column) -> Column:
    """A number that has an exponent (``-1.25E-7``) in digits alone."""
    mantissa, power = F.ltrim(F.split_part(number, F.lit("E"), F.lit(1)), F.lit("-")), F.split_part(number, F.lit("E"), F.lit(2)).cast("int")
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.rtrim(F.split_part(mantissa, F.lit("."), F.lit(2)), F.lit("0"))
    digits, point = F.concat(whole, part), F.length(whole) + power
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    value = F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    return F.concat(F.when(number.startswith("-"), "-").otherwise(""), value)


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, no blanks and one form for each number, or null: a variant object keeps its fields in key order."""
    # escaped backslashes and quotes are put aside, so that every second piece between quotes is outside strings
    pieces = F.split(F.replace(F.replace(F.to_json(F.try_parse_json(json)), F.lit("\\\\"), F.lit("\1")), F.lit('\\"'), F.lit("\2")), '"')
    # a piece with exponents is cut where its numbers begin and end
    cut = lambda x: F.split(x, r"(?<=[,:\[])(?=[-0-9])|(?<=[0-9])(?=[,\]}])")
    spelled = lambda x: F.when(x.rlike("[0-9]E"), F.array_join(F.transform(cut(x), lambda y: F.when(y.rlike("[0-9]E"), plain(y)).otherwise(y)), "")).otherwise(x)
    outside = lambda x: F.regexp_replace(F.regexp_replace(spelled(x), r"(?<=[0-9])\.0(?![0-9])", ""), r"-0(?![0-9.])", "0")
    whole = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x)), '"')
    return F.replace(F.replace(whole, F.lit("\2"), F.lit('\\"')), F.lit("\1"), F.lit("\\\\"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls (with name, arguments, spread) and an ``errors`` array: unknown tool, no object, missing, unexpected or mistyped arguments."""
    fields = schemas.groupBy("name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "kind")))).alias("_kinds"),
        F.sort_array(F.collect_list(F.when(F.col("required"), F.col("field")))).alias("_required"),
    )
    if schemas.count() <= BROADCAST_FIELDS:
        met = calls.join(F.broadcast(fields), "name", "left")
    else:
        met = salted_lookup(calls, fields, "name", "call_id")
    given = F.from_json("arguments", "map<string,variant>")
    met = met.withColumn("_given", F.when(F.substring(F.ltrim("arguments"), 1, 1) == "{", given))
    of_kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    held = F.transform(F.map_entries("_given"), lambda e: F.struct(e["key"].alias("field"), of_kind(e["value"]).alias("kind")))
    family = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
    fits = lambda want, kind: F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for k, v in family.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), want), kind), F.lit(False))
    missing = F.transform(F.filter("_required", lambda r: ~F.exists("_held", lambda h: (h["field"] == r) & (h["kind"] != "VOID"))), lambda r: F.concat(F.lit("missing "), r))
    strange = F.transform(F.filter("_held", lambda h: ~F.map_contains_key("_kinds", h["field"])), lambda h: F.concat(F.lit("unexpected "), h["field"]))
    wrong = F.transform(F.filter("_held", lambda h: F.map_contains_key("_kinds", h["field"]) & (h["kind"] != "VOID") & ~fits(F.element_at("_kinds", h["field"]), h["kind"])), lambda h: F.concat(F.lit("mistyped "), h["field"]))
    errors = F.when(F.col("_kinds").isNull(), F.array(F.lit("unknown tool"))).when(F.col("_held").isNull(), F.array(F.lit("no object"))).otherwise(F.array_sort(F.concat(missing, strange, wrong)))
    return met.withColumn("_held", held).withColumn("errors", errors).drop("_kinds", "_required", "_given", "_held")


def running_max(rows: DataFrame, value: Column, out: str, before: bool = False) -> DataFrame:
    """rows with the greatest value of their conversation up to their position (with before: at earlier ones only).

    In two levels, stretches of SPAN positions and the stretches themselves, so that no task sorts a whole conversation.
    """
    held = rows.withColumn("_value", value).withColumn("_span", F.floor(F.col("position") / SPAN))
    own = Window.partitionBy("conv_id", "_span").orderBy("position").rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.groupBy("conv_id", "_span").agg(F.max("_value").alias("_most")).select("conv_id", "_span", F.max("_most").over(earlier).alias("_carried"))
    met = held.withColumn("_own", F.max("_value").over(own)).join(carried, ["conv_id", "_span"])
    return met.withColumn(out, F.greatest("_own", "_carried")).drop("_value", "_span", "_own", "_carried")


def blocks(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, at, deps) of the calls within a block: where it begins, the call's number in it, and the numbers of those it needs there."""
    ahead = edges.filter("needs_position >= position").groupBy("conv_id", "call_id").agg(F.max("needs_position").alias("reach"))
    odd = ahead.select("conv_id").distinct()
    rows = calls.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "position").join(ahead, ["conv_id", "call_id"], "left")
    rows = running_max(running_max(rows, F.col("reach"), "covered", before=True), F.col("reach"), "reached")
    begins = F.col("reach").isNotNull() & (F.col("covered").isNull() | (F.col("covered") < F.col("position")))
    inside = running_max(rows, F.when(begins, F.col("position")), "place").filter("reached >= position")
    numbered = written(inside.select("conv_id", "call_id", "place", F.row_number().over(Window.partitionBy("conv_id", "place").orderBy("position", "call_id")).alias("at")), "blocks")
    needed = numbered.select("conv_id", "place", F.col("call_id").alias("needs"), F.col("at").alias("needs_at"))
    held = numbered.join(edges.select("conv_id", "call_id", "needs"), ["conv_id", "call_id"]).join(needed, ["conv_id", "place", "needs"])
    deps = held.groupBy("conv_id", "call_id").agg(F.collect_list("needs_at").alias("deps"))
    return numbered.join(deps, ["conv_id", "call_id"], "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<int>")))


def _sweep(levels: Column, backward: bool) -> Column:
    """levels of a block's calls (null: unknown) after one pass over them, in which later calls see what earlier ones have become."""
    n, none = F.size("deps"), F.array().cast("array<int>")

    def fresh(acc: Column, d: Column) -> Column:
        at = n - d if backward else d - 1
        piece = F.floor(at / PIECE).cast("int")
        return F.get(F.when(piece < F.size(acc["pieces"]), F.get(acc["pieces"], piece)).otherwise(acc["last"]), at % PIECE)

    def step(acc: Column, i: Column) -> Column:
        known = F.transform(F.element_at("deps", i), lambda d: F.when((d > i) if backward else (d < i), fresh(acc, d)).otherwise(F.element_at(levels, d)))
        found = let(known, lambda k: F.when(~F.exists(k, lambda x: x.isNull()), 1 + F.coalesce(F.array_max(k), F.lit(0))))
        last = F.array_append(acc["last"], F.coalesce(F.element_at(levels, i), found))
        return let(last, lambda x: F.when(F.size(x) < PIECE, F.struct(acc["pieces"].alias("pieces"), x.alias("last"))).otherwise(F.struct(F.array_append(acc["pieces"], x).alias("pieces"), none.alias("last"))))

    order = F.sequence(n, F.lit(1), F.lit(-1)) if backward else F.sequence(F.lit(1), n)
    every = lambda acc: F.flatten(F.array_append(acc["pieces"], acc["last"]))
    start = F.struct(F.array().cast("array<array<int>>").alias("pieces"), none.alias("last"))
    return F.aggregate(order, start, step, lambda acc: F.reverse(every(acc)) if backward else every(acc))


def _swept(levels: Column, n_known: Column) -> Column:
    """(levels, n_known, more) after up to SWEEPS sweeps there and back; more: the last one has found some and not yet all."""

    def step(acc: Column, _: Column) -> Column:
        there = lambda back: _sweep(back, False)
        count = lambda x: F.size(F.filter(x, lambda y: y.isNotNull()))
        state = lambda x: let(count(x), lambda c: F.struct(x.alias("levels"), c.alias("n_known"), ((c > acc["n_known"]) & (c < F.size("deps"))).alias("more")))
        return F.when(acc["more"], let(let(_sweep(acc["levels"], True), there), state)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), F.struct(levels.alias("levels"), n_known.alias("n_known"), F.lit(True).alias("more")), step)


def rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, round) of the calls within a block; round is null on a cycle and behind it.

    edges: conv_id, call_id, position, needs, needs_position. A block is one row.
    """
    each = blocks(calls, edges)
    one = each.groupBy("conv_id", "place").agg(F.sort_array(F.collect_list(F.struct("at", "call_id", "deps"))).alias("c"))
    one = one.select("conv_id", "place", F.col("c.call_id").alias("ids"), F.col("c.deps").alias("deps"))
    left = one.withColumn("levels", F.transform("ids", lambda _: F.lit(None).cast("int"))).withColumn("n_known", F.lit(0))
    done = None
    while True:
        swept = written(left.withColumn("s", _swept(F.col("levels"), F.col("n_known"))).select("conv_id", "place", "ids", "deps", "s.*"), "swept-blocks")
        ended = swept.filter("not more").select("conv_id", "place", "ids", "levels")
        done = ended if done is None else done.unionByName(ended)
        left = swept.filter("more").drop("more")
        if left.isEmpty():
            return done.select("conv_id", "place", F.explode(F.arrays_zip("ids", "levels")).alias("c")).select("conv_id", F.col("c.ids").alias("call_id"), "place", F.col("c.levels").alias("round"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each identifier called.

    calls: conv_id, call_id, position, name, arguments (JSON), depends_on array<string>.
    results: conv_id, call_id, position, content. schemas: name, field, kind, required.
    Gives conv_id, call_id, position, name, n_repeats, depends_on (found ones, sorted), n_dangling,
    linked, valid, errors, place and round (with position the topological order), canonical_json.
    A position that is null counts as -1.
    """
    key = ["conv_id", "call_id"]
    first = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.coalesce(F.col("position").cast("long"), F.lit(-1)).alias("position"), "name", "arguments", "depends_on")
    known = first.filter("conv_id is not null and call_id is not null")
    known = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n_repeats"), F.min(F.struct("position", "name", "arguments", "depends_on")).alias("c")).select(*key, "n_repeats", "c.*")
    loose = first.filter("conv_id is null or call_id is null").select(*key, F.lit(1).cast("long").alias("n_repeats"), "position", "name", "arguments", "depends_on")
    answers = results.filter("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id")).agg(F.min(F.struct("position", "content")).alias("answer"))
    linked = known.hint("shuffle_hash").join(answers.hint("shuffle_hash"), key, "left")
    linked = linked.unionByName(loose.withColumn("answer", F.lit(None).cast(answers.schema["answer"].dataType)))

    wants = known.select(*key, "position", F.explode(F.array_distinct("depends_on")).alias("needs")).filter("needs is not null")
    places = known.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("needs_position"))
    edges = written(wants.hint("shuffle_hash").join(places, ["conv_id", "needs"]), "dependencies")
    found = edges.groupBy(*key).agg(F.sort_array(F.collect_list("needs")).alias("found"))
    order = rounds(known, edges).withColumn("in_block", F.lit(True))

    checked = argument_errors(linked, schemas)
    out = checked.join(found, key, "left").join(order, key, "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("found", F.coalesce("found", none)).withColumn("n_asked", F.size(F.array_distinct(F.filter(F.coalesce("depends_on", none), lambda x: x.isNotNull()))))
    null = F.lit("null")
    parts = {
        "arguments": F.coalesce(canonical(F.col("arguments")), null),
        "depends_on": F.to_json("found"),
        "id": F.coalesce(quoted(F.col("call_id")), null),
        "name": F.when(F.col("name").isNull(), null).otherwise(quoted(F.col("name"))),
        "result": F.when(F.col("answer.content").isNull(), null).otherwise(quoted(F.col("answer.content"))),
    }
    text = [x for i, (k, v) in enumerate(parts.items()) for x in (F.lit(("," if i else "{") + f'"{k}":'), v)]
    return out.select(
        *key, "position", "name", "n_repeats", F.col("found").alias("depends_on"), (F.col("n_asked") - F.size("found")).alias("n_dangling"),
        F.col("answer").isNotNull().alias("linked"), (F.size("errors") == 0).alias("valid"), "errors",
        F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.coalesce("place", "position")).alias("place"),
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), None).when(F.col("in_block"), F.col("round")).otherwise(0).alias("round"),
        F.concat(*text, F.lit("}")).alias("canonical_json"),
    )


#: A user turn of fewer characters waits for the next one, and a prompt of as many or more is too long for its size to be told.
SHORT, LONG = 120, 400


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: a user turn calls "reply", a system turn "configure", and an assistant turn is the result of the turn before it.

    A call needs the calls one and three turns before it; a short user turn also needs the user turn after
    the answer to it. A prompt that is missing leaves its arguments out, and one of LONG characters or more has a word as its size.
    """
    own = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
    back = lambda n: F.concat_ws(":", F.col("conv_id"), F.col("turn") - n)
    named = lambda name: F.concat(F.lit(f'"{name}":'), quoted(F.col("text")))
    user, size = F.col("role") == "user", F.length("text")
    told = F.concat(F.lit(',"size":'), F.when(size < LONG, size.cast("string")).otherwise(F.lit('"long"')))
    given = F.concat(F.lit(","), F.when(user, named("prompt")).otherwise(named("instructions")), told)
    calls = turns.filter("role in ('user', 'system')").select(
        "conv_id", own.alias("call_id"), F.col("turn").alias("position"), F.when(user, "reply").otherwise("configure").alias("name"),
        F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.coalesce(given, F.lit("")), F.lit("}")).alias("arguments"),
        F.array_compact(F.array(back(1), back(3), F.when(user & (size < SHORT), back(-2)))).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", back(1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


#: Arguments of the two tools that turns stand for.
TURN_TOOLS = [(tool, field, kind, True) for tool, text in (("reply", "prompt"), ("configure", "instructions")) for field, kind in ((text, "string"), ("size", "integer"), ("turn", "integer"))]


def op3_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame(TURN_TOOLS, "name string, field string, kind string, required boolean")
    linked = link_tool_calls(calls, results, schemas)
    return linked.select("conv_id", "call_id", "position", "name", F.concat_ws(",", "depends_on").alias("depends_on"), F.col("n_dangling").cast("long").alias("n_dangling"), "linked", "valid", F.concat_ws(",", "errors").alias("errors"), "place", "round", "canonical_json")


ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, length(text) AS size, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name
  FROM conversations WHERE role IN ('user', 'system')
), d AS (
  SELECT conv_id, turn, turn - 1 AS needs FROM c UNION ALL SELECT conv_id, turn, turn - 3 FROM c
  UNION ALL SELECT conv_id, turn, turn + 2 FROM c WHERE name = 'reply' AND size < {SHORT}
), x AS (
  SELECT d.conv_id, d.turn, d.needs, b.call_id FROM d LEFT JOIN c b ON b.conv_id = d.conv_id AND b.turn = d.needs
), e AS (
  SELECT conv_id, turn, string_agg(call_id, ',' ORDER BY call_id) AS deps, string_agg('"' || call_id || '"', ',' ORDER BY call_id) AS quoted, count(*) - count(call_id) AS n_dangling
  FROM x GROUP BY 1, 2
), f AS (SELECT conv_id, turn, needs FROM x WHERE call_id IS NOT NULL AND needs >= turn),
s AS (  -- a block begins where no dependency from before reaches
  SELECT DISTINCT conv_id, turn AS place FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.conv_id = f.conv_id AND o.turn < f.turn AND o.needs >= f.turn)
), b AS (
  SELECT c.conv_id, c.turn, max(s.place) AS place FROM c JOIN s ON s.conv_id = c.conv_id AND s.place <= c.turn
  WHERE EXISTS (SELECT 1 FROM f WHERE f.conv_id = c.conv_id AND f.turn <= c.turn AND f.needs >= c.turn) GROUP BY 1, 2
), g AS (
  SELECT x.conv_id, x.turn, x.needs FROM x JOIN b p ON p.conv_id = x.conv_id AND p.turn = x.turn JOIN b q ON q.conv_id = x.conv_id AND q.turn = x.needs AND q.place = p.place
  WHERE x.call_id IS NOT NULL
), h(conv_id, turn, round) AS (
  SELECT conv_id, turn, 1 FROM b UNION SELECT g.conv_id, g.turn, h.round + 1 FROM g JOIN h ON h.conv_id = g.conv_id AND h.turn = g.needs
), l AS (SELECT conv_id, turn, max(round) AS round FROM h GROUP BY 1, 2)
SELECT c.conv_id, c.call_id, c.turn AS position, c.name, coalesce(e.deps, '') AS depends_on, e.n_dangling,
  r.conv_id IS NOT NULL AS linked, c.text IS NOT NULL AND c.size < {LONG} AS valid,
  CASE WHEN c.text IS NOT NULL THEN CASE WHEN c.size < {LONG} THEN '' ELSE 'mistyped size' END WHEN c.name = 'reply' THEN 'missing prompt,missing size' ELSE 'missing instructions,missing size' END AS errors,
  coalesce(b.place, c.turn) AS place, coalesce(l.round, 0)::INTEGER AS round,
  '{{"arguments":{{' || CASE WHEN c.text IS NULL THEN '' ELSE CASE c.name WHEN 'reply' THEN '"prompt":' ELSE '"instructions":' END || to_json(c.text)::VARCHAR || ',"size":' || CASE WHEN c.size < {LONG} THEN c.size::VARCHAR ELSE '"long"' END || ',' END || '"turn":' || c.turn
  || '}},"depends_on":[' || coalesce(e.quoted, '') || '],"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}}' AS canonical_json
FROM c LEFT JOIN e USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn)
LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'
"""
