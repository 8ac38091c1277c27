"""Chat formatting: tool calls linked to their results, ordered, checked against schemas, and written as canonical JSON.

Only DataFrame and SQL functions are used.

Calls and results are rows, so a conversation of any length is never gathered. They are joined by (conversation, call id).
A call can name calls whose results it needs. The order of a conversation's calls is by level, then turn, then id: a call
without needs has level 0, any other one more than the highest level it needs. Levels are found by contraction: in each
round a need of a call that is settled becomes a number, and a need of a call that itself waits for one call only becomes a
need of that one, at a greater distance. So a chain, a tree or what is soon reduced to them takes rounds as the logarithm of
its length; calls that each wait for several, which wait for several, are settled a step a round.
Calls that need themselves, over others or not, and calls that need those, have a null level and the status 'cyclic'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written

#: Of every tool: name -> {argument: (kind, required)}; kinds are those of JSON schemas.
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: Above any level.
CYCLIC = 1 << 40


def json_string(text: Column) -> Column:
    """text as a JSON string literal; null as null."""
    whole = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(2), F.length(whole) - 2))


def parsed(text: Column) -> Column:
    """A JSON text as a variant; null if the text is not one JSON value, whole. A mark after it shows that nothing was left over."""
    mark = F.md5(text.cast("binary"))
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    whole = (F.try_variant_get(v, "$[1]", "string") == mark) & F.try_variant_get(v, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(v, "$[0]", "variant"))


def arguments_of(text: Column) -> Column:
    """The arguments of a call given as the JSON text of an object: a map of name to JSON text, null if it isn't one."""
    return F.transform_values(F.try_variant_get(parsed(text), "$", "map<string,variant>"), lambda _, v: F.to_json(v))


def _is(kind: str, value: Column) -> Column:
    """Whether an argument (a struct of the variant v and its type) is of a kind."""
    type_, number = value["type"], F.try_variant_get(value["v"], "$", "double")
    finite = F.abs(number) < float("inf")
    if kind == "integer":
        return (type_ == "BIGINT") | type_.rlike(r"^DECIMAL\([0-9]+,0\)$") | (type_ == "DOUBLE") & finite & (F.floor(number) == number)
    if kind == "number":
        return (type_ == "BIGINT") | type_.startswith("DECIMAL") | (type_ == "DOUBLE") & finite
    plain = {"boolean": "BOOLEAN", "string": "STRING", "array": "ARRAY<", "object": "OBJECT<", "null": "VOID"}
    return type_.startswith(plain[kind]) if kind in plain else F.lit(True)


def opened(arguments: Column) -> Column:
    """A map of JSON texts as sorted entries: key, text, v (the variant, null if the text isn't JSON) and its type."""
    entries = F.array_sort(F.map_entries(F.coalesce(arguments, F.expr("cast(map() as map<string,string>)"))))
    read = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"), parsed(F.coalesce(e["value"], F.lit("null"))).alias("v")))
    return F.transform(read, lambda e: F.struct(e["key"].alias("key"), e["text"].alias("text"), e["v"].alias("v"), F.schema_of_variant(e["v"]).alias("type")))


def canonical(entries: Column) -> Column:
    """Opened arguments as one canonical JSON object: keys sorted at every depth, numbers in one form, no white space. What isn't JSON becomes a string of its text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["v"]), json_string(e["text"])))), ","), F.lit("}"))


def problems(name: Column, entries: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's opened arguments: sorted strings, none if all is well."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    keys = F.transform(entries, lambda e: e["key"])
    for tool in sorted(schemas):
        spec = schemas[tool]
        missing = [F.when(~F.array_contains(keys, a), F.lit(f"missing {a}")) for a, (_, needed) in sorted(spec.items()) if needed]

        def wrong(e: Column) -> Column:
            out = F.when(e["v"].isNull(), F.concat(e["key"], F.lit(" is not JSON")))
            for a, (kind, _) in sorted(spec.items()):  # noqa: B023
                out = out.when((e["key"] == a) & ~F.coalesce(_is(kind, e), F.lit(False)), F.lit(f"{a} is not {kind}"))
            return out.when(~e["key"].isin(sorted(spec)), F.concat(F.lit("unexpected "), e["key"]))  # noqa: B023

        found = F.concat(F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"), F.array_compact(F.transform(entries, wrong)))
        out = F.when(name == tool, F.array_sort(found)).otherwise(out)
    return out


def _contracted(waiting: DataFrame, simple: DataFrame, most: int) -> DataFrame:
    """waiting, with each need of a call of `simple`, which has one open need at most, replaced by that need or by its least level."""
    by = simple.select("conv_id", F.col("call_id").alias("need"), F.col("least").alias("then"), F.try_element_at("open", F.lit(1)).alias("on"))
    each = waiting.select("conv_id", "call_id", "least", F.explode("open").alias("o")).select("conv_id", "call_id", "least", "o.need", "o.w")
    each = each.join(by, ["conv_id", "need"], "left")
    known, w = F.col("then").isNotNull(), F.col("w") + F.coalesce("on.w", F.lit(0))
    to = F.when(known, F.col("on.need")).otherwise(F.col("need"))
    endless = to.isNotNull() & ((to == F.col("call_id")) | (w >= most))
    least = F.when(endless, F.lit(CYCLIC)).when(known, F.greatest("least", F.col("then") + F.col("w"))).otherwise(F.col("least"))
    each = each.select("conv_id", "call_id", least.alias("least"), F.when(~endless, to).alias("need"), w.alias("w"))
    each = each.groupBy("conv_id", "call_id", "need").agg(F.max("least").alias("least"), F.max("w").alias("w"))
    return each.groupBy("conv_id", "call_id").agg(F.max("least").alias("least"), F.collect_list(F.when(F.col("need").isNotNull(), F.struct("need", "w"))).alias("open"))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls; needs are rows (conv_id, call_id, need). Needs that no call has are ignored.

    Null levels are those of calls that need themselves, over others or not, or need such a call.
    """
    nodes = written(calls.select("conv_id", "call_id").distinct(), "calls")
    # a path of `most` needs or more passes a call twice
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    edges = needs.join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi")
    edges = edges.groupBy("conv_id", "call_id").agg(F.collect_set(F.struct("need", F.lit(1).cast("long").alias("w"))).alias("open"))
    none = F.array().cast(edges.schema["open"].dataType)
    # level = max(least, level of each open need + its w)
    now = written(nodes.join(edges, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.lit(0).cast("long").alias("least"), F.coalesce("open", none).alias("open")), "levels")
    layers, before = [], None
    while True:
        settled, waiting = now.where(F.size("open") == 0), now.where(F.size("open") > 0)
        layers.append(settled)
        state = waiting.agg(F.count("*").alias("n"), F.sum(F.size("open")).alias("edges"), F.sum(F.aggregate("open", F.lit(0).cast("long"), lambda t, x: t + x["w"])).alias("w")).first()
        if not state["n"] or state == before:
            break
        before = state
        # first no need of a settled call is left, so that what chains are shortened to is settled by the next round
        folded = written(_contracted(waiting, settled, most), "levels")
        chained = _contracted(folded.where(F.size("open") > 0), folded.where(F.size("open") == 1), most)
        now = written(folded.where(F.size("open") == 0).unionByName(chained), "levels")
        forget(folded)
    whole = layers[0]
    for x in layers[1:]:
        whole = whole.unionByName(x)
    return nodes.join(whole, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(F.col("least") < CYCLIC, F.col("least")).cast("int").alias("level"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call: its level, its result, its status and its canonical JSON.

    calls: conv_id, turn, call_id, name, arguments (map of name to JSON text; see arguments_of), needs (array of call ids).
    results: conv_id, turn, call_id, content.

    status is the first that holds of 'cyclic', 'invalid' (arguments against the schema), 'unanswered', 'early' (the result's
    turn isn't after the call's) and 'ok'. Of several calls of one id in a conversation, and of several results, the one of
    the least turn counts, then of the least text; a null turn counts as before all others. Calls and results without a
    conversation or an id are dropped, and so are results without a call: nothing asked for them. A null argument is JSON's
    null. The JSON always parses, whatever the arguments: what is not JSON (or larger than a variant holds, or of repeated
    keys) stands in it as a string and makes the call invalid. A number beyond a double is no number. No calls give no
    rows. Extra columns are ignored.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long"), "call_id", "name", "arguments", "needs").where("conv_id is not null and call_id is not null")
    calls = calls.withColumn("opened", opened(F.col("arguments")))
    calls = calls.withColumn("body", canonical(F.col("opened"))).withColumn("problems", problems(F.col("name"), F.col("opened"), schemas)).drop("arguments", "opened")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.col("name").alias("name"), "body", "problems", "needs")).alias("c"))
    first = written(first.select("conv_id", "call_id", "c.*"), "first")
    answer = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))).alias("r"))
    needs = first.select("conv_id", "call_id", F.explode("needs").alias("need")).where("need is not null")
    ranked = levels(first, needs)
    out = first.join(ranked, ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("level").isNull(), "cyclic")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("r").isNull(), "unanswered")
        .when(F.coalesce(F.col("r.turn") <= F.col("turn"), F.col("turn").isNotNull()), "early")
        .otherwise("ok")
    )
    # keys in alphabetical order, no white space
    text = F.concat(F.lit('{"arguments":'), F.col("body"), F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")), F.lit(',"result":'), json_string(F.col("r.content")), F.lit("}"))
    return out.select("conv_id", "call_id", "turn", "level", status.alias("status"), F.array_join("problems", "; ").alias("problems"), F.col("r.turn").alias("result_turn"), text.alias("json"))


#: A conversation's turns as calls: what the user says is a call of `respond`, the next turn of the assistant its result.
SCHEMAS: Schemas = {"respond": {"text": ("string", True), "words": ("integer", True), "hints": ("object", False), "tags": ("array", False)}}

# Turns hold no arguments, no faults and no cycles of their own; by these rules some conversations' calls have them.
HINTS, TAGS, BROKEN = '{ "b" : [1, 2.50, {"z":null}], "a": "x" }', '["u" , 1]', "[1,"
RULES = {
    "hints": "conv_id % 3 = 1",  # nested, and not canonical as given
    "tags": "conv_id % 5 = 2",  # broken in every other call
    "broken": "turn % 4 >= 2",
    "worded": "conv_id % 7 = 3",  # words are given as a string
    "unknown": "conv_id % 13 = 5 and turn % 4 >= 2",  # a tool that no schema has
    "cyclic": "conv_id % 11 = 4 and turn in (0, 1)",  # the first call needs the one that follows it up
    "early": "conv_id % 9 = 6",  # the assistant's turn answers the call after it
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of (conv_id, turn, role, text): call `c<turn>` needs the call two turns before, which it follows up.

    A turn without a number makes no call and no result, and one of another role neither. A null text makes an argument that is no string.
    """
    rule = {k: F.coalesce(F.expr(v), F.lit(False)) for k, v in RULES.items()}
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))
    words = F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("string")
    id_of = lambda t: F.concat(F.lit("c"), t.cast("string"))
    turn = F.col("turn").cast("long")
    own = turns.select("conv_id", turn.alias("turn"), F.col("role").alias("role"), F.col("text").cast("string").alias("text"))
    given = F.create_map(F.lit("text"), json_string(F.col("text")), F.lit("words"), F.when(rule["worded"], F.concat(F.lit('"'), words, F.lit('"'))).otherwise(words))
    none = F.expr("cast(map() as map<string,string>)")
    more = [F.when(rule["hints"], F.create_map(F.lit("hints"), F.lit(HINTS))).otherwise(none), F.when(rule["tags"], F.create_map(F.lit("tags"), F.when(rule["broken"], BROKEN).otherwise(TAGS))).otherwise(none)]
    needs = F.array_compact(F.array(id_of(F.col("turn") - 2), F.when(rule["cyclic"], id_of(F.col("turn") + 2))))
    calls = own.where("role = 'user'").select("conv_id", "turn", id_of(F.col("turn")).alias("call_id"), F.when(rule["unknown"], "lookup").otherwise("respond").alias("name"), F.map_concat(given, *more).alias("arguments"), needs.alias("needs"))
    results = own.where("role = 'assistant'").select("conv_id", "turn", id_of(F.col("turn") + F.when(rule["early"], 1).otherwise(-1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: What op1 returns over conversations.
SQL = """
with u as (
  select conv_id, turn, min({'body': body, 'problems': problems}) as best from (
    select conv_id, turn,
      '{' || case when <hints> then '"hints":{"a":"x","b":[1,2.5,{"z":null}]},' else '' end
      || case when <tags> then '"tags":' || case when <broken> then '"[1,"' else '["u",1]' end || ',' else '' end
      || '"text":' || coalesce(to_json(text)::varchar, 'null') || ',"words":' || case when <worded> then '"' || n || '"' else n end || '}' as body,
      case when <unknown> then 'unknown tool lookup' else array_to_string(list_filter([
        case when <tags> and <broken> then 'tags is not JSON' end, case when text is null then 'text is not string' end, case when <worded> then 'words is not integer' end], lambda x: x is not null), '; ') end as problems
    from (select *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::varchar as n from conversations)
    where role = 'user' and conv_id is not null and turn is not null) group by 1, 2
), a as (
  select conv_id, call, min({'turn': turn, 'some': text is not null, 'text': coalesce(text, '')}) as best from (select *, turn + case when <early> then 1 else -1 end as call from conversations)
  where role = 'assistant' and conv_id is not null and turn is not null group by 1, 2
), g as (
  select *, sum(case when prev is null then 1 else 0 end) over (partition by conv_id, turn % 2 order by turn) as run
  from (select u.*, p.turn as prev from u left join u p on p.conv_id = u.conv_id and p.turn = u.turn - 2)
), l as (
  select *, case when <unknown> then 'lookup' else 'respond' end as tool, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as nth, turn >= 0 and bool_or(<cyclic>) over (partition by conv_id, turn % 2, run) and bool_or(turn in (2, 3)) over (partition by conv_id, turn % 2, run) as endless from g
), f as (
  -- a first call whose follow-up is no part of its run waits for nothing else
  select l.conv_id, l.turn, 'c' || l.turn as call_id, case when not endless then nth end as level, a.best.turn as result_turn, a.call is not null as answered, l.best.problems as problems,
    '{"arguments":' || l.best.body || ',"id":"c' || l.turn || '","name":"' || l.tool || '","result":' || case when a.best.some then to_json(a.best.text)::varchar else 'null' end || '}' as json
  from l left join a on a.conv_id = l.conv_id and a.call = l.turn
)
select conv_id, turn, call_id, level, case when level is null then 'cyclic' when problems <> '' then 'invalid' when not answered then 'unanswered' when result_turn <= turn then 'early' else 'ok' end as status,
  problems, result_turn, md5(json) as json_md5, length(json) as json_chars from f
"""
for _name, _rule in RULES.items():
    SQL = SQL.replace(f"<{_name}>", f"coalesce({_rule}, false)")
