"""Arguments as JSON, odd turns, and the query against SQL where calls are broken, cyclic, early and repeated."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from venation.llm import chat

CALLS = "conv_id string, turn int, call_id string, name string, arguments map<string,string>, needs array<string>, level int, json string"
SCHEMA = {"f": {"s": ("string", False), "i": ("integer", False), "n": ("number", False), "b": ("boolean", False), "a": ("array", False), "o": ("object", False), "z": ("null", False)}}


@pytest.mark.parametrize("name, good, bad", [
    ("s", ['"x"', '"\\u00e9\\/"', '""'], ["not json", "1", '"open', "null", '"a" "b"']),
    ("i", ["1", "-0", "1.0", "1e2", "12345678901234567890123"], ["1.5", "01", '"1"', "1 2", "1e400", "NaN"]),
    ("n", ["1", "0.5", "1e-3"], ["true", "1e999", ".5", ""]),
    ("b", ["true", " false "], ["True", "0", "tru"]),
    ("a", ["[]", "[1, [2]]", '["["]'], ["[1,", "{}", "[1]]", "[1],[2]"]),
    ("o", ["{}", '{"b":1,"a":{"d":1.50,"c":2}}'], ["[]", '{"a":1,"a":2}', '{"a":}', "{'a':1}"]),
    ("z", ["null"], ["nil", "0"]),
])
def test_arguments_are_parsed(spark, name, good, bad):
    rows = [("c", i, f"c{i:02}", "f", {name: x}, None, 0, "") for i, x in enumerate(good + bad)]
    got = chat.linked_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], "conv_id string, turn int, call_id string, content string"), SCHEMA).orderBy("call_id").collect()
    assert [r["status"] for r in got] == ["unanswered"] * len(good) + ["invalid"] * len(bad)
    for r, x in zip(got, good + bad):
        found = json.loads(r["json"])["arguments"][name]
        try:
            assert found == json.loads(x) or r["problems"]
        except json.JSONDecodeError:
            assert found == x and r["problems"] == f"{name} is not JSON"


def test_canonical_json_is_one_text_for_one_value(spark):
    same = ['{ "b":1, "a": {"y":[1,2.50,{"q":null,"p":true}], "x":"\\u0041"} }', '{"a":{"x":"A","y":[1.0,2.5,{"p":true,"q":null}]},"b":1}']
    got = spark.createDataFrame([({"k": x, "j": None},) for x in same], "m map<string,string>").select(chat.canonical(chat.opened(F.col("m"))).alias("c")).collect()
    assert {r["c"] for r in got} == {'{"j":null,"k":{"a":{"x":"A","y":[1,2.5,{"p":true,"q":null}]},"b":1}}'}
    args = spark.createDataFrame([('{"b": [1, 2], "a": "x"}',), ("[1]",), ("{",), (None,)], "t string").select(chat.arguments_of(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in args] == [{"a": '"x"', "b": "[1,2]"}, None, None, None]


def test_odd_turns_against_sql(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in (1, 4, 5, 6, 10, 15, 33) for t in range(9) if (c, t) != (15, 2)]
    rows += [(1, 2, "user", "text 1 2"), (1, 2, "user", "a text"), (1, 3, "assistant", None), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "user", ' \t\x01\x7f"\\/\n é 漢 😀'), (4, None, "user", "t"), (None, 0, "user", "t"), (5, 0, None, "t"), (7, 5, "assistant", "stray"), (8, 0, "user", "x " * 60000), (26, 0, "user", ""), (37, 1, "user", "u"), (37, 3, "user", "v"), (48, 0, "user", "w"), (48, 4, "user", "w")]
    turns = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, level int, status string")
    out = chat.linked_calls(*chat.calls_of(turns), chat.SCHEMAS)
    got = out.select("conv_id", "turn", "call_id", "level", "status", "problems", "result_turn", F.md5(F.col("json").cast("binary")).alias("json_md5"), F.length("json").alias("json_chars")).collect()
    db = duckdb.connect()
    db.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.sql(chat.SQL).fetchall()))
    assert {r["status"] for r in got} == {"ok", "invalid", "unanswered", "cyclic", "early"}
    for r in out.collect():
        json.loads(r["json"])
    assert chat.linked_calls(*chat.calls_of(turns.limit(0)), chat.SCHEMAS).count() == 0
