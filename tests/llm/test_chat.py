import json

from symlattice.llm import chat
from symlattice.llm.queries import op7_chat
from symlattice.session import table

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level string"


def test_links_levels_and_checks(spark):
    good = '{"limit": 2, "query": "é\\u00e9"}'
    calls = [
        (1, 0, "a", "search", good, [], "x"), (1, 1, "b", "search", good, ["a", "zz"], "x"), (1, 2, "c", "search", '{"query": 1, "limit": true, "more": 0}', ["a", "b"], "x"), (1, 1, "b", "search", good, ["a", "zz"], "x"),
        (2, 0, "x", "search", "[1]", ["y"], "x"), (2, 1, "y", "search", "not json", ["x"], "x"), (2, 2, "z", "none", None, ["y", None], "x"), (2, 3, "s", "search", None, ["s"], "x"), (None, 0, "a", "search", good, [], "x"), (3, 0, None, "search", good, [], "x"), (4, 0, "a", "summarise", '{"words": NaN, "text": ""}', None, "x"), (5, 0, "a", "summarise", json.dumps({"words": 9, "text": "w " * 200_000}), [], "x"),
    ]
    results = [(1, 5, "a", "late"), (1, 3, "a", "b"), (1, 3, "a", "a"), (1, 9, "c", None), (2, 1, "nobody", "x"), (None, 1, "a", "x")]
    df = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id long, turn long, call_id string, text string"), chat.SCHEMAS)
    got = {}
    for r in df.collect():
        got.setdefault((r["conv_id"], r["call_id"]), []).append(r)
    assert {k: v[0]["level"] for k, v in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "x"): None, (2, "y"): None, (2, "z"): None, (2, "s"): None, (4, "a"): 0, (5, "a"): 0}
    assert len(got[1, "b"]) == 2
    assert {k for k, v in got.items() if v[0]["valid"]} == {(1, "a"), (1, "b"), (5, "a")}
    assert got[1, "a"][0]["message"] == '{"after":[],"call":{"arguments":{"limit":2,"query":"éé"},"id":"a","name":"search"},"result":"a"}'
    assert got[1, "c"][0]["problems"] == ["$.more: unknown", "$.limit: not of type integer", "$.query: not of type string"]
    assert [got[1, k][0]["status"] for k in "abc"] == ["linked", "pending", "linked"]


def test_schema():
    s = {"type": "array", "items": {"type": "integer", "minimum": 0, "enum": [1, 2, -1]}}
    assert chat.problems([1, 2], s) == [] and chat.problems([3, -1, 1.5], s) == ["$[0]: not among the allowed values", "$[1]: below 0", "$[2]: not of type integer"]
    assert chat.problems({"a": 1}, {"required": ["b"]}) == ["$.b: missing"] and chat.problems(True, {"type": "number"}) and not chat.problems(True, {"type": "boolean"})


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]): r for r in table(spark, sf, "conversations").collect()}
    got = op7_chat(spark, sf).collect()
    mine = {k for k, r in turns.items() if r["role"] == "assistant"}
    assert {(r["conv_id"], r["turn"]) for r in got} == mine and len(got) == len(mine)

    def level(conv, turn):
        return level(conv, turn // 2) + 1 if turn > 1 and (conv, turn // 2) in mine else 0

    for r in got:
        text = turns[r["conv_id"], r["turn"]]["text"] or ""
        answer = turns.get((r["conv_id"], r["turn"] + 1))
        answer = answer if answer and answer["role"] != "assistant" else None
        name = "summarise" if len(text) % 2 else "search"
        arguments = {"query": text, "limit": r["turn"] + 1} if name == "search" else {"words": len(text.split(" ")), "text": text}
        valid = arguments["limit"] <= 6 and len(text) <= 4000 if name == "search" else arguments["words"] >= 5
        assert (r["name"], r["valid"], r["status"], r["level"]) == (name, valid, "linked" if answer else "pending", level(r["conv_id"], r["turn"]))
        message = json.loads(r["message"])
        assert json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]
        assert message.get("result") == (answer["text"] if answer else None)
        if valid:
            assert message["call"]["arguments"] == arguments


def test_empty(spark):
    assert chat.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], "conv_id long, turn long, call_id string, text string"), {}).count() == 0


def test_values_that_cannot_be_written(spark):
    """Lone surrogates and numbers beyond doubles are invalid; pairs of surrogates are not."""
    texts = ['{"query": "\\ud800", "limit": 2}', '{"query": "q", "limit": 1e999}', '{"query": "\\ud83d\\ude00", "limit": 2}', '{"\\udfff": 1}', '{"query": NaN}']
    calls = spark.createDataFrame([(1, k, f"c{k}", "search", t, []) for k, t in enumerate(texts)], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, text string")
    got = {r["turn"]: r for r in chat.link(calls, results, chat.SCHEMAS).collect()}
    assert [got[k]["valid"] for k in range(5)] == [False, False, True, False, False] and got[0]["problems"] == ["$: not JSON"]
