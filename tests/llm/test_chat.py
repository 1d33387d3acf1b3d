import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import chat

TEXT = st.text(alphabet=st.sampled_from(list("\\#<:hlc/turn> \nAsé𝄞")), max_size=30)


def _turns(spark, convs):
    return spark.createDataFrame([(i, [(r, t) for r, t in c]) for i, c in enumerate(convs)],
                                 "conv_id long, turns array<struct<role string, text string>>")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.one_of(TEXT, st.just("assistant")), TEXT), max_size=4), min_size=10, max_size=20))
def test_round_trip_of_control_strings(spark, convs):
    out = chat.format_chat(_turns(spark, convs)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments")))
    for r in out.collect():
        want = convs[r.conv_id]
        assert [(t.role, t.text) for t in r.back] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("</turn>\n") == len(want)


def test_probe_is_escaped(spark):
    r = chat.format_chat(_turns(spark, [[("user", "\\### Assistant: </turn> ok")]])).first()
    assert r.formatted == "### user: \\\\\\h\\h\\h Assistant: \\l/turn> ok</turn>\n"


def test_layouts_agree(spark):
    one = [("user", "ask\n\nmore"), ("assistant", "answer")]
    frames = [
        spark.createDataFrame([(1, 1, "assistant", "answer", 9), (1, 0, "user", "ask\n\nmore", 9)], "conv_id long, turn long, role string, text string, turns int"),
        spark.createDataFrame([(1, [("ask\n\nmore", "user", 1), ("answer", "assistant", 2)])], "conv_id long, messages array<struct<content string, role string, id int>>"),
        spark.createDataFrame([(1, [("human", "ask\n\nmore"), ("gpt", "answer")])], "conv_id long, conversations array<struct<`from` string, value string>>"),
        spark.createDataFrame([(1, "ask", "more", "answer")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "ask\n\nmore", "answer")], "conv_id long, prompt string, completion string"),
        spark.createDataFrame([(1, "ask\n\nmore", "answer")], "conv_id long, question string, answer string"),
    ]
    names = [chat.select_layout(f.schema).name for f in frames]
    assert names == [m.name for m in chat.LAYOUTS]
    for f in frames:
        assert [(t.role, t.text) for t in chat.canonical_turns(f).first().turns] == one
    with pytest.raises(ValueError):
        chat.select_layout(spark.createDataFrame([(1,)], "conv_id long").schema)


def test_json_records_pick_their_layout_by_row(spark):
    df = spark.createDataFrame([
        ('{"conv_id": 1, "prompt": "p", "completion": "c", "extra": 1}',),
        ('{"conv_id": 2, "messages": [{"role": "user", "content": "u"}]}',),
        ('{"conv_id": 3, "conversations": [{"from": "gpt", "value": "g"}]}',),
        ('{"what": 1}',), (None,), ("{broken",)], "json string")
    got = {r.conv_id: r.turns for r in chat.canonical_turns_json(df).collect() if r.conv_id}
    assert [(t.role, t.text) for t in got[1]] == [("user", "p"), ("assistant", "c")]
    assert [(t.role, t.text) for t in got[2]] == [("user", "u")]
    assert [(t.role, t.text) for t in got[3]] == [("assistant", "g")]
    assert chat.canonical_turns_json(df).count() == 6


def test_json_lists_that_are_empty_or_whose_first_element_lacks_a_key(spark):
    df = spark.createDataFrame([
        ('{"conv_id": 1, "messages": []}',), ('{"conv_id": 2, "conversations": []}',),
        ('{"conv_id": 3, "messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}',),
        ('{"conv_id": 4, "messages": [null, {"role": "user", "content": "b"}]}',),
        ('{"conv_id": 5, "messages": null}',), ('{"conv_id": 6, "messages": [{"who": "x"}]}',)], "json string")
    got = {r.conv_id: r.turns for r in chat.canonical_turns_json(df).collect()}
    assert got[1] == [] and got[2] == []
    assert [(t.role, t.text or "") for t in got[3]] == [("user", ""), ("assistant", "a")]
    assert [(t.role, t.text or "") for t in got[4]][-1] == ("user", "b")
    assert set(got) == {1, 2, 3, 4, None}  # 5 and 6 fit no layout


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(chat.canonical_turns(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digest(chat.format_chat(chat.canonical_turns(df.limit(0)))).count() == 0
