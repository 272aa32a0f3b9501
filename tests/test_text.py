"""Hand-made tables for the scalar text and prompt functions (whitespace zoo, JSON zoo, fences,
stop strings, templates)."""


import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.fixed import INSTRUCTION_PREFIX, PLACEHOLDER
from quarry.operators import prompt as P

WS_ZOO = ["", " ", "a", "  a b  ", "\t\n a \r\n", "\x0b\x0ca\x1c\x1d\x1e\x1f", "\x85a\xa0", " a\u3000",
          "\u2003a\u2003", "\u2028a\u2029", "a\u200b", " x\u180e", "a\n", "\n\na\n\nb\n\n", "\u1680\u202fa\u205f"]


def _one_col(spark, values, name="s"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_py_strip_matches_python(spark):
    df = _one_col(spark, WS_ZOO)
    got = {r.i: r.o for r in df.select("i", T.py_strip("s").alias("o")).collect()}
    assert got == {i: v.strip() for i, v in enumerate(WS_ZOO)}


def test_split_and_remove_whitespace_match_python(spark):
    df = _one_col(spark, WS_ZOO)
    rows = df.select("i", T.split_whitespace("s").alias("t"), T.remove_whitespace("s").alias("r")).collect()
    for r in rows:
        assert r.t == WS_ZOO[r.i].split()
        assert r.r == "".join(WS_ZOO[r.i].split())


def test_first_piece_and_last_segment(spark):
    vals = ["abc", "a```b```c", "```lead", "", "x/y/z", "noslash"]
    df = _one_col(spark, vals)
    rows = df.select("i", T.first_piece("s", "```").alias("f"), T.last_segment("s").alias("l")).collect()
    for r in rows:
        assert r.f == vals[r.i].split("```")[0]
        assert r.l == vals[r.i].split("/")[-1]


def test_fence_cut_cases(spark):
    vals = ["  code  ", "code\n```\nmore", "```\nlead", "", "a\n\t```", "no fence at all\n"]
    df = _one_col(spark, vals)
    got = {r.i: r.o for r in df.select("i", T.fence_cut("s").alias("o")).collect()}
    assert got == {i: v.split("```")[0].strip() for i, v in enumerate(vals)}


# expected values written out: (input_output, its function name), (solutions, the first one)
NAMES = [('{"fn_name":"f","inputs":[]}', "f"), ('{"inputs":[]}', None), ("", None), ("{bad", None), ('{"fn_name":""}', None),
         ('{"fn_name":"f"} junk', None), ('{"fn_name":false}', None), ('{"fn_name":0}', None), ('{"fn_name":0.0}', None),
         ('{"fn_name":[]}', None), ('{"fn_name":{}}', None), ('{"fn_name":null}', None), ('{"fn_name":"false"}', "false"),
         ('{"fn_name":"f"}] {', None), ('["fn_name"]', None), (None, None),
         ('{"fn_name":"a","fn_name":"b"}', "b"), ('{"fn_name":"a","fn_name":0}', None), ('{"fn_name":{"k":[1,2]}}', '{"k":[1,2]}'),
         ('{"fn_name":"\\ud800"}', "?"), ("[" * 100_000, None)]
FIRSTS = [('["s1","s2"]', "s1"), ('["only"]', "only"), ("", ""), ("bad[", ""), ('["a"] junk', ""), ('["a"], ["b"]', ""),
          (' ["a"]\n', "a"), ('{"a":1}', ""), ("[]", None), (None, ""), ('[{"a":1,"a":2}]', '{"a":2}'), ("[null]", None), ("[3]", "3")]


def test_json_zoo(spark):
    names = {r.i: r.o for r in _one_col(spark, [x for x, _ in NAMES]).select("i", T.json_truthy_field("s", "fn_name").alias("o")).collect()}
    assert [names[i] for i in range(len(NAMES))] == [want for _, want in NAMES]
    firsts = {r.i: r.o for r in _one_col(spark, [x for x, _ in FIRSTS]).select("i", T.json_first_element("s").alias("o")).collect()}
    assert [firsts[i] for i in range(len(FIRSTS))] == [want for _, want in FIRSTS]


def test_strip_is_linear_in_inner_blanks(spark):
    import time
    text = "a" + " " * 400_000 + "b" + " " * 10
    df = _one_col(spark, [text])
    df.select(T.py_strip("s")).collect()
    t = time.perf_counter()
    assert df.select(T.py_strip("s").alias("o")).first().o == text.strip()
    assert time.perf_counter() - t < 20  # a quadratic pattern takes minutes


def test_a_turn_without_content_raises(spark):
    df = spark.createDataFrame([([("user", "q"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="no content"):
        df.select(T.render_messages("m")).collect()


def test_json_first_element_empty_array(spark):
    df = _one_col(spark, ["[]"])
    assert df.select(T.json_first_element("s").alias("o")).first().o is None
    with pytest.raises(Exception):
        df.select(T.json_first_element("s", strict=True)).collect()


def test_strict_lookup_raises_for_unknown(spark):
    df = _one_col(spark, ["conala", "nope"])
    ok = df.where("i = 0").select(P.prefix_for(F.col("s")).alias("p")).first().p
    assert ok == INSTRUCTION_PREFIX["conala"]
    with pytest.raises(Exception, match="no entry for key"):
        df.select(P.prefix_for(F.col("s"))).collect()


def test_stop_truncate(spark):
    stops = ["<|end|>", "\n```\n"]
    vals = ["abc", "ab<|end|>cd", "ab\n```\ncd<|end|>", "<|end|>", "x\n```\n"]
    df = _one_col(spark, vals)
    rows = df.select("i", T.stop_truncate("s", stops).alias("t"), T.contains_any("s", stops).alias("c"),
                     T.earliest_stop(F.col("s"), stops)["stop"].alias("w")).collect()
    for r in rows:
        v = vals[r.i]
        hits = [(v.find(s), k, s) for k, s in enumerate(stops) if s in v]
        if hits:
            pos, _, s = min(hits)
            assert r.t == v[:pos] and r.w == s and r.c
        else:
            assert r.t == v and r.w is None and not r.c


def test_templated_turns_and_placeholder(spark):
    df = spark.createDataFrame([(1, "  do x \n", None), (2, "q", "  ans\n")], "i int, instr string, resp string")
    out = {r.i: r.messages for r in P.templated_messages(df, "instr", "resp", "conala").collect()}
    pre = INSTRUCTION_PREFIX["conala"]
    assert out[1][0].content == f"{pre}\n```\ndo x\n```"
    assert out[1][1].content == f"```python\n{PLACEHOLDER}\n```"
    assert out[2][1].content == "```python\nans\n```"
    cut = df.transform(lambda d: P.templated_messages(d, "instr", "resp", "conala")) \
        .select("i", T.render_cut("messages").alias("p")).collect()
    by = {r.i: r.p for r in cut}
    assert by[1].endswith("<|im_start|>assistant\n```python\n")
    assert PLACEHOLDER not in by[2]


def test_prompt_with_tests_and_io_mode(spark):
    df = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "u", [])], "i int, text string, tests array<string>")
    got = {r.i: r.p for r in df.select("i", P.prompt_with_tests("text", "tests").alias("p")).collect()}
    assert got == {1: "t Your code should pass these tests:\na\nb", 2: "u Your code should pass these tests:"}
    q = spark.createDataFrame([("Q", "def f():", '{"fn_name":"f"}'), ("Q", "", "{bad")], "q string, s string, io string")
    outs = [r.p for r in q.select(P.prompt_io_mode("q", "s", "io").alias("p")).collect()]
    # K1: a present fn_name yields the Standard Input line
    assert outs == ["Qdef f():\nUse Standard Input format\n", "Q\nUse Call-Based format\n"]
    inv = [r.p for r in q.select(P.prompt_io_mode("q", "s", "io", invert_io_marker=True).alias("p")).collect()]
    assert inv[0].endswith("Call-Based format\n")


def test_completion_span(spark):
    t = "<|im_start|>assistant\n"
    vals = [f"x{t}abc", f"{t}a{t}bc", "no template"]
    df = _one_col(spark, vals)
    rows = {r.i: (r.s.loss_start, r.s.loss_chars) for r in
            df.select("i", T.completion_span(F.col("s"), t).alias("s")).collect()}
    assert rows[0] == (len(vals[0]) - 3, 3)
    assert rows[1] == (len(vals[1]) - 2, 2)  # last occurrence
    assert rows[2] == (len(vals[2]), 0)       # fully masked


def test_concat_messages_null_side(spark):
    df = spark.createDataFrame([(1,)], "i int")
    m = F.array(T.message("user", F.lit("a")))
    out = df.select(T.concat_messages(F.lit(None).cast("array<struct<role:string,content:string>>"), m).alias("x")).first().x
    assert [x.content for x in out] == ["a"]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1,)], "i int")
    with pytest.raises(ValueError, match="missing input columns"):
        P.plain_messages(df, "u", "a")
