import random

import pytest
from pyspark.sql import functions as F

from gradus.functions import digests, legacy, prompts
from gradus.functions import text as T

TAIL = "<confidence><visual_confidence>{}</visual_confidence><answer_confidence>{}</answer_confidence></confidence>"
GOOD = "<vision>a</vision><reason>b</reason><answer>c</answer>" + TAIL


def parse(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["p"] for r in T.parse_completions(rows, "text", "p").orderBy("i").collect()]


@pytest.mark.parametrize(("score", "ok"), [("0", True), ("9", True), ("10", True), ("11", False), ("80", False), ("8.5", False), ("08", False), ("-1", False), (" 8 ", False)])
def test_scores(spark, score, ok):
    p = parse(spark, GOOD.format(score, "5"))[0]
    assert p["visual_confidence"] == (int(score) if ok else None)
    assert ("invalid_visual_confidence" in p["format_errors"]) != ok
    assert p["answer_confidence"] == 5


def test_sections_and_order(spark):
    got = parse(
        spark, GOOD.format(1, 2), "", "<answer>x</answer>", "<reason>r</reason><vision>v</vision><answer>x</answer>", "<think> <vision>v</vision> </think><reason>r</reason><answer>x</answer>",
        "<vision>v</vision><reason>r</reason><answer>x</answer><answer>y</answer>", "<vision>see <confidence> here</vision><reason>r</reason><answer>x</answer>" + TAIL.format(3, 4), "<vision>v</vision><reason><reasoning r</reason><answer>x</answer>" + TAIL.format(3, 4),
    )
    assert got[0]["format_errors"] == []
    assert got[1]["format_errors"] == ["missing_or_invalid_vision", "missing_or_invalid_reason", "missing_or_empty_answer", "missing_confidence", "noncanonical_structure"]
    assert got[2]["answer"] == "x" and got[2]["report_start"] is None
    assert got[3]["format_errors"][:2] == ["missing_or_invalid_vision", "misordered_reason"]
    assert got[4]["vision_text"] == "v" and got[4]["format_errors"] == ["missing_confidence", "noncanonical_structure"]
    assert got[5]["answer"] is None
    assert got[6]["report_start"] == got[6]["report_start"] and got[6]["visual_confidence"] == 3 and got[6]["format_errors"] == []
    assert got[7]["format_errors"] == ["legacy_reasoning_tag", "noncanonical_structure"]


def test_masks(spark):
    spans = [(0, 4), (4, 9), (9, 14), (14, 20)]
    rows = spark.createDataFrame([(spans, 4, 9, 12), (spans, 4, 9, None), (spans, None, None, 0)], "spans array<struct<start:int,end:int>>, vs int, ve int, r int")
    got = [r[0] for r in rows.select(T.masks(F.col("spans"), F.col("vs"), F.col("ve"), F.col("r"))).collect()]
    assert [(m["content"], m["report"], m["vision"]) for m in got] == [([1, 1, 0, 0], [0, 0, 1, 1], [0, 1, 0, 0]), ([1] * 4, [0] * 4, [0, 1, 0, 0]), ([0] * 4, [1] * 4, [0] * 4)]


@pytest.mark.parametrize(
    ("answer", "accepted", "want"),
    [("b", ["b"], (True, True)), ("a", ["b"], (False, True)), ("b. dog", ["b"], (True, False)), ("b) dog", ["b"], (True, False)), ("b. cat", ["b"], (False, False)), ("a. cat", ["b"], (False, False)), ("dog", ["b"], (False, False)), ("", ["b"], (False, False)), (None, ["b"], (False, False)), ("two dogs", ["two dogs", "2"], (True, True)), ("b. dog", ["two dogs"], (False, True))],
)
def test_grading(spark, answer, accepted, want):
    rows = spark.createDataFrame([(answer, accepted, "Which?\nA. Cat\n B) Dog")], "a string, k array<string>, q string")
    got = T.graded(rows, "a", "k", "q").first()
    assert (got["correct"], got["canonical"]) == want
    assert got["verified"] == (answer in accepted if answer else None)


def test_choices_last_counts(spark):
    rows = spark.createDataFrame([("A. one\nB. two\nA. three",), ("none",)], "q string")
    assert [r[0] for r in rows.select(T.choices(T.options(F.col("q"), 1), T.options(F.col("q"), 2))).collect()] == [{"b": "two", "a": "three"}, {}]


def test_folding(spark):
    rows = spark.createDataFrame([("  Straße ﬁne\t x ",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.normalized("t")).collect()] == ["strasse fine x", None]
    assert T.fold("ＡＢ") == "ab"


def test_terminals_and_messages(spark):
    rows = spark.createDataFrame([([1, 2, 9, 9],), ([9],), ([],), ([1],)], "ids array<int>")
    assert [r[0] for r in rows.select(T.without_terminal(F.col("ids"), F.array(F.lit(9)))).collect()] == [[1, 2, 9], [], [], [1]]
    m = spark.range(1).select(prompts.teacher(F.lit(" Q? "), F.lit(None).cast("string"))).first()[0]
    assert [x["role"] for x in m] == ["system", "user"] and m[1]["content"][1]["text"] == "Question: Q?"


LEGACY = "<think><vision>{}</vision><reasoning>{}</reasoning></think>{}{}<confidence><vision_confidence>{}</vision_confidence><conditional_answer_confidence>{}</conditional_answer_confidence></confidence>{}"


@pytest.mark.parametrize(
    ("parts", "error"),
    [({}, None), ({"facts": "{}"}, None), ({"facts": '{"object": "a", "extra": "v"}'}, "unknown_fact"), ({"facts": '{"object": "a", "object": "b"}'}, "repeated_fact"), ({"facts": '{"object": 42}'}, "fact_not_string"), ({"facts": "[]"}, "facts_not_object"), ({"facts": "x"}, "facts_not_json"),
     ({"answer": "\\boxed{\\frac{1}{2}}"}, None), ({"answer": "yes"}, "boxed_answer"), ({"answer": "\\boxed{open"}, "boxed_answer"), ({"answer": "\\boxed{ }"}, "empty_answer"), ({"reasoning": "\n"}, "empty_reasoning"), ({"visual": "101"}, "confidence"), ({"visual": "08"}, "confidence"), ({"conditional": "90.0"}, "confidence"), ({"tail": " extra"}, "confidence"), ({"gap": "<analysis>x</analysis>"}, "confidence"), ({"gap": "\n ", "tail": "\n"}, None)],
)
def test_legacy_grammar(parts, error):
    p = {"facts": '{"object": "square", "颜色": "blue"}', "reasoning": "so", "answer": "\\boxed{square}", "gap": "", "visual": "80", "conditional": "90", "tail": ""} | parts
    text = LEGACY.format(*(p[k] for k in ("facts", "reasoning", "answer", "gap", "visual", "conditional", "tail")))
    got = legacy.parse(text, {"object", "颜色"})
    assert got[0] == error
    if error is None:
        assert got[3] == p["answer"][7:-1] and got[4:] == (80, 90, text.index("<confidence>"))


def test_legacy_attempts(spark):
    text = LEGACY.format('{"color": " ＲＥＤ "}', "so", "\\boxed{Yes}", "", 80, 90, "")
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no")], "i int, completion string")
    rows = rows.withColumns({"facts": F.expr("map('color', array('blue', 'red'), 'shape', array('x'))"), "answers": F.expr("array('yes')")})
    got = legacy.attempts(rows).orderBy("i").collect()
    assert [(r["format_error"], r["visual_correct"], r["answer_correct"]) for r in got] == [(None, False, True), ("missing", None, None), ("structure", None, None)]
    assert got[0]["per_fact_correct"] == {"color": True, "shape": False} and got[1]["per_fact_correct"] is None
    assert round(got[0]["total"], 9) == round(1 - 0.8**2, 9)


def test_digests(spark):
    import hashlib
    import json

    rows = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), (None,)], "t string")
    want = hashlib.sha256(json.dumps({"a": [1, 2], "b": 1}).encode()).hexdigest()
    assert [r[0] for r in rows.select(digests.canonical_sha256("t")).collect()] == [want, None]
    assert rows.select(digests.compact_sha256("t")).first()[0] == hashlib.sha256(b'{"a":[1,2],"b":1}').hexdigest()
    ids = spark.createDataFrame([(2, "b"), (1, "a")], "pos int, id string")
    assert digests.listed_sha256(ids, "pos", "id").first()["sha256"] == hashlib.sha256(b"a\nb").hexdigest()
    nested = spark.range(1).select(F.lit("r").alias("k"), F.struct(F.lit(1).alias("x"), F.struct(F.lit(2.5).alias("y"), F.lit("s").alias("z"), F.lit(True).alias("t"), F.lit(float("nan")).alias("n")).alias("b")).alias("a"))
    assert [tuple(r) for r in digests.flattened(nested, "k").collect()] == [("r", "a/x", 1.0), ("r", "a/b/y", 2.5)]


def test_folding_of_lists(spark):
    """Lists of any strings, nulls and empty ones, against the folding of each; ASCII text folds alike without Python."""
    rng = random.Random(3)
    parts = ["A", "b", " ", "\t", "\n", "\x1c", "\x1f", "\x0b", "\x00", "Z9", "ß", "İ", "ﬁ", " ", " ", "Σς", "１", "é", "é"]
    strings = ["".join(rng.choices(parts[: 10 if i % 2 else None], k=rng.randrange(7))) for i in range(400)]
    lists = [None, [], [None], *[[rng.choice([None, *strings]) for _ in range(rng.randrange(5))] for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, v array<string>")
    got = {r["i"]: r["f"] for r in rows.select("i", T.folded("v").alias("f")).collect()}
    assert got == {i: None if x is None else [T.fold(v) for v in x] for i, x in enumerate(lists)}
    rows = spark.createDataFrame([(s,) for s in [None, *strings]], "t string")
    assert all(r["f"] == T.fold(r["t"]) for r in rows.select("t", T.normalized("t").alias("f")).collect())
    plain = rows.where("length(t) = octet_length(t)").select("t", T.normalized_ascii(F.col("t")).alias("f")).collect()
    assert len(plain) > 200 and all(r["f"] == T.fold(r["t"]) for r in plain)
