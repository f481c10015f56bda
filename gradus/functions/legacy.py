"""The earlier completion format: thoughts with JSON facts and reasoning, a boxed answer, and two percentages.

An example's slots are part of the grammar: a fact of another slot breaks it, a slot without a fact doesn't.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import legacy_score
from .text import folded

# The tags in their order, and the marker of the answer between them.
HEAD = ("<think>", "<vision>", "</vision>", "<reasoning>", "</reasoning>", "</think>")
ANSWER = "\\boxed{"
REPORT = ("<confidence>", "<vision_confidence>", "</vision_confidence>", "<conditional_answer_confidence>", "</conditional_answer_confidence>", "</confidence>")

_ANY, _PERCENT = "(.*?)", "(0|[1-9][0-9]?|100)"
_HEAD = re.compile(r"\s*" + HEAD[0] + r"\s*" + HEAD[1] + _ANY + HEAD[2] + r"\s*" + HEAD[3] + _ANY + HEAD[4] + r"\s*" + HEAD[5] + r"\s*", re.DOTALL)
_REPORT = re.compile(r"\s*" + REPORT[0] + r"\s*" + REPORT[1] + _PERCENT + REPORT[2] + r"\s*" + REPORT[3] + _PERCENT + REPORT[4] + r"\s*" + REPORT[5] + r"\s*")
PARSED = "error string, facts map<string,string>, reasoning string, answer string, visual_confidence int, answer_confidence int, report_start int"


class Malformed(ValueError):
    """The text breaks the grammar; the message is a code."""


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Malformed("repeated_fact")
    return out


def balanced(text: str, at: int) -> int | None:
    """Place of the brace that closes one opened just before ``at``."""
    depth = 1
    for brace in re.finditer(r"[{}]", text[at:]):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            return at + brace.start()
    return None


def _facts(text: str, slots: set[str]) -> dict[str, str]:
    try:
        facts = json.loads(text.strip(), object_pairs_hook=_once)
    except json.JSONDecodeError:
        raise Malformed("facts_not_json") from None
    if not isinstance(facts, dict):
        raise Malformed("facts_not_object")
    if not slots.issuperset(facts):
        raise Malformed("unknown_fact")
    if any(not isinstance(value, str) for value in facts.values()):
        raise Malformed("fact_not_string")
    return facts


def parse(text: str | None, slots: set[str]) -> tuple:
    """(error, facts, reasoning, answer, visual, conditional, place of the report): the error or all the rest is null."""
    try:
        if text is None:
            raise Malformed("missing")
        head = _HEAD.match(text)
        if head is None:
            raise Malformed("structure")
        facts = _facts(head[1], slots)
        start = head.end() + len(ANSWER)
        end = balanced(text, start) if text.startswith(ANSWER, head.end()) else None
        if end is None:
            raise Malformed("boxed_answer")
        report = _REPORT.fullmatch(text, end + 1)
        if report is None:
            raise Malformed("confidence")
        reasoning, answer = head[2].strip(), text[start:end].strip()
        if not reasoning or not answer:
            raise Malformed("empty_reasoning" if not reasoning else "empty_answer")
    except Malformed as e:
        return (str(e), *(None,) * 6)
    return (None, facts, reasoning, answer, int(report[1]), int(report[2]), text.index(REPORT[0], end))


def parse_attempts(texts: pd.Series, slots: pd.Series) -> pd.DataFrame:
    names = [c.split()[0] for c in PARSED.split(", ")]
    found = pd.DataFrame([parse(t, set(s) if s is not None else set()) for t, s in zip(texts, slots, strict=True)], columns=names)
    return found.astype({c: "Int32" for c in names[4:]})


def parsed(column: str, slots: str):
    """A struct of PARSED. The UDF is made where a session is, as its type is named in SQL."""
    return F.pandas_udf(parse_attempts, PARSED)(column, slots)


def attempts(rows: DataFrame, completion: str = "completion", facts: str = "facts", answers: str = "answers") -> DataFrame:
    """Adds parsed, format_error, the parts, per_fact_correct, visual_correct, answer_correct and the three rewards.

    facts: map<string, array<string>> of each slot's accepted values. Without a parse, all but the error is null.
    """
    rows = rows.withColumn("_slots", F.map_keys(facts)).withColumn("_parsed", parsed(completion, "_slots"))
    rows = rows.select("*", F.col("_parsed.error").alias("format_error"), F.col("_parsed.error").isNull().alias("parsed"), *[F.col(f"_parsed.{c}").alias(n) for c, n in (("facts", "visual_facts"), ("reasoning", "reasoning"), ("answer", "answer"), ("visual_confidence", "visual_confidence"), ("answer_confidence", "answer_confidence"), ("report_start", "report_start"))])
    rows = verify(rows, facts, answers)
    rows = rows.withColumns({"per_fact_correct": F.when(F.col("parsed"), F.col("per_fact_correct")), "visual_correct": F.when(F.col("parsed"), F.col("visual_correct")), "answer_correct": F.when(F.col("parsed"), F.col("answer_correct"))})
    scores = legacy_score(F.col("visual_correct").cast("int"), F.col("answer_correct").cast("int"), F.col("visual_confidence") / 100, F.col("answer_confidence") / 100)
    return rows.withColumns(scores).drop("_slots", "_parsed")


def verify(rows: DataFrame, facts: str = "facts", answers: str = "answers", said: str = "visual_facts", answer: str = "answer") -> DataFrame:
    """Adds per_fact_correct, visual_correct and answer_correct; both sides are folded. A slot that isn't said is wrong.

    facts: map<string, array<string>> of each slot's accepted values; answers: array<string>.
    """
    flat = F.flatten(F.map_values(facts))
    rows = rows.withColumns({"_accepted": folded(flat), "_said": folded(F.map_values(said)), "_answers": folded(F.col(answers)), "_answer": folded(F.array(answer))})
    rows = rows.withColumn("_by_slot", F.map_from_arrays(F.coalesce(F.map_keys(said), F.array().cast("array<string>")), F.coalesce("_said", F.array().cast("array<string>"))))
    values, keys = F.map_values(facts), F.map_keys(facts)
    before = lambda i: F.aggregate(F.slice(values, 1, i), F.lit(0), lambda n, v: n + F.size(v))
    holds = F.transform(keys, lambda k, i: F.coalesce(F.array_contains(F.slice(F.col("_accepted"), before(i) + 1, F.size(F.get(values, i))), F.try_element_at("_by_slot", k)), F.lit(False)))
    rows = rows.withColumn("per_fact_correct", F.map_from_arrays(keys, holds))
    rows = rows.withColumn("visual_correct", F.forall(F.map_values("per_fact_correct"), lambda x: x))
    rows = rows.withColumn("answer_correct", F.coalesce(F.array_contains("_answers", F.get("_answer", F.lit(0))), F.lit(False)))
    return rows.drop("_accepted", "_said", "_answers", "_answer", "_by_slot")

