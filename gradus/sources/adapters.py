"""Base tables as the records that operators take, by fixed arithmetic on their columns.

The SQL here runs in any engine: a table is named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ROLLOUTS = """
SELECT id, doc, answer_label_available, answer_correct, answer_score, visual_score, CAST(answer_score AS DOUBLE) / 10 AS answer_confidence, CAST(visual_score AS DOUBLE) / 10 AS visual_confidence,
  vision_tokens, proxy_fallback, CASE WHEN proxy_fallback THEN CAST(0 AS DOUBLE) ELSE exp(-u / CAST(0.5 AS DOUBLE)) END AS visual_proxy, u, reason_text, e1, e2, rank, step
FROM (SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id AS doc, l.doc_id IS NOT NULL AS answer_label_available, coalesce(l.quality = 1, false) AS answer_correct,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST((d.doc_id * 5 + d.n_chars) % 11 AS INT) END AS answer_score,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST((d.doc_id * 3 + d.n_chars) % 11 AS INT) END AS visual_score,
  CAST(d.n_chars % 40 AS INT) AS vision_tokens, d.n_chars % 40 < 8 AS proxy_fallback, CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS u,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL WHEN d.doc_id % 9 = 1 THEN '  ' ELSE 'because' END AS reason_text,
  d.doc_id % 6 = 0 AS e1, d.doc_id % 10 = 0 AS e2, CAST(d.doc_id % 4 AS INT) AS rank, CAST(d.n_chars % 16 AS INT) AS step
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) x"""

#: Tokens and samples of paired conditions: events of a user under each type.
TOKENS = """
SELECT CAST(user_id AS STRING) AS example_id, event_type AS condition, CAST(event_id AS INT) AS token_index, CAST(event_id % 7 AS INT) AS token_id, raw_js, baseline_js, corrected_gap, teacher_entropy, CAST(0.5 AS DOUBLE) * corrected_gap + CAST(0.5 AS DOUBLE) * teacher_entropy AS uncertainty
FROM (SELECT user_id, event_type, event_id, raw_js, baseline_js, teacher_entropy, greatest(raw_js - baseline_js, CAST(0 AS DOUBLE)) AS corrected_gap
  FROM (SELECT user_id, event_type, event_id, value / CAST(500 AS DOUBLE) AS raw_js, CAST((event_id * 13) % 50 AS DOUBLE) / 100 AS baseline_js, CAST((event_id * 29) % 100 AS DOUBLE) / 100 AS teacher_entropy FROM {events}) a) b"""

SAMPLES = f"""
SELECT example_id, condition, CAST(count(*) AS INT) AS vision_tokens, count(*) < 3 AS proxy_fallback, avg(raw_js) AS raw_js, avg(baseline_js) AS baseline_js, avg(corrected_gap) AS corrected_gap, avg(teacher_entropy) AS teacher_entropy, avg(uncertainty) AS uncertainty,
  CASE WHEN count(*) < 3 THEN CAST(0 AS DOUBLE) ELSE exp(-avg(uncertainty) / CAST(0.5 AS DOUBLE)) END AS visual_proxy, CASE WHEN sum(token_id) % 3 = 0 THEN NULL ELSE sum(token_id) % 2 = 0 END AS answer_correct
FROM ({TOKENS}) t GROUP BY example_id, condition"""

#: Groups of four rewards.
REWARDS = "SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS grp, value AS reward, event_type, user_id, CAST(event_id % 2 AS INT) AS rank FROM {events}"

#: Attempts at stating an order's status and priority; some are missing, some malformed.
ATTEMPTS = """
SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey % 5 <> 0 AS received, o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AS parsed,
  CASE WHEN o_orderkey % 3 = 0 THEN 'X' WHEN o_orderkey % 7 = 1 THEN concat(' ', lower(o_orderstatus), chr(9)) ELSE o_orderstatus END AS said_status, CASE WHEN o_orderkey % 4 = 0 THEN '9-NONE' ELSE o_orderpriority END AS said_priority, CASE WHEN o_orderkey % 8 = 6 THEN 'ＹＥＳ' WHEN o_orderkey % 4 = 0 THEN ' Yes' WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS answer,
  CAST((o_orderkey * 7) % 101 AS INT) AS visual_confidence, CAST((o_orderkey * 11) % 101 AS INT) AS answer_confidence
FROM {orders}"""


def _legacy(vision: str, answer: str = "concat(chr(92), 'boxed', chr(123), source, chr(125))", visual: str = "CAST(n_chars % 101 AS STRING)", conditional: str = "'90'", reasoning: str = "'so'", gap: str = "''", tail: str = "''", space: str = "''") -> str:
    return f"concat({space}, '<think>', {space}, '<vision>', {vision}, '</vision>', {space}, '<reasoning>', {reasoning}, '</reasoning></think>', {space}, {answer}, {space}, {gap}, '<confidence><vision_confidence>', {visual}, '</vision_confidence>', {space}, '<conditional_answer_confidence>', {conditional}, '</conditional_answer_confidence></confidence>', {space}, {tail})"


def _object(*pairs: str) -> str:
    return f"concat(chr(123), {', '.join([*pairs]) or chr(39) * 2}, chr(125))"


_COLOR, _SHAPE = "'\"color\": \"', lang, '\"'", "', \"shape\": \"', source, '\"'"
#: Completions of the earlier format over slots color and shape: SQL of the text, and the code of its fault.
LEGACY_CASES: tuple[tuple[str, str | None], ...] = (
    (_legacy(_object(_COLOR, _SHAPE)), None),
    (_legacy(_object(_COLOR, _SHAPE), answer="concat(chr(92), 'boxed', chr(123), 'frac', chr(123), '1', chr(125), chr(123), '2', chr(125), chr(125))"), None),
    (_legacy(_object(_COLOR)), None),
    (_legacy(_object()), None),
    (_legacy(_object(_COLOR, _SHAPE), space="concat(chr(10), chr(32), chr(9))"), None),
    (_legacy(_object(_COLOR, "', \"size\": \"x\"'")), "unknown_fact"),
    (_legacy(_object(_COLOR, "', \"color\": \"x\"'")), "repeated_fact"),
    (_legacy(_object("'\"color\": 42'")), "fact_not_string"),
    (_legacy(_object("'color'")), "facts_not_json"),
    (_legacy("'[\"color\"]'"), "facts_not_object"),
    (_legacy(_object(_COLOR), visual="'101'"), "confidence"),
    (_legacy(_object(_COLOR), visual="'08'"), "confidence"),
    (_legacy(_object(_COLOR), conditional="'90.0'"), "confidence"),
    (_legacy(_object(_COLOR), tail="' extra'"), "confidence"),
    (_legacy(_object(_COLOR), gap="'<analysis>maybe</analysis>'"), "confidence"),
    (_legacy(_object(_COLOR), answer="source"), "boxed_answer"),
    (_legacy(_object(_COLOR), answer="concat(chr(92), 'boxed', chr(123), source)"), "boxed_answer"),
    (_legacy(_object(_COLOR), reasoning="' '"), "empty_reasoning"),
    (_legacy(_object(_COLOR), answer="concat(chr(92), 'boxed', chr(123), ' ', chr(125))"), "empty_answer"),
    ("concat('text alone ', source)", "structure"),
    ("CAST(NULL AS STRING)", "missing"),
)
LEGACY = f"SELECT doc_id, lang, source, n_chars, CASE doc_id % {len(LEGACY_CASES)} {' '.join(f'WHEN {i} THEN {text}' for i, (text, _) in enumerate(LEGACY_CASES))} END AS completion FROM {{documents}}"


def _record(*fields: str) -> str:
    return f"concat(chr(123), {', '.join(fields)}, chr(125))"


_ID, _IMAGES = "'\"id\": \"#', doc_id, '#\"'", "', \"student_image\": \"s/', source, '.png\", \"teacher_image\": \"t/', source, '.png\"'"
_ASKED, _SPLIT = "', \"question\": \"#', doc_id, '# which?\"'", "', \"split\": \"dev\"'"
_FACTS, _ACCEPTED = "', \"required_visual_facts\": ', chr(123), '\"color\": \"red\", \"shape\": ', chr(123), '\"canonical\": \"', lang, '\", \"aliases\": [\"any\"]', chr(125), chr(125)", "', \"accepted_answers\": [\"yes\", \"', lang, '\"]'"
#: JSON lines of examples: SQL of the line, and the rule that it breaks.
EXAMPLE_CASES: tuple[tuple[str, str | None], ...] = (
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, _FACTS, _ACCEPTED), None),
    (_record(_ID, _IMAGES, _ASKED, _FACTS, _ACCEPTED), "missing keys: split"),
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, _FACTS, _ACCEPTED, "', \"z\": 1, \"y\": 2'"), "unknown keys: y, z"),
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, _FACTS, _ACCEPTED, "', \"id\": \"again\"'"), "invalid JSON"),
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, _FACTS, "', \"accepted_answers\": [NaN]'"), "invalid JSON"),
    ("concat('[\"#', doc_id, '#\"]')", "not an object"),
    (_record("'\"id\": ', doc_id", _SPLIT, _IMAGES, _ASKED, _FACTS, _ACCEPTED), "id must be string"),
    (_record(_ID, _SPLIT, _IMAGES, "', \"question\": \"  \"'", _FACTS, _ACCEPTED), "question is empty"),
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, _FACTS, "', \"accepted_answers\": \"yes\"'"), "accepted_answers must be array"),
    (_record(_ID, _SPLIT, _IMAGES, _ASKED, "', \"required_visual_facts\": null'", _ACCEPTED), "required_visual_facts must be object"),
    ("concat(chr(123), '\"id\": \"#', doc_id, '#\"')", "invalid JSON"),
)
EXAMPLE_LINES = f"SELECT doc_id, lang, source, CASE doc_id % {len(EXAMPLE_CASES)} {' '.join(f'WHEN {i} THEN {text}' for i, (text, _) in enumerate(EXAMPLE_CASES))} END AS value FROM {{documents}}"

#: Tagged completions with nine kinds of faults.
COMPLETIONS = """
SELECT doc_id, CASE doc_id % 9
  WHEN 0 THEN concat('<vision>seen ', doc_id, '</vision><reason>so</reason><answer>B</answer><confidence><visual_confidence>', n_chars % 11, '</visual_confidence><answer_confidence>7</answer_confidence></confidence>')
  WHEN 1 THEN concat('<vision>seen</vision><reason> </reason><answer>', doc_id % 4, '</answer>')
  WHEN 2 THEN '<think><vision>inside</vision></think><reasoning>old</reasoning><answer>A</answer><confidence><visual_confidence>11</visual_confidence><answer_confidence>3</answer_confidence></confidence>'
  WHEN 3 THEN '<reason>first</reason><vision>late</vision><answer>C</answer><confidence></confidence>'
  WHEN 4 THEN '<vision>a</vision><vision>b</vision><reason>r</reason><answer></answer><confidence><visual_confidence>08</visual_confidence><answer_confidence>10</answer_confidence></confidence>'
  WHEN 5 THEN '<vision>say <confidence> here</vision><reason>r</reason><answer>D</answer><confidence><visual_confidence>4</visual_confidence><answer_confidence>x</answer_confidence></confidence>'
  WHEN 6 THEN '<vision></vision><reason>r</reason><answer>b. second</answer>'
  WHEN 7 THEN concat('plain text ', doc_id)
  ELSE '<vision>v</vision> <answer>A</answer> <reason>after</reason> <confidence> <visual_confidence>0</visual_confidence> <answer_confidence>9</answer_confidence> </confidence>' END AS completion
FROM {documents}"""


def duck(sql: str) -> str:
    """The same statement with plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout records, with their arrays and maps."""
    rows = view(spark, sf_dir, ROLLOUTS)
    errors = F.array_compact(F.array(F.when(F.col("e1"), "empty_reason"), F.when(F.col("e2"), "missing_confidence")))
    parts = F.create_map(F.lit("gap"), F.col("u"), F.lit("entropy"), F.when(F.col("doc") % 3 != 0, 1 - F.col("u")))
    reward = F.create_map(F.lit("utility"), F.col("answer_correct").cast("double"), F.lit("report"), -F.col("u"))
    return rows.withColumns({"format_errors": errors, "proxy_components": parts, "reward": reward})


def examples_and_attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, ATTEMPTS)
    examples = rows.select("id", F.create_map(F.lit("status"), F.array("status"), F.lit("priority"), F.array("priority", F.lit("any"))).alias("facts"), F.array(F.lit("yes")).alias("answers"))
    attempts = rows.where("received").select("id", "parsed", F.create_map(F.lit("status"), "said_status", F.lit("priority"), "said_priority").alias("visual_facts"), "answer", "visual_confidence", "answer_confidence")
    return examples, attempts


def written_lines(spark: SparkSession, sf_dir: str, sql: str, where: str = "true") -> str:
    """A folder of text files with one line for each value of a statement."""
    path = folder(spark, "lines")
    view(spark, sf_dir, sql).where(where).select("value").write.text(path)
    return path


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, student, teacher, baseline): an embedding and the two after it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("v"))
    after = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("v").alias(name))
    return e.select("vec_id", F.col("v").alias("student")).join(after(1, "teacher"), "vec_id").join(after(2, "baseline"), "vec_id")
