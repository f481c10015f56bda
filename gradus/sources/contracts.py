"""Strict loaders of JSON lines: what breaks the contract is a row of a violations table, never a silent null.

``from_json`` keeps the last of a repeated key and ignores unknown ones, so lines are read as text and parsed to
variants, which refuse repeated keys, NaN and infinities. Values are typed only after their own type was looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded

#: Kinds of field: the variant type that a value must have, and how it is read.
KINDS = {"string": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "array": "ARRAY<.*", "object": "OBJECT<.*", "any": ".*"}
READS = {"string": "string", "int": "bigint", "bool": "boolean", "number": "double"}


class ContractError(ValueError):
    """Some rows break the contract; the message tells the first of them."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files, with lines numbered from 1 within each file.

    Files are read in splits, each by one task in order. A line's number is its place from the first of its split, and
    the lines of its file's earlier splits; only the splits' totals are shuffled and sorted, not the lines.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("n0") + F.col("at") - F.col("first") + 1).alias("line"), "raw")


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the variant ``doc``, null where the line is no JSON, repeats a key, or holds NaN or an infinity."""
    return rows.withColumn("doc", F.try_parse_json(raw))


def type_of(doc: Column, field: str) -> Column:
    """Name of the type of a field's value; VOID for null, null where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))


def keys_of(doc: Column) -> Column:
    return F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))


def violations(rows: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """(file, line, rule) for each broken rule: blank lines, bad JSON, missing and unknown keys, types, repeated ids."""
    optional = optional or {}
    doc, known = F.col("doc"), F.array(*map(F.lit, [*required, *optional]))
    have = F.coalesce(keys_of(doc), F.array().cast("array<string>"))
    is_object = doc.isNotNull() & F.schema_of_variant(doc).rlike("^OBJECT<")
    rules = [F.when(F.trim("raw") == "", "blank line"), F.when((F.trim("raw") != "") & doc.isNull(), "invalid JSON"), F.when(doc.isNotNull() & ~is_object, "not an object")]
    rules.append(F.when(is_object & (F.size(F.array_except(F.array(*map(F.lit, required)), have)) > 0), F.concat(F.lit("missing keys: "), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, required)), have)), ", "))))
    rules.append(F.when(is_object & (F.size(F.array_except(have, known)) > 0), F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(F.array_except(have, known)), ", "))))
    for field, kind in {**required, **optional}.items():
        found = type_of(doc, field)
        wrong = found.isNotNull() & ~found.rlike(f"^(?:{KINDS[kind]})$")
        rules.append(F.when(wrong if field in required else wrong & (found != "VOID"), f"{field} must be {kind}"))
        if kind == "string" and field in required:
            rules.append(F.when(F.trim(F.try_variant_get(doc, f"$.{field}", "string")) == "", f"{field} is empty"))
    own = rows.select("file", "line", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    ids = rows.select("file", "line", F.try_variant_get(doc, f"$.{key}", "string").alias("id")).where("id IS NOT NULL")
    again = ids.groupBy("file", "id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    return own.unionAll(again.select("file", "line", F.concat(F.lit(f"duplicate {key}: "), "id").alias("rule")))


def raise_on(found: DataFrame, what: str) -> None:
    """ContractError with the first violation in order of file and line, if there is one."""
    if first := found.orderBy("file", "line", "rule").limit(1).collect():
        raise ContractError(f"{what}: {first[0]['file']}:{first[0]['line']}: {first[0]['rule']}")


def typed(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields as columns, null where a value has another type; arrays, objects and anything else stay variants."""
    def read(field: str, kind: str) -> Column:
        value = F.try_variant_get("doc", f"$.{field}", READS.get(kind, "variant"))
        return F.when(type_of(F.col("doc"), field).rlike(f"^(?:{KINDS[kind]})$"), value) if kind in READS else value

    return rows.select("file", "line", *[read(f, kind).alias(f) for f, kind in fields.items()])


def load(spark: SparkSession, path: str, required: dict[str, str], optional: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """Strict: typed rows of a file whose every line keeps the contract; an empty file breaks it."""
    rows = parsed(lines(spark, path))
    raise_on(violations(rows, required, optional, key), "records")
    return typed(rows, {**required, **(optional or {})})


def load_attempts(spark: SparkSession, path: str, required: dict[str, str], key: str = "id") -> DataFrame:
    """Permissive: lines with an id and bad content become rows with a format_error; others still break the contract."""
    rows = parsed(lines(spark, path)).where(F.trim("raw") != "")
    found = violations(rows, required, key=key)
    fatal = found.where(F.col("rule").isin("invalid JSON", "not an object", f"{key} is empty", f"{key} must be string") | F.col("rule").startswith("duplicate ") | F.col("rule").rlike(rf"^missing keys: (?:.*, )?{key}(?:,|$)"))
    raise_on(fatal, "attempts")
    errors = found.groupBy("file", "line").agg(F.min("rule").alias("format_error"))
    return typed(rows, required).join(errors, ["file", "line"], "left")


# Schemas of the record files: required fields, and optional ones.
EXAMPLE = {"id": "string", "split": "string", "student_image": "string", "teacher_image": "string", "question": "string", "required_visual_facts": "object", "accepted_answers": "array"}
OUTPUT = {"id": "string", "visual_facts": "object", "reasoning": "string", "answer": "string", "visual_confidence": "int", "conditional_answer_confidence": "int"}
PROXY_EXAMPLE = {"id": "string", "split": "string", "student_image": "string", "teacher_image": "string", "question": "string", "accepted_answers": "array"}
PROXY_OPTIONAL = {"student_image_hint": "string", "teacher_question": "string", "teacher_evidence": "any"}
SOURCE_ROW = {"id": "string", "split": "string", "source_image": "string", "question": "string", "accepted_answers": "array"}
SOURCE_OPTIONAL = {"evidence_bbox_xyxy": "any", "source_image_sha256": "string", "teacher_evidence": "any"}


def examples(rows: DataFrame) -> DataFrame:
    """Parsed example lines as columns: facts map<slot, accepted values>, canonical value first, and answers."""
    facts = F.try_variant_get("doc", "$.required_visual_facts", "map<string,variant>")
    plain = lambda v: F.try_variant_get(v, "$", "string")
    accepted = lambda k, v: F.when(F.schema_of_variant(v) == "STRING", F.array(plain(v))).otherwise(F.concat(F.array(F.try_variant_get(v, "$.canonical", "string")), F.coalesce(F.try_variant_get(v, "$.aliases", "array<string>"), F.array().cast("array<string>"))))
    named = {k: kind for k, kind in EXAMPLE.items() if kind == "string"}
    fields = [F.try_variant_get("doc", f"$.{f}", "string").alias(f) for f in named]
    return rows.select("file", "line", *fields, F.transform_values(facts, accepted).alias("facts"), F.try_variant_get("doc", "$.accepted_answers", "array<string>").alias("answers"))


def example_lines(rows: DataFrame) -> DataFrame:
    """``examples`` as JSON lines again, in a column value; facts are objects, whatever they were."""
    facts = F.transform_values("facts", lambda k, v: F.struct(v[0].alias("canonical"), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))).alias("aliases")))
    fields = [F.col(f) for f, kind in EXAMPLE.items() if kind == "string"]
    return rows.select(F.to_json(F.struct(*fields, facts.alias("required_visual_facts"), F.col("answers").alias("accepted_answers"))).alias("value"))


def example_rules(rows: DataFrame) -> DataFrame:
    """(id, rule) of ``examples``: facts and answers are there, and none has the same value twice when folded."""
    own = rows.withColumns({"_values": folded(F.flatten(F.map_values("facts"))), "_answers": folded("answers")})
    values = F.map_values("facts")
    before = lambda i: F.aggregate(F.slice(values, 1, i), F.lit(0), lambda n, v: n + F.size(v))
    own = own.withColumn("_by", F.transform(values, lambda v, i: F.slice("_values", before(i) + 1, F.size(v))))
    once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    return rules_table(own, "id", {
        "there are facts": F.size("facts") > 0, "slots are named": F.forall(F.map_keys("facts"), lambda k: F.trim(k) != ""), "facts are not empty": F.forall("_values", lambda v: v != ""),
        "aliases differ from the canonical value": F.forall("_by", once), "there are answers": F.size("answers") > 0, "answers are not empty": F.forall("_answers", lambda v: v != ""), "answers differ": once(F.col("_answers")),
    })


def parsed_or_error(parsed_id: Column, own_id: Column, error: Column) -> Column:
    """An attempt has either a parse under its own id, or an error that isn't empty."""
    return F.coalesce(F.when(parsed_id.isNull(), F.length(F.trim(error)) > 0).otherwise(error.isNull() & (parsed_id == own_id)), F.lit(False))


def evidence_holds(doc: Column) -> Column:
    """Evidence, a variant, is nothing, text that isn't empty, or an object or array; parsing has refused what is not finite."""
    kind = F.schema_of_variant(doc)
    return F.coalesce(F.when(kind == "STRING", F.trim(F.try_variant_get(doc, "$", "string")) != "").otherwise((kind == "VOID") | kind.rlike("^(?:OBJECT|ARRAY)<")), F.lit(True))


def sample_rules(metrics: list[str]) -> dict[str, Column]:
    """The contract of diagnostic samples."""
    number = {f"{m} is finite": finite(F.col(m)) for m in metrics}
    there = {f"{m} is there with tokens": (F.col("vision_tokens") == 0) | F.col(m).isNotNull() for m in metrics}
    return {
        "keys are not empty": (F.length("example_id") > 0) & (F.length("condition") > 0), "vision_tokens is at least 0": F.col("vision_tokens") >= 0, "proxy_fallback is known": F.col("proxy_fallback").isNotNull(),
        "visual_proxy is a probability": F.col("visual_proxy").isNotNull() & finite(F.col("visual_proxy"), 0, 1), "fallback means proxy 0": ~F.col("proxy_fallback") | (F.col("visual_proxy") == 0), **number, **there,
    }


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) that are there more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rules_table(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that doesn't hold; a rule that is null doesn't hold."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def finite(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Holds for null, and for numbers that are finite and within the bounds."""
    out = ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = out if low is None else out & (value >= low)
    out = out if high is None else out & (value <= high)
    return value.isNull() | out


def rollout_rules() -> dict[str, Column]:
    """The contract of rollout records."""
    errors = F.col("format_errors")
    finite_map = lambda c: F.forall(F.map_values(F.map_filter(c, lambda k, v: v.isNotNull())), lambda v: finite(v))
    return {
        "id is a nonempty string": F.length("id") > 0,
        "answer_correct is known": F.col("answer_correct").isNotNull(),
        "a correct answer has a label": F.col("answer_label_available") | ~F.col("answer_correct"),
        "vision_tokens is at least 0": F.col("vision_tokens") >= 0,
        "no tokens means fallback": F.col("proxy_fallback") | (F.col("vision_tokens") > 0),
        "visual_proxy is a probability": F.col("visual_proxy").isNotNull() & finite(F.col("visual_proxy"), 0, 1),
        "fallback means proxy 0": ~F.col("proxy_fallback") | (F.col("visual_proxy") == 0),
        "answer_confidence is a probability": finite(F.col("answer_confidence"), 0, 1),
        "visual_confidence is a probability": finite(F.col("visual_confidence"), 0, 1),
        "format_errors are known": errors.isNotNull() & F.forall(errors, lambda e: e.isNotNull()),
        "components are finite": finite_map(F.col("proxy_components")),
        "rewards are finite": finite_map(F.col("reward")),
    }


def box_holds(box: Column, width: Column, height: Column) -> Column:
    """Four numbers left, top, right, bottom with an area, inside the image."""
    x = [F.try_element_at(box, F.lit(i)) for i in range(1, 5)]
    return (F.size(box) == 4) & (x[0] >= 0) & (x[1] >= 0) & (x[0] < x[2]) & (x[1] < x[3]) & (x[2] <= width) & (x[3] <= height)


def inside(path: Column, prefix: str) -> Column:
    """A name directly under the prefix, without a way out of it."""
    return path.rlike(rf"^\Q{prefix}\E/[^/\\]+$") & ~path.contains("..")


def unique_normalised(values: Column, normalise) -> Column:
    folded = F.transform(values, normalise)
    return (F.size(values) > 0) & F.forall(folded, lambda v: v != "") & (F.size(F.array_distinct(folded)) == F.size(folded))


def question_holds(question: Column, cleaned: Column, token: str = "<image>", hint: str = "Answer with the option's letter") -> Column:
    """The image token starts the question and is there once, a hint is there once, and without both it is the cleaned one."""
    count = lambda part: (F.length(question) - F.length(F.replace(question, F.lit(part), F.lit("")))) / len(part)
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    bare = F.replace(F.replace(question, F.lit(token), F.lit("")), F.lit(hint), F.lit(""))
    return question.startswith(token) & (count(token) == 1) & (count(hint) == 1) & (spaced(bare) == spaced(cleaned))


def answer_holds(answer: Column, question: Column) -> Column:
    """A letter from A to D, and each of the four options once in the question."""
    letters = F.regexp_extract_all(question, F.lit(r"(?m)^\s*([A-D])[.)]\s+"), F.lit(1))
    return answer.rlike("^[A-D]$") & (F.array_sort(letters) == F.array(*map(F.lit, "ABCD")))


def complete(gathered: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem) of ids that are missing, unexpected, or there more than once."""
    counts = gathered.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("_e")).join(counts, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def united(shards: list[DataFrame], rank: str = "rank") -> DataFrame:
    """All ranks' rows, with ``from_rank``; a row that names another rank than its shard's is told by ``strange``."""
    parts = [s.withColumn("from_rank", F.lit(i)) for i, s in enumerate(shards)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("strange", ~F.col(rank).eqNullSafe(F.col("from_rank")))


def fresh_only(rows: DataFrame, nonce: str, version: str, current: int) -> DataFrame:
    """Rows of the current version, each nonce once; works on streams, where the state is the nonces seen."""
    return rows.where(F.col(version) == current).dropDuplicates([nonce])
