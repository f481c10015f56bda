"""Tagged text: sections, scores, structure, masks and answers.

Built-in expressions wherever one exists. Unicode folding has none, so ``normalized`` is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SECTIONS = ("vision", "reason", "reasoning", "answer")
SCORE = "^(?:10|[0-9])$"
# Fixed value: the canonical order of the four blocks.
CANONICAL = (
    r"(?s)\A\s*<vision>(.*?)</vision>\s*<reason>(.*?)</reason>\s*<answer>(.*?)</answer>\s*<confidence>\s*"
    r"<visual_confidence>(?:10|[0-9])</visual_confidence>\s*<answer_confidence>(?:10|[0-9])</answer_confidence>\s*</confidence>\s*\z"
)
MARKER = "<confidence>"


def fold(text: str | None) -> str | None:
    """Compatibility form, case folded, runs of any white space as one space, none at the ends."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def normalized(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def folded(lists: pd.Series) -> pd.Series:
    """Each string of a list, normalised."""
    return lists.map(lambda values: [fold(v) for v in values], na_action="ignore")


def normalized_ascii(text: Column) -> Column:
    """The same for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x20]+", " "))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal part that doesn't overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def find(text: Column, part: str) -> Column:
    """Place of the first occurrence from 0, -1 without one."""
    return F.instr(text, part) - 1


def section(text: Column, tag: str) -> Column:
    """struct(inner, start, end, outer_start, outer_end) of a tag that opens and closes once, in order; else null."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    start, end = find(text, opening), find(text, closing)
    inner = start + len(opening)
    once = (count_of(text, opening) == 1) & (count_of(text, closing) == 1) & (end >= inner)
    parts = F.struct(F.substring(text, inner + 1, end - inner).alias("inner"), inner.alias("start"), end.alias("end"), start.alias("outer_start"), (end + len(closing)).alias("outer_end"))
    return F.when(once, parts)


def score_of(text: Column, tag: str) -> Column:
    """A whole number from 0 to 10 alone in its tag; else null."""
    inner = section(text, tag)["inner"]
    return F.when(inner.rlike(SCORE), inner.cast("int"))


def strip(text: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def parse_completions(rows: DataFrame, column: str, name: str = "parsed") -> DataFrame:
    """Adds a struct of the recoverable sections, scores, spans, and error codes in their order.

    Vision counts where it stands alone before the others, or whole within one think block. The report starts at the
    first marker that is in no section. Scores are read from there on only. Steps build on columns of the step before, so
    each is computed once.
    """
    text, own = F.col(column), [f"_{name}_{part}" for part in (*SECTIONS, "legal", "report", "visual", "confidence")]
    rows = rows.withColumns({c: section(text, tag) for c, tag in zip(own, SECTIONS, strict=False)})
    v, r, g, a, legal_at, report_at, visual_at, confidence_at = map(F.col, own)
    think, unthink = find(text, "<think>"), find(text, "</think>")
    before = lambda x: x.isNull() | (v["outer_end"] <= x["outer_start"])
    direct = v.isNotNull() & (think < 0) & (unthink < 0) & before(r) & before(g) & before(a)
    wrapped = v.isNotNull() & (count_of(text, "<think>") == 1) & (count_of(text, "</think>") == 1) & (think < v["outer_start"]) & (v["outer_end"] < unthink) & before(r) & before(g)
    rows = rows.withColumn(own[4], direct | wrapped)
    legal = legal_at
    vision = F.when(legal, strip(v["inner"]))
    reason = F.when(r.isNotNull(), strip(r["inner"])).otherwise(strip(g["inner"]))
    answer = F.nullif(strip(a["inner"]), F.lit(""))
    # Markers by their places: pieces between markers have known lengths.
    pieces = F.split(text, MARKER)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda n, p: n + F.length(p)) + (i - 1) * len(MARKER))
    places = F.when(F.size(pieces) > 1, places).otherwise(F.array().cast("array<int>"))
    outside = lambda p, x: x.isNull() | (p < x["start"]) | (p >= x["end"])
    found = F.try_element_at(F.filter(places, lambda p: outside(p, v) & outside(p, r) & outside(p, g) & outside(p, a)), F.lit(1))
    rows, report = rows.withColumn(own[5], found), report_at
    tail = F.substring(text, report + 1, F.length(text))
    rows = rows.withColumns({own[6]: score_of(tail, "visual_confidence"), own[7]: score_of(tail, "answer_confidence")})
    visual, confidence = visual_at, confidence_at
    legacy = F.contains(text, F.lit("<reasoning")) | F.contains(text, F.lit("</reasoning"))
    ordered = v.isNotNull() & a.isNotNull() & (v["outer_end"] <= r["outer_start"]) & (r["outer_end"] <= a["outer_start"])
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    codes = [
        F.when(~legal, "missing_or_invalid_vision").when(empty(vision), "empty_vision"),
        F.when(r.isNull(), "missing_or_invalid_reason").when(empty(reason), "empty_reason").when(~F.coalesce(ordered, F.lit(False)), "misordered_reason"),
        F.when(answer.isNull(), "missing_or_empty_answer"),
        F.when(report.isNull(), "missing_confidence").when(visual.isNull(), "invalid_visual_confidence"),
        F.when(report.isNotNull() & confidence.isNull(), "invalid_answer_confidence"),
        F.when(legacy, "legacy_reasoning_tag"),
        F.when(~text.rlike(CANONICAL) | v.isNull() | r.isNull() | a.isNull() | empty(reason) | legacy, "noncanonical_structure"),
    ]
    parsed = F.struct(
        vision.alias("vision_text"), reason.alias("reasoning_text"), answer.alias("answer"), visual.alias("visual_confidence"), confidence.alias("answer_confidence"),
        F.array_compact(F.array(*codes)).alias("format_errors"), F.when(legal & ~empty(vision), v["start"]).alias("vision_start"), F.when(legal & ~empty(vision), v["end"]).alias("vision_end"), report.alias("report_start"),
    )
    return rows.withColumn(name, parsed).drop(*own)


def masks(spans: Column, vision_start: Column, vision_end: Column, report_start: Column) -> Column:
    """struct(content, report, vision) of 0 and 1 for each (start, end) token span.

    The first token that touches the report starts it; vision tokens lie wholly in the vision text and in the content.
    """
    first = F.array_position(F.transform(spans, lambda s: s["end"] > report_start), F.lit(True)) - 1
    content_end = F.when(report_start.isNull(), F.size(spans)).when(first >= 0, first).otherwise(0)
    content = F.transform(spans, lambda s, i: (i < content_end).cast("int"))
    seen = F.transform(spans, lambda s, i: F.coalesce(((i < content_end) & (s["start"] >= vision_start) & (s["end"] <= vision_end) & (s["start"] < s["end"])).cast("int"), F.lit(0)))
    return F.struct(content.alias("content"), F.transform(content, lambda c: 1 - c).alias("report"), seen.alias("vision"))


def options(question: Column, part: int) -> Column:
    """Letters (1) or texts (2) of the option lines of a question."""
    return F.regexp_extract_all(question, F.lit(r"(?mdU)^\s*([A-D])[.)]\s+([^\n]+)$"), F.lit(part))


def choices(letters: Column, texts: Column) -> Column:
    """Map of option letter to text; of a letter that repeats the last counts."""
    pairs = F.zip_with(letters, texts, lambda a, b: F.struct(F.lower(a).alias("key"), b.alias("value")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["key"] == p["key"])) == 0)
    return F.map_from_entries(last)


def verify(answer: Column, accepted: Column) -> Column:
    """Whether a normalised answer is an accepted one; null where there is none to look at."""
    return F.when(F.coalesce(answer, F.lit("")) != "", F.array_contains(accepted, answer))


def graded(rows: DataFrame, answer: str, accepted: str, question: str) -> DataFrame:
    """Adds correct, canonical, and verified, which is null without an answer; answers, accepted and options are folded."""
    own = {"_answer": F.get(folded(F.array(answer)), F.lit(0)), "_accepted": folded(F.col(accepted)), "_texts": folded(options(F.col(question), 2))}
    rows = rows.withColumns(own)
    correct, canonical = grade(F.col("_answer"), F.col("_accepted"), choices(options(F.col(question), 1), F.col("_texts")))
    return rows.withColumns({"correct": correct, "canonical": canonical, "verified": verify(F.col("_answer"), F.col("_accepted"))}).drop(*own)


def grade(answer: Column, accepted: Column, by_letter: Column) -> tuple[Column, Column]:
    """(correct, canonical) of a normalised answer against normalised accepted ones and the map of ``choices``."""
    letters = F.forall(accepted, lambda x: x.rlike(r"\A[a-d]\z"))
    missing = F.coalesce(answer, F.lit("")) == ""
    member = F.array_contains(accepted, answer)
    letter, described = (F.regexp_extract(answer, r"(?d)\A([a-d])[.)] (.+)\z", i) for i in (1, 2))
    option = F.array_contains(accepted, letter) & (F.try_element_at(by_letter, letter) == described)
    plain = ~letters | answer.rlike(r"\A[a-d]\z")
    correct = F.when(missing, False).when(plain, member).when(letter != "", F.coalesce(option, F.lit(False))).otherwise(False)
    return correct, F.when(missing, False).otherwise(plain)


def without_terminal(ids: Column, terminals: Column) -> Column:
    """Token ids without at most one terminal at the end."""
    ends = (F.size(ids) > 0) & F.array_contains(terminals, F.try_element_at(ids, F.lit(-1)))
    return F.when(ends, F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)


def without_image_marks(question: Column, mark: str = "<image>") -> Column:
    """A problem's text without the marks that stand for its images."""
    return strip(F.replace(question, F.lit(mark), F.lit("")))


def with_image(turns: Column, text: Column) -> Column:
    """Chat turns with each image item replaced by the text, as a text item."""
    def item(x: Column) -> Column:
        return F.when(x["type"] == "image", F.struct(F.lit("text").alias("type"), text.alias("text"))).otherwise(x)

    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.transform(t["content"], item).alias("content")))


def images_of(turns: Column) -> Column:
    """Number of image items in chat turns."""
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.size(F.filter(t["content"], lambda x: x["type"] == "image")))
