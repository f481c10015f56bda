"""From sampled token ids to masks: terminal tokens, spans, sections, and the checks that a rollout has to hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import text as T

SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))


def spans_hold(spans: Column, tokens: Column, text: Column) -> Column:
    """Whether spans of (start, end) are one a token, inside the text, and never fall."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: (F.get(spans, i)["start"] >= F.get(spans, i - 1)["start"]) & (F.get(spans, i)["end"] >= F.get(spans, i - 1)["end"]))
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(text)))
    return F.coalesce((F.size(spans) == F.size(tokens)) & inside & ((F.size(spans) < 2) | rising), F.lit(False))


@F.arrow_udf(SPANS)
def _running(pieces: pa.Array) -> pa.Array:
    """Spans of each list's strings, one after another, in characters; of a null list, or one with a null string, null."""
    starts, many = pieces.offsets.to_numpy(), np.diff(pieces.offsets.to_numpy())
    flat = pieces.values.slice(starts[0], starts[-1] - starts[0])
    sizes = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    before = np.concatenate(([0], ends))[starts[:-1] - starts[0]]
    ends = (ends - np.repeat(before, many)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(ends - sizes.astype(np.int32)), pa.array(ends)], ["start", "end"])
    lost = np.zeros(len(flat) + 1, np.int64)
    lost[1:] = np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))
    gone = (lost[starts[1:] - starts[0]] > lost[starts[:-1] - starts[0]]) | pieces.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), spans, mask=pa.array(gone))


def spans_of(pieces: Column, text: Column) -> Column:
    """Spans of the pieces that tokens decode to, if together they are the text; else null, as where one of them is.

    One pass over the pieces of a batch: a running sum has no form in expressions that isn't quadratic in them.
    """
    return F.when(F.array_join(pieces, "") == text, _running(pieces))


def prepared(rows: DataFrame, ids: str, pieces: str, terminals: Column, offsets: str | None = None) -> DataFrame:
    """Adds text, parsed, content_mask, report_mask, vision_mask, content_ids, format_errors and problem.

    pieces: what each token decodes to; offsets: a tokenizer's own spans of the body's tokens, used where they hold. A
    terminal token at the end belongs to the report. Without spans all tokens do, and the errors say so. problem is null,
    or names the rule that is broken: no tokens, masks that don't partition, or content that is no prefix.
    """
    body, own = T.without_terminal(F.col(ids), terminals), ["_body", "_pieces", "_spans", "_masks"]
    rows = rows.withColumn("_body", body).withColumn("_pieces", F.slice(F.col(pieces), 1, F.size("_body")))
    rows = rows.withColumn("text", F.array_join("_pieces", ""))
    rows = T.parse_completions(rows, "text", "parsed")
    spans = spans_of(F.col("_pieces"), F.col("text"))
    if offsets is not None:
        spans = F.when(spans_hold(F.col(offsets), F.col("_body"), F.col("text")), F.col(offsets)).otherwise(spans)
    rows = rows.withColumn("_spans", spans)
    made = T.masks(F.col("_spans"), F.col("parsed.vision_start"), F.col("parsed.vision_end"), F.col("parsed.report_start"))
    none = F.transform("_body", lambda x: F.lit(0))
    closed = F.struct(none.alias("content"), F.transform("_body", lambda x: F.lit(1)).alias("report"), none.alias("vision"))
    rows = rows.withColumn("_masks", F.when(F.col("_spans").isNull(), closed).otherwise(made))
    ends = F.transform(F.slice(F.col(ids), F.size("_body") + 1, F.greatest(F.size(ids) - F.size("_body"), F.lit(0))), lambda x: F.lit(1))
    rows = rows.withColumns({"content_mask": F.concat("_masks.content", F.transform(ends, lambda x: F.lit(0))), "report_mask": F.concat("_masks.report", ends), "vision_mask": F.concat("_masks.vision", F.transform(ends, lambda x: F.lit(0)))})
    many = F.aggregate("content_mask", F.lit(0), lambda n, x: n + x)
    zipped = F.arrays_zip("content_mask", "report_mask", "vision_mask")
    parts = F.forall(zipped, lambda z: (z["content_mask"] + z["report_mask"] == 1) & (z["vision_mask"] <= z["content_mask"]))
    prefix = F.forall(F.slice("content_mask", 1, many), lambda x: x == 1)
    problem = F.when(F.size(ids) == 0, "no tokens").when(~parts | (F.size("content_mask") != F.size(ids)), "masks do not partition").when(~prefix, "content is no prefix")
    errors = F.concat("parsed.format_errors", F.when(F.col("_spans").isNull(), F.array(F.lit("token_spans_unverified"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumns({"content_ids": F.slice(F.col(ids), 1, many), "format_errors": errors, "problem": problem}).drop(*own)
