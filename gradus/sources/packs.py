"""The protocol of token packs: each pack's bytes, rows and ids against the manifest of the run that prepared it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import rules_table, type_of


def told(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads (label, mode, status, version, prompts_sha256, pack_sha256, rows) and ids (label, place, example_id) of manifests (label, doc).

    A field that is missing or of another type is null; ids that are no list of texts give no rows. A manifest is one JSON
    value, so its list of ids is as long as one row can be.
    """
    text = lambda field: F.when(type_of(F.col("doc"), field) == "STRING", F.try_variant_get("doc", f"$.{field}", "string"))
    rows = F.when(type_of(F.col("doc"), "selected_count") == "BIGINT", F.try_variant_get("doc", "$.selected_count", "bigint"))
    names = {"mode": "mode", "status": "status", "version": "proxy_output_protocol", "prompts_sha256": "proxy_prompt_source_sha256", "pack_sha256": "tokenpack_sha256"}
    heads = manifests.select("label", *[text(field).alias(name) for name, field in names.items()], rows.alias("rows"))
    ids = F.when(type_of(F.col("doc"), "selected_ids") == "ARRAY<STRING>", F.try_variant_get("doc", "$.selected_ids", "array<string>"))
    listed = manifests.select("label", F.posexplode(ids).alias("place", "example_id"))
    return heads, listed.withColumn("place", F.col("place").cast("long"))


def protocol_problems(packs: DataFrame, digests: DataFrame, heads: DataFrame, ids: DataFrame, version: str, prompts_sha256: str) -> DataFrame:
    """(label, place, rule) for each rule that a pack breaks, with a null place for those of the pack as a whole.

    packs: (label, place, doc), rows numbered from 0; digests: (label, sha256) of the packs' files; heads and ids as of
    ``told``. A line that is no JSON (a null doc) breaks all rules of rows. A pack without a manifest, or a manifest
    without a pack, breaks those that compare the two; a place that only one of them has breaks that of ids. Rows meet
    their ids by place, so a large pack is shuffled evenly.
    """
    counts = packs.groupBy("label").agg(F.count("*").alias("_n"))
    whole = heads.join(digests.select("label", "sha256"), "label", "full_outer").join(counts, "label", "left")
    found = rules_table(
        whole, "label",
        {
            "manifest is of a completed preparation": (F.col("mode") == "prepare") & (F.col("status") == "completed"), "manifest has the version": F.col("version") == version,
            "manifest has the prompts' digest": F.col("prompts_sha256") == prompts_sha256, "pack has the manifest's digest": F.col("pack_sha256") == F.col("sha256"),
            "manifest has the number of rows": F.col("rows") == F.coalesce("_n", F.lit(0)),
        },
    )
    doc = F.col("doc")
    text = lambda field: F.when(type_of(doc, field) == "STRING", F.try_variant_get(doc, f"$.{field}", "string"))
    errors = F.try_variant_get(doc, "$.format_errors", "array<variant>")
    rules = {
        "row has the version": text("proxy_output_protocol") == version, "row has the prompts' digest": text("proxy_prompt_source_sha256") == prompts_sha256,
        "reason_text is text or null": type_of(doc, "reason_text").isin("STRING", "VOID"), "format_errors are texts": F.forall(errors, lambda x: F.schema_of_variant(x) == "STRING"),
        "prompt digest is SHA-256": text("prompt_token_sha256").rlike(r"^[0-9a-f]{64}\z"),
    }
    at = F.struct("label", "place").alias("at")
    rows = rules_table(packs, at, rules)
    both = packs.select("label", "place", text("example_id").alias("_own")).join(ids, ["label", "place"], "full_outer")
    rows = rows.unionAll(rules_table(both, at, {"id is the manifest's at its place": F.col("_own") == F.col("example_id")}))
    return found.select("label", F.lit(None).cast("long").alias("place"), "rule").unionAll(rows.select("at.label", "at.place", "rule"))
