"""Digests of canonical JSON, and flattening of nested reports."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType


#: Ids of a list that is put in one line after another.
MOST_LISTED = 100_000


def canonical(text: str | None, compact: bool = False) -> str | None:
    """JSON with sorted keys, in plain spacing or compact; null for null."""
    if text is None:
        return None
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":") if compact else None)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts: sorted keys, a space after each comma and colon."""
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(StringType())
def canonical_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form. Spark's own JSON is compact and in column order, so its bytes differ."""
    return texts.map(lambda t: hashlib.sha256(canonical(t).encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def compact_sha256(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(canonical(t, True).encode()).hexdigest(), na_action="ignore")


def pixel_sha256(width: Column, height: Column, pixels: Column) -> Column:
    """SHA-256 of an RGB image: its size in a header, then the bytes of its pixels."""
    return F.sha2(F.concat(F.concat(F.lit("RGB:"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":")).cast("binary"), pixels), 256)


def tensor_sha256(tensors: Column) -> Column:
    """SHA-256 of named tensors, an array of (key, dtype, shape, bytes), in order of their keys.

    Each has a header of JSON with its key, kind and shape, and its bytes; both come after their length in eight bytes.
    """
    def sized(part: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(part)), 16, "0")), part)

    def one(t: Column) -> Column:
        shape = F.concat(F.lit("["), F.array_join(F.transform(t["shape"], lambda n: n.cast("string")), ","), F.lit("]"))
        header = F.concat(F.lit('{"dtype":"'), t["dtype"], F.lit('","key":"'), t["key"], F.lit('","shape":'), shape, F.lit("}"))
        return F.concat(sized(header.cast("binary")), sized(t["bytes"]))

    return F.sha2(F.aggregate(F.array_sort(tensors), F.lit(b""), lambda out, t: F.concat(out, one(t))), 256)


def listed_sha256(rows: DataFrame, order: str, value: str) -> DataFrame:
    """One row: SHA-256 of the values in order, one a line, of a frozen subset's ids: over MOST_LISTED are refused."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    few = rows.limit(MOST_LISTED + 1).agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
    return few.withColumn("sha256", F.when(F.col("n") <= MOST_LISTED, F.col("sha256")).otherwise(F.raise_error(F.lit(f"a list has at most {MOST_LISTED} ids"))))


def scalars(rows: DataFrame) -> dict[str, Column]:
    """Numbers within nested structs by their path, a/b/c; other kinds are left out."""
    out: dict[str, Column] = {}

    def walk(kind: StructType, at: Column, path: str) -> None:
        for f in kind:
            if isinstance(f.dataType, StructType):
                walk(f.dataType, at[f.name], f"{path}{f.name}/")
            elif isinstance(f.dataType, NumericType) and not isinstance(f.dataType, ArrayType):
                out[f"{path}{f.name}"] = at[f.name].cast("double")

    for f in rows.schema:
        if isinstance(f.dataType, StructType):
            walk(f.dataType, F.col(f.name), f"{f.name}/")
        elif isinstance(f.dataType, NumericType):
            out[f.name] = F.col(f.name).cast("double")
    return out


def flattened(rows: DataFrame, keep: str) -> DataFrame:
    """(keep, key, value) of the finite numbers of each row's nested structs."""
    pairs = [F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in scalars(rows.drop(keep)).items()]
    long = rows.select(keep, F.explode(F.array(*pairs)).alias("x")).select(keep, "x.key", "x.value")
    return long.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
