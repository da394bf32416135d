"""Self-verifying manifest records and the joins with their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T


def make_records(docs: DataFrame, id_col: str, content_col: str, kind: str, *extra: Column) -> DataFrame:
    """(sample_id, kind, sha256, bytes_len, content_b64, text, decodes_as_utf8, extra columns) of raw bytes."""
    content = F.col(content_col)
    valid = F.is_valid_utf8(content.cast("string"))
    return docs.select(F.col(id_col).cast("string").alias("sample_id"), F.lit(kind).alias("kind"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes_len"), T.base64(content).alias("content_b64"), F.when(valid, content.cast("string")).alias("text"), valid.alias("decodes_as_utf8"), *extra)


def union_kinds(*kinds: DataFrame) -> DataFrame:
    """Records of several kinds; columns that a kind lacks are null."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def verification(records: DataFrame) -> DataFrame:
    """(sample_id, sha_ok, length_ok, text_ok): what comes out again from the stored bytes. Null columns are no violation."""
    raw = F.try_to_binary("content_b64", F.lit("base64"))
    text_ok = F.when(F.col("decodes_as_utf8"), F.col("text") == raw.cast("string")).otherwise(F.col("text").isNull())
    return records.select("sample_id", (F.sha2(raw, 256) == F.col("sha256")).alias("sha_ok"), (F.octet_length(raw) == F.col("bytes_len")).alias("length_ok"), text_ok.alias("text_ok"))


def violations(records: DataFrame) -> DataFrame:
    """One row: records, and how many fail each check; all three must be 0."""
    bad = lambda c: F.coalesce(F.sum((~F.coalesce(F.col(c), F.lit(False))).cast("int")), F.lit(0)).cast("long")
    return verification(records).agg(F.count(F.lit(1)).alias("records"), bad("sha_ok").alias("bad_sha"), bad("length_ok").alias("bad_length"), bad("text_ok").alias("bad_text"))


def verified(records: DataFrame) -> DataFrame:
    """``records``, with an error raised on the first one that doesn't reproduce."""
    raw = F.try_to_binary("content_b64", F.lit("base64"))
    ok = (F.sha2(raw, 256) == F.col("sha256")) & (F.octet_length(raw) == F.col("bytes_len"))
    return records.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("record does not reproduce: "), F.col("sample_id"))).cast("boolean")))


def latest(records: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row for each id: that with the largest order value (nulls lowest)."""
    others = [c for c in records.columns if c not in (id_col, order_col)]
    row = F.max(F.struct(F.col(order_col), *map(F.col, others))).alias("_x")
    return records.groupBy(id_col).agg(row).select(id_col, *(F.col(f"_x.{c}").alias(c) for c in (order_col, *others)))


def clean_id(column: Column) -> Column:
    """Without stray blanks, in upper case."""
    return F.upper(T.strip(column))


def with_prompts(records: DataFrame, prompts: DataFrame, how: str = "left") -> DataFrame:
    """Records with their prompt's band, category and target; unknown prompts stay with nulls (``left``) or go (``inner``)."""
    dim = prompts.select(F.col("prompt_id").alias("_p"), F.col("length_band").alias("prompt_band"), F.col("category").alias("prompt_category_of"), "target_words")
    return records.join(dim, clean_id(F.col("prompt_id")) == F.col("_p"), how).drop("_p")


def with_provenance(records: DataFrame, provenance: DataFrame, by: str = "path") -> DataFrame:
    """Control records with class, source and description, joined by path or control_id; defaults where there is no entry."""
    dim = provenance.select(F.col(by).alias("_by"), F.col("class").alias("control_class"), F.col("source").alias("control_source"), F.col("description").alias("control_description"))
    rows = records.join(dim, F.col(by) == F.col("_by"), "left").drop("_by")
    return rows.withColumn("control_class", F.coalesce("control_class", F.lit("unknown"))).withColumn("control_source", F.coalesce("control_source", F.lit(""))).withColumn("control_description", F.coalesce("control_description", F.lit("")))
