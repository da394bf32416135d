"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.encode import encode_texts
from glyphmill.llm.lookalike import hidden_pairs, look_classes, uniform_texts
from glyphmill.llm.mixing import Mix, mix_sources
from glyphmill.llm.neardup import near_duplicates
from glyphmill.llm.oracle import oracle_sql
from glyphmill.llm.pairs import pair_defects
from glyphmill.llm.sentences import sentence_units
from glyphmill.llm.spans import SharedSpans, shared_spans
from glyphmill.llm.terms import TermStore
from glyphmill.storage import new_path, read_table

__all__ = ["oracle_sql", "queries"]


def p1_near(spark: SparkSession, folder: str):
    return near_duplicates(read_table(spark, folder, "manifest"), "sample_id", "text", shingle=3, threshold="0.6", min_words=40)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_near(spark, folder).record_pairs().select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    return p1_near(spark, folder).links().withColumnRenamed("id", "sample_id")


def p2_store(spark: SparkSession, folder: str) -> TermStore:
    """The manifest in two batches: what came in by the middle of its time, then the rest, re-recorded rows included."""
    m = read_table(spark, folder, "manifest").select("sample_id", "text", "model_id", "ingested_at")
    at = F.unix_micros("ingested_at")
    lo, hi = m.agg(F.min(at), F.max(at)).first()
    late = F.coalesce(at > F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    store = TermStore(spark, new_path(spark, "terms"), {"text": "words", "model_id": "value"})
    for batch in (m.where(~late), m.where(late)):
        store.apply(batch, "sample_id", latest_by="ingested_at")
    return store


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_store(spark, folder).marked().where("mark is not null").select("field", "value", "mark")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p2_store(spark, folder).counts()


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Counts after three batches: the early rows; the late ones with revisions of many records; deletions, and some revisions taken back."""
    m = read_table(spark, folder, "manifest").select("sample_id", "text", "model_id", F.unix_micros("ingested_at").alias("at"))
    lo, hi = m.agg(F.min("at"), F.max("at")).first()
    late = F.coalesce(F.col("at") > F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(False))
    ends = lambda x: F.col("sample_id").endswith(x)
    revised = m.where(ends("7")).withColumn("text", F.concat(F.lit("revised "), "text")).withColumn("at", F.lit((hi or 0) + 1))
    store = TermStore(spark, new_path(spark, "terms"), {"text": "words", "model_id": "value"})
    store.apply(m.where(~late), "sample_id", latest_by="at")
    store.apply(m.where(late).unionByName(revised), "sample_id", latest_by="at")
    store.apply(m.where(ends("77")), "sample_id", latest_by="at", deleted=m.where(ends("3")).select("sample_id"))
    return store.counts()


def p3_spans(spark: SparkSession, folder: str) -> SharedSpans:
    return shared_spans(read_table(spark, folder, "manifest"), "sample_id", "text", length=200)


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = p3_spans(spark, folder).coverage()
    return c.select(F.col("id").alias("sample_id"), "chars", "shared_chars", F.round("shared_part", 6).alias("shared_part"))


def p3_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and fuzzy passages of pairs of different texts, each text by its hash, the smaller one first."""
    spans = p3_spans(spark, folder)
    name = spans.texts.select("rid", F.lower(F.hex("digest")).alias("md5"))
    p = spans.passages.join(name.withColumnsRenamed({"rid": "rid_a", "md5": "md5_a"}), "rid_a").join(name.withColumnsRenamed({"rid": "rid_b", "md5": "md5_b"}), "rid_b")
    turned = F.col("md5_a") > F.col("md5_b")
    both = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("md5_a", "md5_b"), ("md5_b", "md5_a"), ("a_start", "b_start"), ("a_end", "b_end"), ("b_start", "a_start"), ("b_end", "a_end"))]
    return p.select(*both, "exact")


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The exact passages only: each longest run of a pair of texts."""
    return p3_passages(spark, folder).where("exact").drop("exact")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_spans(spark, folder).stretches().select(F.col("id").alias("sample_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    answers = read_table(spark, folder, "manifest").where("kind = 'model_output'")
    return pair_defects(answers, read_table(spark, folder, "prompts")).found.select(F.col("id").alias("sample_id"), "defect")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    units = sentence_units(read_table(spark, folder, "documents"), "doc_id", "text", "prompt_category")
    return units.select("doc_id", F.col("start").alias("sent_start"), F.col("end").alias("sent_end"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(read_table(spark, folder, "documents"), "doc_id", "text")


def _p7(spark: SparkSession, folder: str) -> Mix:
    return mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder).chosen.select("mix_id", F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _p7(spark, folder).shares()


def p7_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """The mixes with unequal chances: documents of the long band count three times as much as short ones, those without a band half."""
    weight = F.when(F.col("length_band") == "long", 3.0).when(F.col("length_band") == "medium", 2.0).when(F.col("length_band").isNull(), 0.5).otherwise(1.0)
    d = read_table(spark, folder, "documents").withColumn("weight", weight)
    mix = mix_sources(d, read_table(spark, folder, "mix_targets"), weight_col="weight")
    return mix.chosen.select("mix_id", F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return look_classes(read_table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_pairs(read_table(spark, folder, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return uniform_texts(read_table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_counts": p2_counts, "p2_changes": p2_changes, "p3_found": p3_found, "p3_coverage": p3_coverage, "p3_passages": p3_passages, "p3_exact": p3_exact, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_weighted": p7_weighted, "p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes}
