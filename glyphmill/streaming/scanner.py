"""The stateless operators on streams, and windowed rates with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.chartables import flagged_characters

ODD = r"[^\x20-\x7E\t\n\r]"


def stream_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain and ASCII flags, payloads and punctuation of each arriving document; no state."""
    text = F.col(text_col)
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), T.is_ascii(text).alias("is_pure_ascii"), T.is_plain(text).alias("is_plain"), T.tag_payloads(text).alias("payloads"), F.size(T.words(text)).alias("words"), F.size(T.sentences(text)).alias("sentences"))


def stream_rates(docs: DataFrame, group: Column, text_col: str, time_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, grp, category, n): flagged characters by arrival window; events later than ``late`` are left out by the watermark."""
    rows = docs.withWatermark(time_col, late).select(F.window(time_col, window).alias("window"), group.alias("grp"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ODD), F.lit(0))).alias("ch"))
    known = rows.join(F.broadcast(flagged_characters(docs.sparkSession)), "ch", "left").withColumn("category", F.coalesce("rate_bucket", F.lit("other_nonascii")))
    return known.groupBy("window", "grp", "category").agg(F.count(F.lit(1)).alias("n"))
