"""Published figures of a corpus, in folders <group>/<item>.txt, by group in the order of names. The settings name the corpus and its prompts."""

import os

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import lexical, resample, scan, sequence
from glyphmill.sources import files

CORPUS, PROMPTS = os.environ.get("GLYPHMILL_CORPUS", ""), os.environ.get("GLYPHMILL_PROMPTS", "")
pytestmark = pytest.mark.skipif(not (os.path.isdir(CORPUS) and os.path.isfile(PROMPTS)), reason="no corpus given")


@pytest.fixture(scope="module")
def docs(spark):
    prompts = files.prompts(spark, f"file://{PROMPTS}").select(F.col("prompt_id").alias("item_id"), F.col("category").alias("prompt_category"))
    return files.corpus(spark, f"file://{CORPUS}").join(prompts, "item_id").select("grp", "item_id", "text", "prompt_category").cache()


def by_group(df):
    return [r for r in df.orderBy("grp").collect()]


def test_sizes_sentences_and_vocabulary(docs):
    prose = docs.where(~F.col("prompt_category").isin(*lexical.NOT_PROSE))
    sizes = by_group(lexical.sample_sizes(docs, F.col("grp"), ~F.col("prompt_category").isin(*lexical.NOT_PROSE)))
    assert [(r.chars, r.words, r.prose_chars, r.prose_sentences) for r in sizes] == [(110262, 17134, 71465, 634), (113705, 15781, 80713, 839), (125943, 19585, 82799, 734), (107135, 16562, 69188, 403)]
    s = by_group(lexical.sentence_statistics(prose, F.col("grp"), "item_id"))
    assert [(round(r.mean, 2), round(r.sd, 2), r.median, round(r.skewness, 2)) for r in s] == [(18.79, 13.26, 17, 0.65), (13.87, 6.86, 13, 0.64), (18.90, 13.06, 17, 0.75), (28.06, 17.64, 28, 0.41)]
    assert [round(r.bits_per_char, 3) for r in by_group(lexical.entropy(docs, F.col("grp")))] == [4.620, 4.588, 4.583, 4.589]
    v = by_group(lexical.vocabulary(docs, F.col("grp")))
    assert [(round(r.mean_word_length, 2), round(r.ttr, 3)) for r in v] == [(4.81, 0.263), (5.65, 0.243), (4.84, 0.240), (4.95, 0.247)]
    assert [round(r.ttr, 3) for r in by_group(lexical.matched_vocabulary(docs, F.col("grp"), "item_id", F.lit(True)))] == [0.268, 0.243, 0.250, 0.248]
    terms = by_group(lexical.marker_rates(docs, F.col("grp")).where("term = 'COMBINED'"))
    assert [round(r.rate_per_1000, 3) for r in terms] == [0.292, 1.457, 0.255, 0.423]


def test_punctuation_and_hidden_characters(docs):
    p = lexical.punctuation(docs, {"grp": F.col("grp")})
    assert [r.n for r in by_group(p.where("category = 'comma'"))] == [1529, 1051, 1500, 1400] and [r.n for r in by_group(p.where("category = 'em_dash'"))] == [12, 7, 15, 3]
    assert scan.pooled_hidden(docs, "text").select("hidden", F.round("wilson_upper_per_1k_chars", 4).alias("u")).first() == (0, 0.0084)
    keyed = docs.withColumn("key", F.concat_ws("/", "grp", "item_id"))
    t = scan.bucket_totals(keyed, "key", "text").where("bucket = 'typographic'").groupBy(F.substring_index("id", "/", 1).alias("grp")).agg(F.sum("occurrences").alias("n"))
    assert [r.n for r in by_group(t)] == [96, 39, 110, 42]


def test_nominal_hits_of_the_batteries(docs):
    """In exact mode, with the published order of draws."""
    seqs = sequence.sentence_sequences(docs.where(~F.col("prompt_category").isin(*lexical.NOT_PROSE)), "item_id", "text", "grp")
    tests = resample.lag_battery(seqs, sequence.LAGS, mode="exact").groupBy("grp").agg(F.sum((F.col("p_value") < 0.05).cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))
    assert [(r.hits, r.n) for r in by_group(tests)] == [(7, 70), (3, 75), (8, 72), (4, 68)]
    gaps = resample.gap_battery(sequence.marker_gaps(docs, F.col("grp"), "item_id"), sequence.PERIODS, mode="exact")
    assert [r.hits for r in by_group(gaps.groupBy("grp").agg(F.sum((F.col("p_value") < 0.05).cast("int")).alias("hits")))] == [10, 4, 7, 7]
