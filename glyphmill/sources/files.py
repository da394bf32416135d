"""Sources: corpora as immutable bytes, prompts, controls and provenance."""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.scan import decoded

PROMPTS = "schema_version string, prompts array<struct<id string, length_band string, category string, target_words string, text string>>"
PROVENANCE = "controls array<struct<control_id string, `class` string, path string, source string, description string, retrieved_utc string, bytes bigint, sha256 string, http_status bigint, generator string, returncode bigint, seed bigint, lines bigint>>"


def corpus(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, grp, item_id, content, text, utf8_valid, decode_error) of files <root>/<grp>/<item>.<suffix>, as bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = raw.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("grp"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("item_id"), "content")
    return decoded(rows, "content")


def strict(docs: DataFrame) -> DataFrame:
    """``docs``, with an error raised on the first one that isn't UTF-8."""
    return docs.where(F.when(F.col("utf8_valid"), True).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("boolean")))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, length_band, category, target_words, text) of a prompts document."""
    doc = spark.read.schema(PROMPTS).option("multiLine", True).json(path)
    return doc.select(F.explode("prompts").alias("p")).select(F.col("p.id").alias("prompt_id"), "p.length_band", "p.category", "p.target_words", "p.text")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVENANCE).option("multiLine", True).json(path).select(F.inline("controls"))


def _numbered(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def random_ascii(spark: SparkSession, lines: int = 400, seed: int = 20260812) -> DataFrame:
    """(line, text): seeded lines of 40 to 100 printable characters, a control without language.

    The order of draws and of the alphabet is a fixed value: with the default seed the lines, joined and ended by LF, are a published control.
    """
    rng, alphabet = random.Random(seed), string.digits + string.ascii_letters + string.punctuation + " "
    return _numbered(spark, ["".join(map(rng.choice, [alphabet] * rng.randint(40, 100))) for _ in range(lines)])


#: Letters and ends of pseudo prose.
ONSETS, NUCLEI, STOPS = "bcdfghjklmnpqrstvwxyz", "aeiou", (".", ".", ".", "?", "!")


def pseudo_prose(spark: SparkSession, count: int = 600, seed: int = 20260813) -> DataFrame:
    """(line, text): seeded sentences of 6 to 20 words of 1 to 4 open syllables, a control with letters but no meaning; the order of draws is a fixed value."""
    rng = random.Random(seed)

    def sentence() -> str:
        syllables = lambda: "".join(rng.choice(sound) for _ in range(rng.randint(1, 4)) for sound in (ONSETS, NUCLEI))
        said = " ".join(syllables() for _ in range(rng.randint(6, 20)))
        return said.capitalize() + rng.choice(STOPS)

    return _numbered(spark, [sentence() for _ in range(count)])


def provenance_record(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(control_id, bytes, sha256) of raw controls."""
    return docs.select(F.col(id_col).alias("control_id"), F.octet_length(content_col).cast("long").alias("bytes"), F.sha2(content_col, 256).alias("sha256"))
