import json

from pyspark.sql import functions as F

from glyphmill.operators import scan
from glyphmill.sources import files, sinks
from glyphmill.streaming.scanner import stream_flags, stream_rates


def test_corpus_prompts_and_provenance(spark, tmp_path):
    (tmp_path / "c" / "m1").mkdir(parents=True)
    (tmp_path / "c" / "m1" / "S01.txt").write_bytes("\ufeffé\r\n".encode())
    (tmp_path / "c" / "m1" / "S02.txt").write_bytes(b"\xff")
    rows = {r.item_id: r for r in files.corpus(spark, f"file://{tmp_path}/c").collect()}
    assert rows["S01"].grp == "m1" and rows["S01"].text == "\ufeffé\r\n" and not rows["S02"].utf8_valid
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": "1.0", "prompts": [{"id": "S01", "length_band": "short", "category": "list", "target_words": "9", "text": "x"}]}))
    assert files.prompts(spark, f"file://{tmp_path}/p.json").first().prompt_id == "S01"
    (tmp_path / "v.json").write_text(json.dumps({"controls": [{"control_id": "c", "class": "k", "bytes": 4}]}))
    assert files.provenance(spark, f"file://{tmp_path}/v.json").first().asDict()["class"] == "k"
    assert files.random_ascii(spark).collect() == files.random_ascii(spark).collect() and files.pseudo_prose(spark).count() == 600


def test_report_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\u200bé".encode())], "id string, content binary")
    reports = scan.reports(docs, "id", "content")
    shown = sinks.report_text(reports.first())
    assert shown.isascii() and "U+200B" in shown and sinks.NOTE in shown
    sinks.write_reports(reports, f"file://{tmp_path}/r")
    line = spark.read.text(f"file://{tmp_path}/r").first().value
    assert line.isascii() and json.loads(line)["header"]["unidata_version"]
    assert sinks.environment(spark).count() == 1 and sinks.source_hashes(spark, f"file://{tmp_path}").count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a\u200bb", "g", "2026-01-01 00:10:00"), (2, "plain", "g", "2026-01-01 00:20:00")], "id int, text string, grp string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(f"file://{src}")
    schema = "id int, text string, grp string, at timestamp"
    stream = spark.readStream.schema(schema).parquet(f"file://{src}")
    for name, df, mode in (("flags", stream_flags(stream, "id", "text"), "append"), ("rates", stream_rates(stream, F.col("grp"), "text", "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.id: r.is_plain for r in spark.table("flags").collect()} == {1: False, 2: True}
    assert [(r.category, r.n) for r in spark.table("rates").collect()] == [("invisible", 1)]
