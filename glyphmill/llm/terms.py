"""Occurrences and record counts of every distinct value or word, kept up to date by signed deltas.

A store holds counts in hash partitions and the records they come from, each as a whole and layers since. A
batch of records is compared with the store by id and digest; only added, changed and deleted records are
read for terms. Their old terms count -1, their new ones +1; the sums are a layer of the next version, so a
batch writes and shuffles what it changes. Layers are merged into the whole when together they have half as
many rows as it, which keeps reading cheap and rewrites each row a few times at most as the store grows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.words import JAVA_WORD
from glyphmill.storage import remove

#: The pseudo-field under which the number of live records is kept.
ALL = ""
COUNTS = "field string, value string, occurrences long, records long, bucket int"


def words_of(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(JAVA_WORD), F.lit(0))


@dataclass
class TermStore:
    """``fields`` maps each column to ``"words"`` (lower-cased words of a text) or ``"value"`` (the value as written).

    ``bucket_rows``: about so many counts lie in one of the partitions of the whole, ``buckets`` of them at least.
    """

    spark: SparkSession
    path: str
    fields: dict[str, str]
    buckets: int = 8
    bucket_rows: int = 1_000_000
    version: int = field(default=0)

    def __post_init__(self) -> None:
        if bad := set(self.fields.values()) - {"words", "value"}:
            raise ValueError(f"unknown kind of field: {sorted(bad)}")
        step = 1
        while self._there(f"versions/{step}"):  # a layer without it is left over from a batch that broke off
            self.version, step = step, step + 1

    def _there(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _columns(self) -> list[str]:
        return [f"v{k}" for k in range(len(self.fields))]

    def _whole(self, name: str) -> int:
        """The latest version at which ``name`` was written as a whole."""
        return next((v for v in range(self.version, 0, -1) if self._there(f"{name}/whole/{v}")), 0)

    def _paths(self, name: str) -> list[tuple[int, str]]:
        """The whole and the layers since, by version."""
        whole = self._whole(name)
        return [(v, f"{self.path}/{name}/{'whole' if v == whole else 'layer'}/{v}") for v in range(max(1, whole), self.version + 1)]

    def _records(self) -> DataFrame | None:
        """The live records: of each id the row of the latest version, unless that deleted it."""
        layers = [self.spark.read.parquet(path).withColumn("version", F.lit(v)) for v, path in self._paths("records")]
        if not layers:
            return None
        whole = functools.reduce(DataFrame.unionByName, layers)
        if len(layers) > 1:
            whole = whole.join(whole.groupBy("id").agg(F.max("version").alias("version")), ["id", "version"])
        return whole.where("not gone").drop("version", "gone", "had")

    def _merged(self) -> DataFrame:
        layers = [self.spark.read.schema(COUNTS).parquet(path).drop("bucket") for _, path in self._paths("counts")]
        if len(layers) == 1:
            return layers[0]
        both = functools.reduce(DataFrame.unionByName, layers)
        sums = both.groupBy("field", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return sums.where((F.col("records") != 0) | (F.col("field") == ALL))

    def counts(self) -> DataFrame:
        """(field, value, occurrences, records) of the present version."""
        if not self.version:
            return self.spark.createDataFrame([], COUNTS).drop("bucket")
        return self._merged().where(F.col("field") != ALL)

    def total(self) -> int:
        """Number of live records, those without any value included."""
        paths = [path for _, path in self._paths("counts")]
        if not paths:
            return 0
        return self.spark.read.schema(COUNTS).parquet(*(f"{p}/bucket=-1" for p in paths)).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    def _signed_terms(self, signed: DataFrame) -> DataFrame:
        """(field, value, occurrences, records) changes of (sign, v0, v1 ...). Both are counted inside a record, so only sums are shuffled."""
        kinds = list(self.fields.values())

        def terms(c: str, kind: str, k: int):
            found = F.transform(words_of(F.col(c)), F.lower) if kind == "words" else F.array(F.col(c))
            one = lambda v, n, m: F.struct(F.lit(k).alias("k"), v.alias("value"), n.alias("n"), m.alias("m"))
            every, none = F.coalesce(found, F.array().cast("array<string>")), F.lit(0)
            return F.concat(F.transform(every, lambda v: one(v, F.col("sign"), none)), F.transform(F.array_distinct(every), lambda v: one(v, none, F.col("sign"))))

        rows = signed.select(F.explode(F.concat(*(terms(c, kind, k) for k, (c, kind) in enumerate(zip(self._columns(), kinds))))).alias("x")).select("x.*").where("value is not null")
        sums = rows.groupBy("k", "value").agg(F.sum("n").alias("occurrences"), F.sum("m").alias("records"))
        names = F.array(*map(F.lit, self.fields))
        changes = sums.where("occurrences <> 0 or records <> 0").select(names[F.col("k")].alias("field"), "value", "occurrences", "records")
        live = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("records"))
        return changes.unionByName(live.select(F.lit(ALL).alias("field"), F.lit("").alias("value"), F.col("records").alias("occurrences"), "records"))

    def _write_counts(self, counts: DataFrame, buckets: int, path: str) -> None:
        """In ``buckets`` hash partitions; the number of records lies apart."""
        bucket = F.when(F.col("field") == ALL, F.lit(-1)).otherwise(F.pmod(F.xxhash64("field", "value"), F.lit(buckets)).cast("int"))
        counts.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def compact(self, always: bool = True) -> None:
        """Merge layers into the whole, of counts and of records; unless ``always``, only where they have half as many rows as it."""
        for name in ("counts", "records"):
            paths = self._paths(name)
            if len(paths) < 2:
                continue
            sizes = [self.spark.read.parquet(path).count() for _, path in paths]  # from the files' ends
            if not always and 2 * sum(sizes[1:]) < sizes[0]:
                continue
            target = f"{self.path}/{name}/whole/{self.version}"
            if name == "counts":
                self._write_counts(self._merged(), max(self.buckets, -(-sum(sizes) // self.bucket_rows)), target)
            else:
                self._records().withColumn("gone", F.lit(False)).withColumn("had", F.lit(False)).write.mode("overwrite").option("compression", "zstd").parquet(target)
            for _, path in paths:
                remove(self.spark, path)

    def apply(self, batch: DataFrame, id_col: str, *, latest_by: str | None = None, deleted: DataFrame | None = None) -> None:
        """Merge a batch of added or changed records, and ids (a column named as ``id_col``) of deleted ones.

        Of rows that share an id the one with the largest ``latest_by`` holds (nulls lowest, ties by
        digest). Rows with a null id are left out. An unchanged record changes nothing; null fields have
        no terms, but the record counts in the total. A batch that changes nothing still makes a version.
        """
        values = [F.col(c).alias(v) for v, c in zip(self._columns(), self.fields)]
        order = F.col(latest_by) if latest_by else F.lit(0)
        rows = batch.select(F.col(id_col).alias("id"), order.alias("at"), *values).where("id is not null")
        digest = F.md5(F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), F.col(v)), F.lit("-")) for v in self._columns())))
        new = rows.withColumn("digest", digest).groupBy("id").agg(F.max(F.struct("at", "digest", *self._columns())).alias("x")).select("id", "x.digest", *(f"x.{v}" for v in self._columns()))
        gone = deleted.select(F.col(id_col).alias("id")).where("id is not null").distinct() if deleted is not None else None
        if gone is not None:
            new = new.join(gone, "id", "left_anti")
        here, target = self._records(), self.version + 1
        kind = "layer" if self.version else "whole"
        where = f"{self.path}/records/{kind}/{target}"
        if here is None:
            new.withColumn("gone", F.lit(False)).withColumn("had", F.lit(False)).write.mode("overwrite").option("compression", "zstd").parquet(where)
            signed = self.spark.read.parquet(where).select(F.lit(1).alias("sign"), *self._columns())
        else:
            known = here.select("id", F.col("digest").alias("held"))
            fresh = new.join(known, "id", "left").where("held is null or held <> digest")
            fresh = fresh.select("id", "digest", *self._columns(), F.lit(False).alias("gone"), F.col("held").isNotNull().alias("had"))
            if gone is not None:
                lost = gone.join(known.select("id"), "id", "left_semi").select("id", F.lit(None).cast("string").alias("digest"), *(F.lit(None).cast("string").alias(v) for v in self._columns()), F.lit(True).alias("gone"), F.lit(True).alias("had"))
                fresh = fresh.unionByName(lost)
            fresh.write.mode("overwrite").option("compression", "zstd").parquet(where)
            touched = self.spark.read.parquet(where)
            plus = touched.where("not gone").select(F.lit(1).alias("sign"), *self._columns())
            signed = plus
            if touched.where("had").limit(1).count():  # else no old texts need to be read
                minus = here.join(touched.where("had").select("id"), "id", "left_semi").select(F.lit(-1).alias("sign"), *self._columns())
                signed = plus.unionByName(minus)
        self._write_counts(self._signed_terms(signed), self.buckets, f"{self.path}/counts/{kind}/{target}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/versions/{target}")  # from here on the version holds
        self.version = target
        self.compact(always=False)

    def marked(self, *, rare_max: int = 2, common_share: float = 0.2) -> DataFrame:
        """Counts with ``mark``: ``rare`` if at most ``rare_max`` records hold the value, ``common`` if more than
        ``common_share`` of all do, null otherwise; rare goes before common."""
        mark = F.when(F.col("records") <= rare_max, "rare").when(F.col("records") > common_share * F.lit(self.total()), "common")
        return self.counts().withColumn("mark", mark)
