"""A table of mentions that batches are merged into: read by touched buckets, switched from version to version as a whole.

Rows lie in buckets of their keys, and an index (tenant, digest of the normalised text, keys) in buckets of the digest.  A batch
reads the buckets that its own keys and digests fall in, and no others.  It writes them anew into a folder of its own
number; then a manifest, of one line a bucket, says from which folder each bucket comes.  Readers follow the last whole
manifest, so a run that is lost anywhere before it leaves the version before in place, and a batch that is replayed starts from
the version before its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.dedup import keep_first, upsert


@dataclass
class MentionStore:
    path: str
    keys: list[str]
    tenant: str = "user_id"
    text: str = "text"
    buckets: int = 64
    _kinds: tuple[str, str] = field(default=("rows", "index"), init=False)

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[tuple[str, int], int]:
        """(kind, bucket) -> number of the batch that wrote it, as of the last whole version, or the last before a batch."""
        try:  # a folder whose job didn't end has no rows that Spark lists
            lines = spark.read.schema("kind string, bucket int, written long, version long").parquet(f"{self.path}/manifest")
            lines = lines if before is None else lines.where(F.col("version") < before)
            last = lines.agg(F.max("version")).first()[0]
        except AnalysisException:
            last = None
        return {} if last is None else {(r.kind, r.bucket): r.written for r in lines.where(F.col("version") == last).collect()}  # two a bucket

    def _read(self, spark: SparkSession, manifest: dict, kind: str, schema, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/written={n}/bucket={b}" for (k, b), n in sorted(manifest.items()) if k == kind and (only is None or b in only)]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*paths)

    def schema(self, spark: SparkSession) -> object:
        return spark.read.parquet(f"{self.path}/rows").drop("bucket", "written").schema

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of the last version."""
        return self._read(spark, self.manifest(spark), "rows", self.schema(spark))

    def _bucket(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int, order: list[str]) -> None:
        """Merges a batch: rows with known keys update theirs (null updates nothing); others enter unless their tenant has the
        text already, or an earlier row of the batch has it.  Empty texts are no duplicates.  Of rows with equal keys the
        first in ``order`` holds."""
        spark = batch.sparkSession
        manifest = self.manifest(spark, before=number)
        digest = F.sha2(normalize_text(F.col(self.text)), 256)
        fresh = keep_first(batch, self.keys, order).withColumns({"bucket": self._bucket(*self.keys), "_digest": F.when(normalize_text(F.col(self.text)) != "", digest)})
        fresh = fresh.withColumn("_place", self._bucket("_digest")).persist()
        touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}  # of so many buckets at most
        schema = batch.schema
        stored = self._read(spark, manifest, "rows", schema, touched)
        kinds = dict(batch.dtypes)
        index_schema = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys((self.tenant, *self.keys))) + ", digest string"
        digests = stored.select(*self.keys, F.when(normalize_text(F.col(self.text)) != "", digest).alias("_digest"))
        old = digests.join(fresh.select(*self.keys), self.keys, "left_semi")
        places = {r[0] for r in fresh.select("_place").union(old.select(self._bucket("_digest"))).distinct().collect()}
        index = self._read(spark, manifest, "index", index_schema, places)

        slim = fresh.select(*dict.fromkeys((*self.keys, self.tenant, *order, "_digest")))  # rows are chosen without their texts
        known = slim.join(stored.select(*self.keys), self.keys, "left_semi")
        unseen = slim.join(stored.select(*self.keys), self.keys, "left_anti")
        unseen = unseen.join(index.select(self.tenant, F.col("digest").alias("_digest")).distinct(), [self.tenant, "_digest"], "left_anti")
        named = unseen.where("_digest is not null")
        unseen = keep_first(named, [self.tenant, "_digest"], order).unionByName(unseen.where("_digest is null"))
        chosen = known.unionByName(unseen).select(*(F.col(k).alias(f"_chosen_{k}") for k in self.keys))
        equal = reduce(Column.__and__, (fresh[k].eqNullSafe(chosen[f"_chosen_{k}"]) for k in self.keys))
        incoming = fresh.join(chosen, equal, "left_semi").select(*batch.columns).persist()

        rows = upsert(stored, incoming, self.keys).select(*batch.columns)
        written = f"written={number}"
        rows.withColumn("bucket", self._bucket(*self.keys)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{written}")
        now = spark.read.schema(schema).parquet(f"{self.path}/rows/{written}").where(normalize_text(F.col(self.text)) != "")
        entries = now.select(*dict.fromkeys((self.tenant, *self.keys)), digest.alias("digest")).join(incoming.select(*self.keys), self.keys, "left_semi")
        entries = entries.select(*dict.fromkeys((self.tenant, *self.keys)), "digest")
        kept = index.join(incoming.select(*self.keys), self.keys, "left_anti").unionByName(entries)
        kept.withColumn("bucket", self._bucket("digest")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/index/{written}")
        changed = dict.fromkeys([("rows", b) for b in touched] + [("index", b) for b in places], number)
        present = {(kind, r.bucket) for kind in self._kinds for r in spark.read.option("basePath", f"{self.path}/{kind}/{written}").schema("bucket int").parquet(f"{self.path}/{kind}/{written}").distinct().collect()}
        kept_lines = {k: n for k, n in manifest.items() if k not in changed}
        self.commit(spark, kept_lines | {k: n for k, n in changed.items() if k in present}, number)
        fresh.unpersist()
        incoming.unpersist()

    def commit(self, spark: SparkSession, manifest: dict[tuple[str, int], int], number: int) -> None:
        """Makes a version the last one: its lines are one small file, which appears when its job commits."""
        lines = [(kind, bucket, n) for (kind, bucket), n in manifest.items()]
        spark.createDataFrame(lines, "kind string, bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")
