"""The index as parquet tables of one folder (the key spaces of the original store, one table each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import normalize_url
from spindrift.operators import index as I

#: folders of the postings by a hash of the term: a lookup reads one of them
BUCKETS = 64


class IndexStore:
    """Tables ``documents_idx``, ``corpus_stats``, ``postings``, ``bigrams``, ``vocabulary`` and ``trigrams`` under a folder.

    Each batch of pages is a partition ``batch=...`` of every table and replaces what an earlier try of it left; its
    ``documents_idx``, without which no reader counts its pages, is written last. So a batch may die at any point and be run again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, name: str) -> DataFrame:
        self.exists(name)
        return self.spark.read.option("basePath", self.path(name)).parquet(self.path(name))

    def exists(self, name: str) -> bool:
        """Whether a table is there; one whose replacement was cut short is put right first."""
        fs, p = self._fs(self.path(name))
        if not fs.exists(p):
            _, new = self._fs(self.path(name) + ".new")
            _, done = self._fs(self.path(name) + ".new/_SUCCESS")
            if fs.exists(done):
                fs.rename(new, p)
        return fs.exists(p)

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a new version beside the table, which the new rows may be read from, and then puts it in its place."""
        fs, p = self._fs(self.path(name))
        _, new = self._fs(self.path(name) + ".new")
        df.write.mode("overwrite").parquet(new.toString())
        fs.delete(p, True)
        fs.rename(new, p)

    def write(self, name: str, batch: str, df: DataFrame, *by: str) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{self.path(name)}/batch={batch}")

    def others(self, name: str, batch: str, schema: str) -> DataFrame:
        """The rows of a table but those of one batch; none where there is no table."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.read(name).filter(F.col("batch").cast("string") != batch).drop("batch")

    def bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def documents(self) -> DataFrame | None:
        """``doc_id, url, norm_url, token_count, unique_tokens`` of all indexed pages; None before the first batch."""
        return self.read("documents_idx").drop("batch") if self.exists("documents_idx") else None

    def add(self, urls: DataFrame, passages: DataFrame, batch: str) -> None:
        """Adds pages: ``urls`` has ``doc_id, url``, ``passages`` their passages. Bigrams and statistics are kept as partial counts,
        which a reader sums; ``batch`` names the batch, the same on a retry."""
        once = I.passages_once(passages)
        rows = I.term_rows(once)
        docs = urls.select("doc_id", "url", normalize_url(F.col("url")).alias("norm_url")).join(I.doc_stats(rows), "doc_id")
        postings = I.postings(rows).withColumn("bucket", self.bucket(F.col("term")))
        self.write("postings", batch, postings.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term"), "bucket")
        self.write("bigrams", batch, I.bigrams(once))
        vocabulary = I.vocabulary(once)
        if self.exists("vocabulary"):
            vocabulary = vocabulary.join(self.read("vocabulary").filter(F.col("batch").cast("string") != batch).select("word"), "word", "left_anti")
        self.write("vocabulary", batch, vocabulary)
        self.write("trigrams", batch, I.trigrams(self.spark.read.parquet(f"{self.path('vocabulary')}/batch={batch}")))
        self.write("corpus_stats", batch, docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")))
        self.write("documents_idx", batch, docs)

    def corpus_stats(self) -> DataFrame:
        """OP-39b: number of documents and average length, one row, from the sums of the batches that are complete."""
        done = self.read("documents_idx").select("batch").distinct()
        sums = self.read("corpus_stats").join(done, "batch", "left_semi").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.select("documents", (F.col("tokens") / F.nullif("documents", F.lit(0))).alias("avg_len"))

    def postings_of(self, terms: list[str]) -> DataFrame:
        """OP-40a: only the buckets of the terms are listed, and the filter on terms reaches the scan."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket(F.col("term")).alias("b")).distinct()
        buckets = [r["b"] for r in wanted.collect()]
        return self.read("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("batch")

    def trigrams(self) -> DataFrame:
        return self.read("trigrams").select("tri", "word").distinct()

    def bigrams(self, left: str | None = None, right: str | None = None) -> DataFrame:
        """``w1, w2, freq``; with neighbours only the pairs that begin with ``left`` or end with ``right``, by a filter of the scan."""
        rows = self.read("bigrams")
        if left is not None or right is not None:
            rows = rows.filter((F.col("w1") == F.lit(left)) | (F.col("w2") == F.lit(right)))
        return rows.groupBy("w1", "w2").agg(F.sum("freq").alias("freq"))
