"""Continuous ingest: a stream of passages appended to the index in micro-batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions.urls import normalize_url
from spindrift.operators import index as I
from spindrift.operators import neardup as N
from spindrift.plans.store import IndexStore

PAGE_SCHEMA = "url string, fetched_at timestamp, passages array<struct<text:string,type:string>>"


def page_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Pages of a folder as they arrive; an address seen within the delay is dropped, so the state stays bounded."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(folder).filter("url is not null").withColumn("norm_url", normalize_url(F.col("url")))
    return pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["norm_url"])


def index_batch(store: IndexStore, batch: DataFrame, name: str) -> None:
    """One micro-batch into the store under its name; a batch that died may be run again by the same name.

    Addresses that other batches indexed are left out, and so are pages too similar to one indexed or to an earlier one of the
    batch (OP-37); a page without terms is not indexed. The quality gate needs features that a stream of passages does not have.
    """
    others = store.others("documents_idx", name, "norm_url string").select("norm_url")
    new = batch.join(others, "norm_url", "left_anti").withColumn("doc_id", F.sha2("norm_url", 256)).dropDuplicates(["doc_id"])
    passages = new.select("doc_id", F.posexplode("passages").alias("pos", "p")).select("doc_id", "pos", "p.text", F.col("p.type").alias("ptype"))
    words = I.page_words(I.passages_once(passages))
    signatures = N.signatures(words)
    near = N.similar_to(signatures, store.others("signatures", name, "doc_id string, sig array<int>")).select("doc_id")
    kept = new.join(near, "doc_id", "left_anti")
    store.write("signatures", name, signatures.join(near, "doc_id", "left_anti"))
    store.add(kept.select("doc_id", "url"), passages.join(kept.select("doc_id"), "doc_id", "left_semi"), name)


def start(spark: SparkSession, folder: str, store: IndexStore, checkpoint: str) -> StreamingQuery:
    stream = page_stream(spark, folder)
    # batches are numbered within a checkpoint, so its name is part of theirs
    of = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.foreachBatch(lambda batch, n: index_batch(store, batch, f"{of}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
