"""Exact deduplication as a stateful stream: disk-backed keyed state, no expiry."""

from __future__ import annotations

import contextlib
import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.hits import digest_slot, filled, key_bits
from kinfold.llm.scratch import bounded_batches, lean, materialise, scratch_path

#: Settings of the state: RocksDB on the executors' disks with bounded memory, change logs in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64())])
BODIES = pa.schema([("digest", pa.binary()), ("body", pa.binary())])


def _normal(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z only


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [_normal(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()), pa.array(map(len, bodies), pa.int64())], schema=DIGESTS)


def _hit_bodies(bits):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [_normal(t) for t in b.column(0).to_pylist()]
            hit = [(d, x) for x in bodies if filled(bits, d := hashlib.sha256(x).digest())]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hit], pa.binary()), pa.array([x for _, x in hit], pa.binary())], schema=BODIES)

    return scan


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):  # noqa: ANN202
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(spark: SparkSession, staged: str, schema, state_dir: str, *, batch_bytes: int = 4 << 30) -> DataFrame:  # noqa: ANN001
    """Stream the staged digests through the keyed state until all that is there is taken, and return the state of
    every key that it has ever touched: ``digest, keep (doc_id, call, loc), group_size``.

    The state holds a digest, the stable identifier of the row that stays, its content locator and the count.  It
    never expires: a later call with the same ``state_dir`` and more files under ``staged`` goes on from there.  A
    micro-batch that is run again writes its folder anew, so a lost executor or driver repeats nothing.
    """
    updates = f"{state_dir}/updates"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with _set(spark, STATE):
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(staged)
        state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "call", "loc")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    kept = "digest binary, keep struct<doc_id: bigint, call: bigint, loc: bigint>, group_size bigint, batch int"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(updates)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):  # no rows yet
        return spark.createDataFrame([], kept).drop("batch")
    seen = spark.read.schema(kept).option("basePath", updates).parquet(updates)
    return seen.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.keep", "s.group_size")


def streaming_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", state_dir: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, call, loc``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.  The row of the largest key stays;
    of rows that share key and text, the latest call's, there the one of the largest locator.  A null key is smaller than
    any other.  Other columns are not looked at; an empty table gives an empty result.

    With a ``state_dir`` later calls go on from the state of earlier ones: groups then count the rows of all calls, and
    ``keep_id`` and ``kept`` say what stays of all rows so far (a row of an earlier call can lose its place to one of
    this call).  The locator ``call, loc`` names the call and the row in it.

    Digests (not texts) are staged in the shared folder and streamed through :func:`keyed_state`.  Then hits among the
    rows at hand are checked by their full bytes: texts whose digest was seen twice are compared whole, pre-aggregated
    where they are read, so that a hot group crosses the shuffle once per task; two texts under one digest stop the
    run.  The bytes of earlier calls are not kept, so a hit against those rests on the digest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    root = state_dir or scratch_path(spark, "exact-dedup")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    staged = source.mapInArrow(lean(_digests), "doc_id long, digest binary, n_bytes long").withColumns({"call": F.lit(time.time_ns()).cast("long"), "loc": F.monotonically_increasing_id()})
    staged = materialise(staged, "exact-dedup-rows")
    staged.write.mode("append").parquet(f"{root}/staged")  # the stream's one source, so that its checkpoint holds
    state = materialise(keyed_state(spark, f"{root}/staged", staged.schema, root), "exact-dedup-state")
    here = staged.groupBy("digest").agg(F.count(F.lit(1)).alias("here"))
    hits = here.where("here > 1").select("digest")
    bodies = source.select("text").mapInArrow(lean(_hit_bodies(key_bits(hits, digest_slot("digest")))), "digest binary, body binary")
    variants = bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"), F.sum("n").alias("copies"))
    odd = (F.col("here") > 1) & ((F.coalesce("bodies", F.lit(0)) != 1) | (F.col("copies") != F.col("here")))
    checked = state.join(here, "digest").join(variants, "digest", "left")
    checked = checked.withColumn("group_size", F.when(odd, F.raise_error(F.lit("texts that differ share a digest"))).otherwise(F.col("group_size"))).select("digest", "keep", "group_size")
    return staged.join(checked, "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", ((F.col("call") == F.col("keep.call")) & (F.col("loc") == F.col("keep.loc"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes", "call", "loc")


def op5_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return streaming_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: A-Z are named one by one: ``lower`` would change other letters too.
SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
