"""Shuffled shards by a two-pass external shuffle.

Pass one scatters every record into one of many memory-sized buckets by a seeded hash of its identity; further
copies of a record inside an input partition are told apart by their number, so that a bucket's size doesn't
depend on hot sources, keys or copies.  Pass two loads one bucket at a time, applies a seeded Fisher-Yates
shuffle and writes it.  Buckets follow each other, so a record's global place is the count of the buckets before
it plus its place inside, and shards are equal runs of global places: the law is ``rows``, any two shards differ
by at most one record.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sedimenta.llm.common import own_columns, shared_dir, sliced, stored, table

SEED = 20240601
BUCKET_BYTES = 24 << 20
BROADCAST_BUCKETS = 200_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of ``n`` places, fixed by seed and bucket."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    # the generator's own shuffle is the Fisher-Yates walk from the end, in C
    rng.shuffle(order)
    return order


def scattered(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``rows``, whose last column ``h`` names a record, with a ``bucket``: by ``h``, further copies also by a number.

    The first of equal records in an input partition goes by its name alone, the k-th by partition and k.
    Equal records can stand in for each other, so the buckets of a partition don't depend on the order of its
    rows.  A task remembers the names of its partition (about 100 bytes a row).
    """
    names = [*rows.columns, "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = (TaskContext.get().partitionId() + 1) << 32
        for batch in sliced(batches):
            copies = []
            for h in batch.column(batch.num_columns - 1).to_pylist():
                k = seen[h] = seen.get(h, -1) + 1
                copies.append(part + k if k else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int64())], names=names)

    rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("copy", LongType())]))
    by_name, by_copy = F.xxhash64("h", F.lit(seed)), F.xxhash64("h", F.lit(seed), "copy")
    return rows.withColumn("bucket", F.pmod(F.when(F.col("copy") == 0, by_name).otherwise(by_copy), F.lit(buckets)).cast("int"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs(doc_id, text)`` as Parquet under ``path`` with columns bucket, place, doc_id, text, shard, slot.

    A bucket's records are put in order of (doc_id, hash of the text) before the shuffle, so the outcome
    doesn't depend on arrival order, copies apart, and a lost task can run again.  Of equal records a bucket
    holds no more than one from each input partition, and others by chance.  The input is read twice in the same
    partitions; one that comes from a shuffle is stored first.  Null texts stay null; null doc_ids are a value
    like any other; an empty table writes no records.
    """
    spark = docs.sparkSession
    docs = own_columns(docs, doc_id="doc_id", text="text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "shard-input")
    rows = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("bytes")).first().bytes or 0
    buckets = max(1, -(-size // bucket_bytes))

    # one count a bucket; the number of buckets is the input over a constant
    counts = {r.bucket: r.n for r in scattered(rows.select("h"), buckets, seed).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    rows = scattered(rows, buckets, seed)
    starts, total = [], 0
    for b in range(buckets):
        starts.append((b, total))
        total += counts.get(b, 0)
    small, large = divmod(total, shards)  # the first `large` shards hold one more
    edge = large * (small + 1)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            order = fisher_yates(whole.num_rows, seed, bucket)
            place = pa.array(np.arange(whole.num_rows), pa.int64())
            for at in range(0, whole.num_rows, 1024):
                part = whole.select(["bucket", "doc_id", "text"]).take(pa.array(order[at : at + 1024])).combine_chunks()
                part = part.add_column(1, "place", place.slice(at, 1024))
                yield from part.to_batches()

        for batch in batches:
            # a task may hold several buckets, one after the other
            values = np.asarray(batch.column(0))
            bounds = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    if bucket is not None and values[a] != bucket:
                        yield from flush()
                        held = []
                    bucket = int(values[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "h").select("bucket", "doc_id", "text")
    placed = dealt.mapInArrow(shuffle, "bucket int, place long, doc_id long, text string")
    lookup = spark.createDataFrame(starts, "b int, before long")
    if buckets <= BROADCAST_BUCKETS:  # 12 bytes a bucket
        lookup = F.broadcast(lookup)
    placed = placed.join(lookup, placed.bucket == F.col("b")).withColumn("g", F.col("before") + F.col("place"))
    shard = F.expr(f"if(g < {edge}, g div {small + 1}, {large} + (g - {edge}) div {max(1, small)})")
    slot = F.expr(f"if(g < {edge}, g % {small + 1}, (g - {edge}) % {max(1, small)})")
    placed.select("bucket", "place", "doc_id", "text", shard.cast("int").alias("shard"), slot.alias("slot")).write.option(
        "compression", "zstd"
    ).mode("overwrite").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle the whole ``documents`` table into shards 0 to 15 and report each record as written."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path)
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
