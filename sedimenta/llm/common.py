"""Session, scratch-space and graph helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark itself so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files; only for what is read from the shared folder afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


TIDY_SECONDS = 5
_tidied = 0.0


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage, once in ``TIDY_SECONDS`` at most.

    Many short queries leave plans, broadcasts and tasks' reports behind; Spark forgets broadcasts only after a
    collection, and without one the heap grows to its limit though little in it is alive.
    """
    global _tidied
    if time.monotonic() - _tidied >= TIDY_SECONDS:
        spark._jvm.System.gc()
        _tidied = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage; survives lost executors."""
    tidy(df.sparkSession)
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, but as compressed Parquet; for tables with long binary or text columns."""
    spark = df.sparkSession
    tidy(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(*stores: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once everything made from it has been cut from it."""
    for df in stores:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not re.fullmatch(r".*-[0-9a-f]{32}", folder):
                raise ValueError(f"{folder} was not made by stored()")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session pass few rows and bytes at once to Python: executors hold batches beside their heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))


def own_columns(df: DataFrame, **columns) -> DataFrame:
    """Only the named inputs, under names no extra column can clash with."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


SLICE_ROWS = 512


def sliced(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """The same rows in record batches of ``rows`` at most, so that a worker holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_text_column(docs: DataFrame, name: str, ddl: str, prepare) -> DataFrame:
    """``docs`` with a column computed from its texts, batch by batch; narrow.

    ``prepare()`` runs once a task and gives a function from a list of texts (or None) to a list of values.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    from sedimenta.llm.token_ids import forget_encoders

    small_batches(docs.sparkSession)
    kind = _parse_datatype_string(ddl)
    arrow = to_arrow_type(kind)

    def run(batches):
        forget_encoders()
        values_of = prepare()
        for batch in sliced(batches):
            values = values_of(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


FILTER_BITS = 23  # an id filter is a megabyte, whatever the input


def id_filter(ids: DataFrame) -> dict[int, bytes]:
    """A bitmap over the column ``id`` (64-bit hashes): which of 2**FILTER_BITS residues occur.

    Its size is fixed; with very many ids it lets more pass, and a join afterwards still decides.
    """
    bit = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    pages = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("page"))
    return {r.page: bytes(r.bits) for r in pages.agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")).collect()}


def may_hold(held: dict[int, bytes], name: int) -> bool:
    at = name & ((1 << FILTER_BITS) - 1)
    page = held.get(at >> 15)
    return bool(page and page[(at & 32767) >> 3] >> (at & 7) & 1)


def bits_of(held: dict[int, bytes]):
    """An id filter as one array of bytes, for :func:`may_hold_each`."""
    import numpy as np

    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for page, part in held.items():
        bits[page << 12 : (page << 12) + len(part)] = np.frombuffer(part, np.uint8)
    return bits


def may_hold_each(bits, names):
    """:func:`may_hold` of every number of an array, as booleans."""
    at = names & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype("u1") & 1).astype(bool)


FEW_EDGES = 300_000  # that one task holds in about 20 MB


def _united(batches: Iterator) -> Iterator:
    """Record batches of the components of all edges in ``batches``: every vertex and the smallest one it reaches."""
    import numpy as np
    import pyarrow as pa

    held = [tuple(batch.column(k).to_numpy() for k in (0, 1)) for batch in batches]
    if not held:
        return
    a, b = (np.concatenate(side) for side in zip(*held))
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while (label[x] != label[y]).any():
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    for at in range(0, len(names), BATCH_ROWS):
        some = slice(at, at + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]])], names=["v", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Smallest vertex reachable from every vertex of ``edges(a, b)``; returns ``(v, component)``.

    Up to ``few`` edges between 64-bit numbers are united by one task, as rounds of many small tasks cost more
    than that.  Otherwise each round takes the smallest label among the neighbours and then follows the label's own label,
    so that long chains halve.  Only minima are aggregated (map-side first), no adjacency list is ever
    gathered, and each round is cut by a checkpoint.  Empty input gives an empty result; self loops and
    repeated edges are harmless.  ``edges`` is worked out once: links that only connect may be others each time.
    """
    edges = cut(edges.filter("a is not null and b is not null").select("a", "b"))
    if [kind for _, kind in edges.dtypes] == ["bigint", "bigint"] and edges.count() <= few:
        return cut(edges.coalesce(1).mapInArrow(_united, "v long, component long"))
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("edge"))
    both = cut(both.select("edge.*").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")))
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("v").alias("b"), "l"), "b")
            .groupBy("a")
            .agg(F.min("l").alias("m"))
        )
        hooked = labels.join(near, labels.v == near.a).select("v", F.col("l").alias("before"), F.least("l", "m").alias("l"))
        target = labels.select(F.col("v").alias("w"), F.col("l").alias("ll"))
        jumped = cut(
            hooked.join(target, hooked.l == target.w, "left").select(
                "v", F.least("l", F.coalesce("ll", "l")).alias("l"), "before"
            )
        )
        labels = jumped.select("v", "l")
        if jumped.filter("l <> before").isEmpty():
            return labels.select("v", F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
