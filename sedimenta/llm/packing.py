"""Packing token sequences with minimum bin slack.

Documents are cut into full windows and a remainder.  The multiset of remainder lengths is a histogram of
fewer than ``window`` counts however many documents there are; the planner works on that histogram alone.
Each step fixes the longest length left and finds, by a bitset subset-sum over the other lengths and their
counts, the multiset that fills the window closest to capacity; backtracking gives its counts, and the
pattern is applied as often as the counts allow.  A length that no multiset completes to a full window is set
aside (later counts are only smaller); what was set aside is laid end to end and cut at window borders
(documents may be cut freely), so at most one sequence is padded.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import own_columns, sliced, stored, table
from sedimenta.llm.token_ids import CACHE_BYTES, encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], first: int, window: int) -> Counter:
    """The multiset that holds ``first`` and comes closest to ``window``, using each length at most ``counts`` times."""
    need = window - first
    mask = (1 << (need + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= need), reverse=True):
        most = min(counts[length] - (length == first), need // length)
        part = 1
        while most > 0:
            take = min(part, most)
            grown = reach | (reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            most -= take
            part *= 2
        if reach >> need & 1:
            break
    at, used = reach.bit_length() - 1, Counter({first: 1})
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            used[length] += take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]], int]:
    """Where the items of each length go.

    Returns (runs, tail, patterns' sequences).  A run (length, from_rank, to_rank, sequence, a sequence's
    items, offset) places items by rank among those of their length; a tail entry (length, from_rank,
    to_rank, position) lays them end to end from a position in the stream that is cut every ``window``.
    """
    left = {length: n for length, n in histogram.items() if n}
    taken: Counter = Counter()
    runs, sequence, aside = [], 0, {}
    while left:
        first = max(left)
        pattern = fill(left, first, window)
        if sum(length * n for length, n in pattern.items()) < window:
            aside[first] = left.pop(first)
            continue
        times = min(left[length] // n for length, n in pattern.items())
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            runs.append((length, taken[length], taken[length] + n * times, sequence, n, offset))
            offset += n * length
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    tail, position = [], 0
    for length, n in sorted(aside.items(), reverse=True):
        tail.append((length, taken[length], taken[length] + n, position))
        position += length * n
    return runs, tail, sequence


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, cache: int = CACHE_BYTES) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``; see the module's text for the method.

    A null or empty text is the end id alone.  Rows with the same doc_id are packed separately.  Ties
    (equal lengths) go by input partition and position.  An empty table gives no rows.  A worker keeps up to
    ``cache`` bytes of ids of words.
    """
    # ids are needed once for the checksums of full windows and remainders; only those are kept
    docs = own_columns(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, cache).encode, TaskContext.get().partitionId()
        rank: Counter = Counter()
        n_full = 0
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), (encode(t.as_py()) for t in batch.column(1))):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                full, rest = divmod(n, window)
                crcs = [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
                for column, value in zip(out, (part, doc_id, n, rank[rest], n_full, crcs, zlib.crc32(raw[4 * window * full :]) if rest else None)):
                    column.append(value)
                n_full += full
                rank[rest] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                names=["part", "doc_id", "n", "rank", "full_before", "crcs", "rest_crc"],
            )

    schema = "part int, doc_id long, n long, rank long, full_before long, crcs array<long>, rest_crc long"
    measured = stored(docs.mapInArrow(measure, schema), "packing-lengths")
    spark = measured.sparkSession
    sizes = measured.withColumn("rest", F.col("n") % window)

    # at most window rows for each input partition
    each = sizes.groupBy("part", "rest").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("rest").orderBy("part")) - F.col("k")
    ranks = each.filter("rest > 0").select("part", "rest", before.alias("rank_before"))
    histogram = {r.rest: r.k for r in each.filter("rest > 0").groupBy("rest").agg(F.sum("k").alias("k")).collect()}
    runs, tail, n_sequences = plan(histogram, window)
    parts = sorted((r.part, r.k) for r in sizes.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("k")).collect())
    full_starts, n_full = [], 0
    for part, k in parts:
        full_starts.append((part, n_full))
        n_full += k
    tail_base = n_full + n_sequences

    full = sizes.join(F.broadcast(spark.createDataFrame(full_starts, "part int, full_start long")), "part")
    full = full.select(
        "doc_id", "n", (F.col("full_start") + F.col("full_before")).alias("sequence"), F.posexplode("crcs").alias("i", "crc")
    ).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("sequence") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    # one row a length (fewer than window), its runs in an array
    places: dict[int, list] = {length: [] for length in histogram}
    for length, a, b, sequence, n, offset in runs:
        places[length].append((a, b, sequence + n_full, n, offset, None))
    for length, a, b, position in tail:
        places[length].append((a, b, None, None, None, position))
    place_schema = "rest long, runs array<struct<a:long,b:long,sequence:long,n:long,offset:long,position:long>>"
    lookup = spark.createDataFrame(sorted(places.items()), place_schema)
    rest = (
        sizes.filter("rest > 0")
        .join(ranks, ["part", "rest"])
        .join(F.broadcast(lookup), "rest")
        .withColumn("r", F.col("rank") + F.col("rank_before"))
        .withColumn("run", F.expr("filter(runs, x -> x.a <= r and r < x.b)[0]"))
        .withColumn("k", F.expr("r - run.a"))
        .withColumn("at", F.expr("run.position + k * rest"))
        .select(
            "doc_id", "n", "rest", "rest_crc", F.expr("n - rest").alias("start"), F.expr(f"at % {window}").alias("tail_offset"),
            F.expr(f"coalesce(run.sequence + k div run.n, {tail_base} + at div {window})").alias("sequence"),
            F.expr(f"coalesce(run.offset + (k % run.n) * rest, at % {window})").alias("offset"),
        )
        .withColumn("cut", F.expr(f"coalesce(tail_offset + rest > {window}, false)"))
    )
    whole = rest.filter("not cut").select(
        "doc_id", "start", F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), "offset",
    )
    pieces = full.unionByName(whole)
    if not any(p // window != (p + k * n - 1) // window for k, a, b, p in tail for n in (b - a,)):
        return pieces

    # remainders that a window border cuts are encoded again for the checksums of their two pieces
    cuts = rest.filter("cut").select(F.col("doc_id").alias("id"), "n", "rest_crc", "start", "sequence", "offset")
    if sum(b - a for _, a, b, _ in tail) <= BROADCAST_ROWS:  # 48 bytes a row
        cuts = F.broadcast(cuts)
    texts = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["sequence", "offset", "h"]).drop("h")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache).encode
        for batch in sliced(batches):
            rows = []
            for row in batch.to_pylist():
                raw = memoryview(encode(row["text"]) + end)
                n, start, room = len(raw) // 4, row["start"], window - row["offset"]
                if n != row["n"] or zlib.crc32(raw[4 * start :]) != row["rest_crc"]:
                    continue  # another text under the same doc_id
                for a, b, sequence, offset in ((start, start + room, row["sequence"], row["offset"]), (start + room, n, row["sequence"] + 1, 0)):
                    rows.append((row["doc_id"], a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, sequence, offset))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return pieces.unionByName(texts.mapInArrow(halves, PIECES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the whole ``documents`` table into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
