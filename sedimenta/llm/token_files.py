"""Token-id files: documents' ids in ascending doc_id order, as patched frame-of-reference blocks.

A frame holds whole documents.  Inside it, ids stand in blocks of ``BLOCK``: each block keeps its minimum,
packs the differences at the width that covers a percentile of them, and lists the rest as exceptions
(position and full difference).  A frame starts with the byte offsets of its blocks.

Layout of a frame (little-endian): ``PFR1``, number of ids u32, number of blocks u32, then u32 offsets of
the blocks from the end of the index, then the blocks: minimum u32, width u8, exceptions u16, packed bits,
positions u16 each, differences u32 each.  Frames are binary rows of a Parquet table, which gives atomic
commits on any file system; the row also carries the doc_ids and lengths of the frame's documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import own_columns, shared_dir, sliced, table
from sedimenta.llm.token_ids import encoder, tokenizer_path

BLOCK = 256
MAGIC = b"PFR1"
END_ID = 2
FRAME_IDS = 1 << 16
FRAMES = "part int, seq int, inside long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _bits(values: np.ndarray, w: int) -> bytes:
    """Rows of numbers below ``2 ** w`` as ``w`` bits each, lowest bit first."""
    if w in (8, 16, 32):
        return values.astype(f"<u{w // 8}").tobytes()
    if w > 16 or values.shape[1] % 8:
        bits = ((values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little").tobytes()
    # eight numbers make w bytes: two of them a 64-bit word, then four, then eight in two words
    pairs = values.astype("<u4", order="C").reshape(-1).view("<u8")
    pairs = (pairs & np.uint64(0xFFFFFFFF)) | (pairs >> np.uint64(32 - w))
    fours = pairs[::2] | (pairs[1::2] << np.uint64(2 * w))
    eights = np.empty((len(fours) // 2, 2), dtype="<u8")
    eights[:, 0] = fours[::2] | (fours[1::2] << np.uint64(4 * w))
    eights[:, 1] = fours[1::2] >> np.uint64(64 - 4 * w)
    return eights.view(np.uint8)[:, :w].tobytes()


def _numbers(raw: bytes, rows: int, block: int, w: int) -> np.ndarray:
    """What :func:`_bits` made ``raw`` from."""
    if w in (8, 16, 32):
        return np.frombuffer(raw, f"<u{w // 8}").reshape(rows, block)
    if w > 16 or block % 8:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, count=w * block, bitorder="little")
        return bits.reshape(rows, block, w) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    eights = np.zeros((len(raw) // w, 16), dtype=np.uint8)
    eights[:, :w] = np.frombuffer(raw, np.uint8).reshape(-1, w)
    low, high = eights.view("<u8").T
    out = np.empty((len(eights), 8), dtype=np.uint32)
    mask = np.uint64((1 << w) - 1)
    for at, four in ((0, low), (4, (low >> np.uint64(4 * w)) | (high << np.uint64(64 - 4 * w)))):
        for k in range(4):
            out[:, at + k] = (four >> np.uint64(k * w)) & mask
    return out.reshape(rows, block)


def pack(ids: np.ndarray, percentile: float = 0.95, block: int = BLOCK) -> bytes:
    """One frame from unsigned 32-bit ids; empty input gives a frame without blocks."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        return MAGIC + struct.pack("<II", 0, 0)
    padded = np.empty(n_blocks * block, dtype=np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(n_blocks, block)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    cover = np.partition(diff, at, axis=1)[:, at]
    width = np.ceil(np.log2(cover.astype(np.float64) + 1)).astype(np.int64)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if not w:
            continue
        raw = _bits(diff[which] & np.uint32((1 << w) - 1), w)
        size = w * block // 8
        for i, b in enumerate(which.tolist()):
            packed[b] = raw[i * size : (i + 1) * size]
    top = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    exc_row, exc_col = np.nonzero(diff > top[:, None])
    starts = np.searchsorted(exc_row, np.arange(n_blocks + 1)).tolist()
    values = diff[exc_row, exc_col].astype("<u4").tobytes()
    places = exc_col.astype("<u2").tobytes()
    body, offsets, total = [], [], 0
    for b, (least, w) in enumerate(zip(low.tolist(), width.tolist())):
        i, j = starts[b], starts[b + 1]
        one = struct.pack("<IBH", least, w, j - i) + packed[b] + places[2 * i : 2 * j] + values[4 * i : 4 * j]
        offsets.append(total)
        total += len(one)
        body.append(one)
    return b"".join([MAGIC, struct.pack("<II", n, n_blocks), np.array(offsets, dtype="<u4").tobytes(), *body])


def unpack(payload: bytes, block: int = BLOCK) -> np.ndarray:
    """The ids of a frame."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token frame")
    n, n_blocks = struct.unpack_from("<II", payload, 4)
    base = 12 + 4 * n_blocks
    at = [base + o for o in struct.unpack_from(f"<{n_blocks}I", payload, 12)]
    out = np.zeros((n_blocks, block), dtype=np.uint32)
    heads = [struct.unpack_from("<IBH", payload, o) for o in at]
    by_width: dict[int, list[int]] = {}
    for b, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(b)
    for w, which in by_width.items():
        if not w:
            continue
        size = w * block // 8
        out[which] = _numbers(b"".join(payload[(s := at[b] + 7) : s + size] for b in which), len(which), block, w)
    patched = [(b, at[b] + 7 + w * block // 8, k) for b, (_, w, k) in enumerate(heads) if k]
    if patched:
        places = np.frombuffer(b"".join(payload[s : s + 2 * k] for _, s, k in patched), "<u2")
        values = np.frombuffer(b"".join(payload[s + 2 * k : s + 6 * k] for _, s, k in patched), "<u4")
        out[np.repeat([b for b, _, _ in patched], [k for _, _, k in patched]), places] = values
    out += np.array([least for least, _, _ in heads], dtype=np.uint32)[:, None]
    return out.reshape(-1)[:n]


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each, and write frames in ascending doc_id order.

    Rows are dealt by ranges of (doc_id, hash of the text, a number) and sorted inside a range, so frames in
    order of (part, seq) are in order of doc_id and even equal rows don't stay in one range.  A null text counts
    as empty; repeated doc_ids stay separate, ordered by the text's hash.  A task holds one batch and one frame;
    a text longer than a frame makes a frame of its own.  An empty table writes no frames.
    """
    ordered = (
        own_columns(docs, doc_id="doc_id", text="text")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h", F.monotonically_increasing_id())
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, inside = encoder(tokenizer).encode_all, TaskContext.get().partitionId(), 0, 0
        end = int(end_id).to_bytes(4, "little")
        doc_ids, lengths, held, n = [], [], [], 0

        def frame() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([inside], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seq", "inside", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                if n and n + len(ids) // 4 > FRAME_IDS:
                    yield frame()
                    inside += n
                    doc_ids, lengths, held, n, seq = [], [], [], 0, seq + 1
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
        if n:
            yield frame()

    ordered.mapInArrow(frames, FRAMES).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the frames.

    A frame's start inside its part is in its row; parts follow each other, so one total a part gives the
    global start.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    totals = sorted((r.part, r.n) for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, "part int, before long"))  # 12 bytes a part
    placed = frames.join(before, "part").select((F.col("inside") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, payload in zip(*(batch.column(i) for i in range(4))):
                raw = memoryview(unpack(payload.as_py()).astype("<u4").tobytes())
                sizes = np.array(lengths.as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - sizes + start.as_py(), pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole ``documents`` table as a token file and report each document as read back from it."""
    import uuid

    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_file(spark, path)


QUERIES = {"op3_token_files": op3_token_files}
ORACLE_SQL: dict[str, str] = {}
