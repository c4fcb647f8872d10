"""Line dedup by a segment-partition edit join.

Two lines within ``EDITS`` edits, one cut into ``EDITS + 1`` segments, share one segment unchanged, near its
place and with a length difference within the bound.  Distinct lines post their own segments, and probe with
the substrings that could be a segment of a line as long or up to ``EDITS`` shorter (the multi-match-aware
windows).  Lines that meet under a key are first held against each other's length and character counts (an
edit changes the counts of 16 character classes by two at most), then verified by a banded bit-parallel edit
distance.

Equal lines are one row from the first scan on.  Keys that only one line uses are dropped before any row is
joined, texts are only fetched for lines of pairs that pass the counts, and components need no pair lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import bits_of, connected_components, cut, discard, free_name, id_filter, may_hold, may_hold_each, own_columns, sliced, stored, table

EDITS = 2
SHORT = 20  # characters; shorter lines are matched exactly only
BLANKS = " \t\n\x0b\x0c\r"  # a line of these alone has no word
SEEN = 100_000  # lines a task remembers at least, so as not to post them again
MEDIUM = 40  # characters; lines under this may differ by one edit, longer ones by EDITS


def allowed(a: int, b: int, edits: int = EDITS) -> int:
    """Edits within which two lines of these lengths are near: by the shorter one."""
    shorter = min(a, b)
    return 0 if shorter < SHORT else min(1, edits) if shorter < MEDIUM else edits


def segments(n: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` segments of a line of ``n`` characters; the last ones are longer."""
    parts = edits + 1
    short, extra = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - extra)
        out.append((at, size))
        at += size
    return out


def probes(n: int, edits: int = EDITS) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, length, own) of the substrings of a line of ``n`` characters to look up.

    ``own`` marks the line's own segments, which are also what it posts.
    """
    out = []
    for gap in range(edits + 1):
        if n - gap < edits + 1:
            continue
        for i, (p, size) in enumerate(segments(n - gap, edits)):
            low = max(p - i, p + gap - (edits - i), 0)
            high = min(p + i, p + gap + (edits - i), n - size)
            out += [(n - gap, i, start, size, gap == 0 and start == p) for start in range(low, high + 1)]
    return out


def banded_distance(a: str, b: str, most: int) -> int:
    """Edit distance if it is at most ``most``, else ``most + 1``; bit-parallel inside a band of the diagonal."""
    if a == b:
        return 0
    m, n = len(a), len(b)
    if abs(m - n) > most or not most:
        return most + 1
    i, least = 0, min(m, n)
    while i < least and a[i] == b[i]:
        i += 1
    k = 0
    while k < least - i and a[m - 1 - k] == b[n - 1 - k]:
        k += 1
    a, b = a[i : m - k], b[i : n - k]
    m, n = len(a), len(b)
    if not m or not n:
        return min(max(m, n), most + 1)
    places: dict[str, int] = {}
    for at, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << at
    band = 2 * most + 2
    mask = (1 << band) - 1
    # bits are rows low+1 .. low+band of the matrix; base is the value of row `low`
    up, down, low, base = mask, 0, 0, 0
    for j in range(1, n + 1):
        if j - most - 1 > low:  # the band moves down a row
            base += (up & 1) - (down & 1)
            up, down, low = up >> 1 | 1 << (band - 1), down >> 1, low + 1
        equal = places.get(b[j - 1], 0) >> low & mask
        x = equal | down
        zero = ((((x & up) + up) & mask) ^ up) | x
        right_up = down | ~(zero | up) & mask
        right_down = zero & up
        right_up, right_down = (right_up << 1 | 1) & mask, right_down << 1 & mask
        base += 1
        up, down = right_down | ~(zero | right_up) & mask, right_up & zero
        if base - down.bit_count() > most:
            return most + 1
    rows = (1 << (m - low)) - 1
    return min(base + (up & rows).bit_count() - (down & rows).bit_count(), most + 1)


def _line_id(raw: bytes) -> int:
    """The signed 64-bit hash that names a line."""
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(raw)
    return value - (1 << 64) if value >> 63 else value


def _signature(line: str) -> tuple[int, int]:
    """Counts of 16 classes of characters, a byte each (255 at most), in two signed 64-bit numbers."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") & 15
    counts = np.minimum(np.bincount(codes, minlength=16), 255).astype(np.uint8)
    low, high = counts.view("<i8")
    return int(low), int(high)


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line_no, id, len, low, high`` of every line with a word (lines are split at line feeds).

    ``row`` is a hash of the whole text, so that rows with the same doc_id aren't taken for each other.
    """
    schema = "doc_id long, row long, line_no int, id long, len int, low long, high long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    if line.strip(BLANKS):
                        rows.append((doc_id, row, k, _line_id(line.encode("utf-8", "surrogatepass")), len(line), *_signature(line)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    rows = own_columns(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, schema)


def postings_of(docs: DataFrame, edits: int = EDITS, wanted: dict[int, bytes] | None = None) -> DataFrame:
    """``key, id, own``: own segments and probes of every line of at least ``SHORT`` characters.

    A task posts a line once, or again if it has forgotten it.  With an id filter ``wanted`` only keys that it
    lets pass are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        plans: dict[int, list] = {}
        seen: set[int] = set()
        bits = None if wanted is None else bits_of(wanted)
        for batch in sliced(batches):
            keys, ids, own = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for text in batch.column(1):
                for line in (text.as_py() or "").split("\n"):
                    n = len(line)
                    if n < SHORT or not line.strip(BLANKS):
                        continue
                    raw = line.encode("utf-8", "surrogatepass")
                    name = _line_id(raw)
                    if name in seen:
                        continue
                    seen.add(name)
                    plan = plans.get(n)
                    if plan is None:
                        plan = plans[n] = [(length * 8 + i, start, start + size, mine) for length, i, start, size, mine in probes(n, edits)]
                    plain = raw if len(raw) == n else None
                    for seed, a, b, mine in plan:
                        part = plain[a:b] if plain is not None else line[a:b].encode("utf-8", "surrogatepass")
                        keys.append(xxh3_64_intdigest(part, seed))
                        ids.append(name)
                        own.append(mine)
            columns = [np.array(keys, dtype=np.uint64).view(np.int64), np.array(ids, dtype=np.int64), np.array(own, dtype=bool)]
            if bits is not None:
                passing = may_hold_each(bits, columns[0])
                columns = [c[passing] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "own"])

    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "key long, id long, own boolean")


def _texts(docs: DataFrame, wanted: dict[int, bytes]) -> DataFrame:
    """``id, line`` of the distinct lines that the id filter ``wanted`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {}
            for text in batch.column(1):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= SHORT:
                        name = _line_id(line.encode("utf-8", "surrogatepass"))
                        if may_hold(wanted, name):
                            found[name] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["id", "line"])

    texts = own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "id long, line string")
    return texts.groupBy("id").agg(F.first("line").alias("line"))


def _wanted(pairs: DataFrame) -> dict[int, bytes]:
    return id_filter(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))


def _counts_apart() -> F.Column:
    """Sum of the differences of the 16 character counts of rows a and b."""
    byte = lambda side, half, k: F.expr(f"(({side}_{half} >> {8 * k}) & 255)")
    return sum((F.abs(byte("a", half, k) - byte("b", half, k)) for half in ("low", "high") for k in range(8)), F.lit(0))


def line_links(docs: DataFrame, lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``a, b`` (a < b) of distinct lines within the allowed edits; ``lines`` as from :func:`lines_of`."""
    # a key matters if two lines use it and one of them posts it
    several = cut(
        postings_of(docs, edits).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or("own").alias("posted"))
        .filter("posted and first <> last").select("key")
    )
    uses = postings_of(docs, edits, id_filter(several.select(F.col("key").alias("id"))))
    met = uses.join(several, "key").groupBy("key", "id").agg(F.bool_or("own").alias("own"))
    # a name that different lines share, rare as it is, takes no part: such lines are only matched exactly
    about = lines.filter(F.col("len") >= SHORT).groupBy("id").agg(F.min(F.struct("len", "low", "high")).alias("x"), F.max(F.struct("len", "low", "high")).alias("y"))
    met = cut(met.join(about.filter("x = y").select("id", "x.*"), "id"))

    side = lambda rows, s: rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "len", "low", "high")])
    posted, every = side(met.filter("own"), "a"), side(met, "b").withColumn("b_own", F.lit(True))
    # the longer line probes for the shorter; equal lengths meet once, by their order
    near = (
        posted.join(every, "key")
        .filter(f"b_len - a_len between 0 and {edits} and (b_len > a_len or b_id > a_id)")
        .filter(_counts_apart() <= 2 * edits)
    )
    pairs = cut(near.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct())
    texts = stored(_texts(docs, _wanted(pairs)), "line-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, left, right in zip(*(batch.column(i).to_pylist() for i in range(4))):
                most = allowed(len(left), len(right), edits)
                if banded_distance(left, right, most) <= most:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("left")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("right")), "b")
    links = cut(both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"))
    discard(texts)
    return links


NAME = ["id", "len", "low", "high"]  # a line's hash, length and character counts name it


def _classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """As :func:`line_classes`, with each line's ``row`` (see :func:`lines_of`)."""
    lines = stored(lines_of(docs), "lines")
    links = line_links(docs, lines, edits)
    components = connected_components(links)
    degree = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("n_links"))
    place = F.struct("doc_id", "line_no", "row")
    heads = lines.groupBy(*NAME).agg(F.min(place).alias("head"))
    classes = heads.join(components.withColumnRenamed("v", "id"), "id", "left").withColumnRenamed("component", "c")
    linked = classes.filter("c is not null")
    firsts = linked.groupBy("c").agg(F.min("head").alias("first"))
    classes = cut(
        classes.join(firsts, "c", "left").join(degree.withColumnRenamed("v", "id"), "id", "left")
        .select(*NAME, F.coalesce("first", "head").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return lines.join(classes, NAME).select(
        "doc_id", "row", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", "len",
        F.col("first").eqNullSafe(place).alias("kept"),
    )


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row for each line with a word: its place, its class, its number of links, and whether it is the first.

    ``doc_id, line_no`` name the line; ``class_doc_id, class_line_no`` name the first line (smallest pair, null
    doc_ids first, then by a hash of the row's text) of its class: equal lines and all lines reachable over
    links.  ``n_links`` counts other distinct lines within the allowed edits.  ``kept`` is true for the class's
    first line.  Null texts, blank lines and empty tables give no rows; only rows equal in both doc_id and text
    share their fate.
    """
    return _classes(docs, edits).drop("row")


def without_repeated_lines(docs: DataFrame, shortest: int = SHORT) -> DataFrame:
    """``docs`` with only the first line of each class; blank lines and lines under ``shortest`` characters stay.

    All columns keep their names and order, whatever they are called; a document that loses every line keeps
    its row with an empty text, and null texts stay null.  Lines go by row: rows that share a doc_id lose only
    their own lines, and rows equal in doc_id and text lose the same ones.  An empty table stays empty.
    """
    taken: list[str] = []
    for name in ("gone_id", "gone_row", "gone", "flags", "row"):
        taken.append(free_name(docs, name))
    gone_id, gone_row, gone, flags, row = taken
    dropped = _classes(docs).filter(~F.col("kept") & (F.col("len") >= shortest))
    dropped = dropped.groupBy(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)).agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    joined = docs.withColumn(row, F.xxhash64("text"))
    joined = joined.join(dropped, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(row) == F.col(gone_row)), "left")
    lines = F.split("text", "\n", -1)
    # one letter a line, so that a document of many lines needs no search for each of them
    letters = F.aggregate(gone, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, g: F.struct((g + 1).alias("at"), F.concat(s["out"], F.array(F.repeat(F.lit("k"), g - s["at"]))).alias("out")),
        lambda s: F.array_join(s["out"], "d"),
    )
    joined = joined.withColumn(flags, F.concat(letters, F.lit("d")))
    stays = F.filter(lines, lambda x, i: F.substring(F.col(flags), i + 1, F.lit(1)) != "d")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal lines over the whole ``documents`` table."""
    return line_classes(table(spark, sf_dir, "documents")).drop("len")


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE_SQL: dict[str, str] = {}
