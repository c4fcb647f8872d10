"""Near-duplicate documents by SimHash fingerprints and a byte-position index.

Two 64-bit fingerprints at most two bits apart differ in at most two bytes, so at least six of their eight
positional bytes agree.  Single bytes make lists that grow with the corpus, so a posting's key is longer: the
eight positions form four groups of two, of which any linked pair shares two whole ones; a key is two groups
and one of the four positional bytes outside them (24 keys of 40 bits a fingerprint).  Two fingerprints that
meet share the four bytes of the groups, and every further posting they share under the same groups is one more
positional byte: the index hits are tallied, and pairs with fewer than two, that is fewer than six shared
bytes, are dropped before their bits are compared.

A posting list longer than ``hot`` isn't expanded into pairs.  Its fingerprints are instead linked through
midpoints: two fingerprints at most two bits apart share a fingerprint at most one bit from either.  All
holders of a midpoint are within two bits of each other, so each is linked to the smallest holder, which
gives the same components from 65 rows a fingerprint.  A pair that shares a long list is linked that way, any
other pair has all its shared lists expanded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import FILTER_BITS, bits_of, connected_components, cut, discard, free_name, id_filter, may_hold, may_hold_each, own_columns, sliced, stored, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(256)).lower()


def _words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words joined by blanks; of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(line, 42)] if words else [], dtype="<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits, each one if it is set in over half of the hashes; zero without hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for a very long text
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats counted; no words give zero."""
    return majority(shingle_hashes(_words(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row of ``docs(doc_id, text)``; narrow, one batch in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, distance: int = 2, hot: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` that connect all pairs within ``distance`` bits."""
    if distance != 2:
        raise ValueError("the midpoint way for long posting lists holds for a distance of two bits")
    group = lambda g: f"((fp >> {16 * g}) & 65535)"
    byte = lambda i: f"((fp >> {8 * i}) & 255)"
    keys = []
    for n, (g, h) in enumerate(combinations(range(4), 2)):
        for m, i in enumerate(i for i in range(8) if i // 2 not in (g, h)):
            keys.append(F.expr(f"({4 * n + m}L << 40) | ({group(g)} << 24) | ({group(h)} << 8) | {byte(i)}"))
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    postings = cut(postings.join(sizes, "key"))

    short = postings.filter(F.col("size") <= hot)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    # hits under the same two groups: shared positional bytes beside the groups' four
    tallied = a.join(b, "key").filter("a < b").groupBy("a", "b", F.shiftright("key", 42).alias("groups")).agg(F.count("*").alias("hits"))
    near = tallied.filter(F.col("hits") >= 8 - distance - 4).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    crowded = postings.filter(F.col("size") > hot).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)]
    midpoints = crowded.select("fp", F.explode(F.array(*flips)).alias("z"))
    least = midpoints.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").select("z", "a")
    through = midpoints.join(least, "z").filter("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: the smallest doc_id reachable over linked fingerprints.

    Null and empty texts have fingerprint zero and are linked like any other; repeated doc_ids keep a row
    each; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, shingle))
    heads = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("head")))  # copies collapse, map-side first
    components = connected_components(links(heads.select("fp"), distance))
    placed = heads.join(components, heads.fp == components.v, "left").select("fp", "head", F.coalesce("component", "fp").alias("c"))
    first = placed.groupBy("c").agg(F.min("head").alias("component_id"))
    classes = placed.join(first, "c").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _node(words: list[bytes], seed: int = 1) -> int:
    """The signed 64-bit hash that names a text by its words."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(b" ".join(words), seed)
    return value - (1 << 64) if value >> 63 else value


def _least(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` has in common with any set at least ``similarity`` alike; never too many."""
    return math.ceil(similarity * n - 1e-9)


VALUE_BITS = 61  # of a shingle's hash; two bits above them rank it by how common it is


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, ascending, as positive numbers of ``VALUE_BITS`` bits."""
    return np.unique(hashes & np.uint64((1 << VALUE_BITS) - 1)).view(np.int64)


def _shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct shingles of a text; see :func:`_distinct`."""
    return _distinct(shingle_hashes(words, shingle))


def _prefix(values: np.ndarray, similarity: float, common: list[np.ndarray]) -> np.ndarray:
    """The first ``n - least + 1`` of a set's shingles, rare ones first; see :func:`prefixes`."""
    ranked = values
    for bits in common:
        ranked = ranked + (may_hold_each(bits, values).astype(np.int64) << VALUE_BITS)
    return np.sort(ranked)[: len(values) - _least(len(values), similarity) + 1]


def prefixes(docs: DataFrame, shingle: int, similarity: float, common: list[dict[int, bytes]]) -> DataFrame:
    """``doc_id, node, second, fp, n, prefix``: two names for the text's words, its fingerprint, its distinct shingles and the first of them.

    Shingles are in one order for all texts: by the number of bitmaps of ``common`` that hold them (three at
    most), then by hash.  Two sets that are ``similarity`` alike share all but ``n - least`` of either's shingles,
    so the first ``n - least + 1`` of one and of the other have one in common, whatever the order; an order with
    common shingles last keeps posting lists short.  Narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [bits_of(held) for held in common]
        for batch in sliced(batches):
            nodes, seconds, fps, sizes, firsts = [], [], [], [], []
            for text in batch.column(1):
                words = _words(text.as_py())
                hashes = shingle_hashes(words, shingle)
                values = _distinct(hashes)
                nodes.append(_node(words))
                seconds.append(_node(words, 2))
                fps.append(majority(hashes))
                sizes.append(len(values))
                firsts.append(_prefix(values, similarity, bits))
            signed = pa.array(np.array(fps, dtype=np.uint64).astype(np.int64))
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(seconds, pa.int64()), signed, pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "second", "fp", "n", "prefix"])

    return own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, node long, second long, fp long, n int, prefix array<long>")


def common_shingles(docs: DataFrame, shingle: int, similarity: float) -> list[dict[int, bytes]]:
    """Three id filters: shingles that occur in the hash-ordered prefixes of several, many and very many rows.

    Every row is counted.  The filters only make an order, so that they may hold other shingles by chance changes
    no result.  They have a fixed size; the least count is the smallest power of two that a quarter of one can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [_prefix(_shingle_set(_words(text.as_py()), shingle), similarity, []) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["id"])

    counted = own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "id long").groupBy("id").agg(F.count("*").alias("df")).filter("df > 1")
    counted = stored(counted, "counted-shingles")
    by_size = {r.p: r.n for r in counted.groupBy(F.floor(F.log2("df")).alias("p")).agg(F.count("*").alias("n")).collect()}
    least, most = 1, (1 << FILTER_BITS) // 4
    while sum(n for p, n in by_size.items() if p >= least) > most:
        least += 1
    filters = [id_filter(counted.filter(F.col("df") >= 1 << (least + 2 * k)).select("id")) for k in range(3)]
    discard(counted)
    return filters


def _shingle_sets(docs: DataFrame, shingle: int, wanted: dict[int, bytes]) -> DataFrame:
    """``node, hashes`` (distinct) of the texts that the id filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {}
            for text in batch.column(1):
                words = _words(text.as_py())
                node = _node(words)
                if node not in found and may_hold(wanted, node):
                    found[node] = _shingle_set(words, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "hashes"])

    rows = own_columns(docs, doc_id="doc_id", text="text").mapInArrow(run, "node long, hashes array<long>")
    return rows.groupBy("node").agg(F.first("hashes").alias("hashes"))


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets overlap by ``similarity`` of their union."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.filter(common >= similarity * (F.size("left") + F.size("right") - common)).select("a", "b")


def linking_pairs(nodes: np.ndarray, sets: list[np.ndarray], similarity: float, apart: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Pairs at least ``similarity`` alike that connect all such pairs: fewer than there are sets.

    An inverted index over all shingles of the sets counts what each set shares with every other one.  With
    ``apart`` (booleans) only pairs of a set that has it and one that hasn't are looked at.
    """
    n = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    first = np.r_[True, values[order][1:] != values[order][:-1]] if len(values) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(values)])
    group = np.empty(len(values), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    holders = owner[order]
    bounds = np.r_[0, np.cumsum(n)]
    label, a, b = np.arange(len(sets)), [], []
    for i in range(len(sets)):
        lists = group[bounds[i] : bounds[i + 1]]
        lists = lists[length[lists] > 1]
        if not len(lists):
            continue
        sizes = length[lists]
        at = np.repeat(start[lists] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
        shared = np.bincount(holders[at], minlength=len(sets))
        near = shared >= similarity * (n + n[i] - shared) - 1e-9
        near &= label != label[i]
        if apart is not None:
            near &= apart != apart[i]
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
    return a, b


def _crowd_links(sets: DataFrame, crowds: DataFrame, similarity: float, part: int) -> DataFrame:
    """Links (a, b) that connect all pairs at least ``similarity`` alike inside each crowd of ``crowds(node, crowd)``.

    A crowd is dealt into parts of about ``part`` texts; a task compares two parts in memory and gives only the
    links that connect what it found, so no pair is written that isn't one of those.  Every part meets every other
    one, ``2 * ROUND`` of them a round: what a round shuffles grows with the crowd, not with its square.
    """
    sizes = cut(crowds.groupBy("crowd").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    found = None
    for k in range(((sizes.agg(F.max("parts")).first()[0] or 0) // 2) // ROUND + 1):
        links_of = cut(_round_links(_meetings(crowds, sizes, k).join(sets, "node"), similarity))
        found = links_of if found is None else found.unionByName(links_of)
    return found


def _meetings(crowds: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``crowd, node, part, other``: the parts that each text's part meets in round ``k``, by their distance in a circle."""
    dealt = crowds.join(sizes, "crowd").withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    near, far = F.lit(k * ROUND), F.least(F.lit((k + 1) * ROUND - 1), F.floor(F.col("parts") / 2).cast("int"))
    steps = F.when(near <= far, F.sequence(near, far))
    ahead = F.transform(steps, lambda x: F.pmod(F.col("part") + x, F.col("parts")))
    back = F.transform(steps, lambda x: F.pmod(F.col("part") - x, F.col("parts")))
    others = F.array_distinct(F.concat(ahead, back))
    return dealt.select("crowd", "node", "part", F.explode(others).alias("other"))


def _round_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) inside each two parts of ``dealt(crowd, node, part, other, hashes)``, an own task's."""
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = dealt.select(F.xxhash64("crowd", low, high).alias("task"), "crowd", low.alias("low"), high.alias("high"), (F.col("part") == low).alias("side"), "node", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            side = whole["side"].to_numpy() if name[2] != name[3] else None
            # parts of their own are compared inside by their own task
            a, b = linking_pairs(whole["node"].to_numpy(), [x.values.to_numpy() for x in whole["hashes"]], similarity, side)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            at = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[at]:
                    if name is not None and names[at] != name:
                        yield flush()
                        held = []
                    name = names[at]
                    held.append(batch.slice(at, i - at))
                    at = i
        if held:
            yield flush()

    ordered = rows.repartition("task").sortWithinPartitions("task", "crowd", "low", "high")
    return ordered.mapInArrow(run, "a long, b long")


CROWDED = 32  # texts of a posting list that are still paired one by one
ROUND = 4  # distances of parts that meet in one round
PART = 1024  # texts of a crowd that a task compares with as many others


def _fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """``a, b``: for each text ``b`` of ``heads(node, fp)`` the first text of its SimHash class (see :func:`links`), if that is another."""
    fps = cut(heads.groupBy("fp").agg(F.min("node").alias("least")))
    classes = connected_components(links(fps.select("fp")))
    placed = fps.join(classes, fps.fp == classes.v, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    first = placed.join(placed.groupBy("c").agg(F.min("least").alias("a")), "c").select("fp", "a")
    return heads.join(first, "fp").select("a", F.col("node").alias("b")).filter("a <> b")


def _list_pairs(short: DataFrame) -> DataFrame:
    """``a, b``: for each text ``b`` of posting lists ``short(node, least)`` the least text of a list, of that it meets most often."""
    met = short.filter("node <> least").groupBy("node", "least").agg(F.count("*").alias("hits"))
    most = met.groupBy("node").agg(F.max(F.struct("hits", "least")).alias("most"))
    return most.select(F.col("most.least").alias("a"), F.col("node").alias("b"))


def _sets_of(docs: DataFrame, shingle: int, *ids: DataFrame) -> DataFrame:
    """Stored :func:`_shingle_sets` of the texts that the first columns of ``ids`` name."""
    wanted = ids[0].toDF("id")
    for more in ids[1:]:
        wanted = wanted.unionByName(more.toDF("id"))
    return stored(_shingle_sets(docs, shingle, id_filter(wanted)), "shingle-sets")


def _met(short: DataFrame, ends: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different classes ``c`` that their tally in ``short(key, node, n, at, c)`` allows to be alike.

    Lists are short, so each is gathered, once, and its pairs are made in place.
    """
    lists = short.groupBy("key").agg(F.collect_list(F.struct("node", "n", "at", "c")).alias("texts"), F.min("c").alias("low"), F.max("c").alias("high"))
    both = lists.filter("low <> high").select(F.explode("texts").alias("x"), "texts").select("x", F.explode("texts").alias("y"))
    side = lambda s, x: [F.col(f"{x}.node").alias(s), *[F.col(f"{x}.{c}").alias(f"{s}_{c}") for c in ("n", "at")]]
    both = both.filter("x.node < y.node and x.c <> y.c").select(*side("a", "x"), *side("b", "y"))
    alike = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * (similarity / (1 + similarity)) - 1e-9)  # shingles a pair must share
    # of what stands before the common shingle, and after it, a pair can share as much as the shorter stretch
    possible = F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = both.filter(alike & (possible >= needed))
    # the first common shingle leaves room for all the others
    room = F.max(F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))).alias("room")
    tallied = met.groupBy("a", "b").agg(F.count("*").alias("shared"), room)
    end_of = lambda s: ends.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "held", "end")])
    tallied = tallied.join(end_of("a"), "a").join(end_of("b"), "b")
    rest = F.when(F.col("a_end") < F.col("b_end"), F.col("a_n") - F.col("a_held")).when(
        F.col("a_end") > F.col("b_end"), F.col("b_n") - F.col("b_held")
    ).otherwise(F.least(F.col("a_n") - F.col("a_held"), F.col("b_n") - F.col("b_held")))
    return tallied.filter((F.col("room") >= needed) & (F.col("shared") + rest >= needed)).select("a", "b")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowded: int = CROWDED, part: int = PART) -> DataFrame:
    """``doc_id, component_id`` of every row: classes of texts whose shingle sets are at least ``similarity`` alike.

    First the texts' fingerprints are linked through the byte-position index, as :func:`near_duplicates` does, and
    every text is verified against the first one of its class.  Fingerprints can't bound how alike sets are, so an
    exact way follows for the rest: texts are posted under the shingles of their prefix (see :func:`prefixes`),
    where every pair meets; no pair is lost.  What no fingerprint linked is verified against the least text of the
    lists it is in, so that near copies of each other soon are one class, and only pairs of different classes are
    then tallied by the shingles their prefixes share: of two prefixes the one that ends first holds all common
    shingles up to its end, and beyond it at most the rest of its text's can be common.  What the tally allows is
    verified.  Texts that a list of more than ``crowded`` joins are a crowd: all its pairs are compared in memory,
    part by part, and only links that connect come out.  Texts without words, null ones too, are one class.
    Repeated rows keep a row each; an empty table gives none.
    """
    held = stored(prefixes(docs, shingle, similarity, common_shingles(docs, shingle, similarity)), "prefixes")
    rows = stored(held.select("doc_id", "node"), "names")
    seconds = (F.min("second").alias("low"), F.max("second").alias("high"))
    firsts = held.groupBy("node").agg(F.min("doc_id").alias("head"), F.first(F.struct("fp", "n", "prefix")).alias("s"), *seconds)
    # different texts under one name, rare as they are, take no part and stay
    firsts = stored(firsts.filter("low = high").select("node", "head", "s.*"), "heads")
    discard(held)
    end = F.try_element_at("prefix", F.lit(-1)).alias("end")
    heads = stored(firsts.select("node", "head", "fp", "n", F.size("prefix").alias("held"), end), "texts")

    # keys of one text only are of no use
    postings = firsts.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    sizes = stored(postings.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1"), "list-sizes")
    shared = stored(postings.join(sizes, "key"), "shared-postings")
    discard(firsts, sizes)

    # long lists with a text in common make one crowd; copies of each other name the same few pairs of lists
    long = shared.filter(F.col("size") > crowded).select("node", "key")
    least = cut(long.groupBy("node").agg(F.min("key").alias("least")))
    joint = long.join(least, "node").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    lists = connected_components(joint).withColumnRenamed("v", "least")
    crowds = cut(least.join(lists, "least", "left").select("node", F.coalesce("component", "least").alias("crowd")))

    # one pair a text: by fingerprint, else by its lists
    short = shared.filter(F.col("size") <= crowded)
    hashed = cut(_fingerprint_pairs(heads.filter("n > 0").select("node", "fp")))
    pairs = cut(hashed.unionByName(_list_pairs(short).join(hashed.select("b"), "b", "left_anti")))
    sets = _sets_of(docs, shingle, pairs.select("a"), pairs.select("b"))
    edges = cut(_verified(sets, pairs, similarity))
    discard(sets)
    sets = _sets_of(docs, shingle, crowds.select("node"))
    edges = edges.unionByName(cut(_crowd_links(sets, crowds, similarity, part)))
    discard(sets)

    # all other pairs
    classes = connected_components(edges).select(F.col("v").alias("node"), F.col("component").alias("c"))
    apart = stored(short.join(classes, "node", "left").select("key", "node", "n", "at", F.coalesce("c", "node").alias("c")), "short-postings")
    discard(shared)
    pairs = cut(_met(apart, heads.filter("n > 0").select("node", "n", "held", "end"), similarity))
    discard(apart)
    sets = _sets_of(docs, shingle, pairs.select("a"), pairs.select("b"))
    edges = edges.unionByName(_verified(sets, pairs, similarity))

    classes = connected_components(edges).select(F.col("v").alias("node"), "component")
    placed = heads.select("node", "head").join(classes, "node", "left").select("node", "head", F.coalesce("component", "node").alias("c"))
    first = placed.groupBy("c").agg(F.min("head").alias("component_id"))
    found = placed.join(first, "c").select("node", "component_id")
    result = cut(rows.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(rows, heads, sets)
    return result


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class (see :func:`similar_documents`), unchanged.

    One row for each such doc_id stays, of a null doc_id too; of rows that share it the one whose text has the
    smallest hash.  Null and empty texts are one class; an empty table stays empty.  All columns keep their names.
    """
    first = similar_documents(docs, shingle, similarity).select(F.col("component_id").alias("first")).distinct()
    key, rank = free_name(docs, "first"), free_name(docs, "rank")
    kept = docs.join(first.withColumnRenamed("first", key), docs["doc_id"].eqNullSafe(F.col(key)))
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
