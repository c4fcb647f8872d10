"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node.  The first neighbour graph comes from blocks of a few random
hyperplane codes; each round then joins, at every node, its neighbours with each other (neighbours of
neighbours, both directions) and keeps every node's nearest ones.  Links are pairs at or above the threshold,
found in double precision; a comparison also gives the links that connect all it found linked, whether or not
a list has room for them.  A node whose list holds only links is saturated: its list goes on with neighbours
outside its component, until those end below the threshold, and its component is compared in full, block by
block.  An audit compares bounded samples of nodes, those with few links apart, with all rows and asks for
another round, with new codes, while recall is under ``TARGET``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import connected_components, cut, stored, table

THRESHOLD = 0.93
NEIGHBOURS = 8
TABLES = 4
BLOCK = 256
ROUNDS = 4  # without a new link, at most
AUDITED = 192  # nodes with at least NEIGHBOURS links in an audit
FEW_AUDITED = 2048  # nodes with fewer links in an audit, most of them with none
TARGET = 0.99
SEED = 7


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, each: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Apply ``each`` to every run of equal values in the first ``keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        start = 0
        for i in range(len(values) + 1):
            if i == len(values):
                held.append(batch.slice(start))
                last = values[-1]
            elif i and values[i] != values[i - 1] or not i and held and values[0] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield from each(pa.Table.from_batches(held))
                held, start = [], i
    if held:
        yield from each(pa.Table.from_batches(held))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all that the symmetric boolean matrix connects; fewer than it has rows."""
    fresh = near.any(axis=1)
    i, j = [], []
    for root in range(len(near)):
        front = [root] if fresh[root] else []
        fresh[root] = False
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & fresh).tolist()
            fresh[found] = False
            i += [at] * len(found)
            j += found
            front += found
    return np.array(i, dtype=np.int64), np.array(j, dtype=np.int64)


def _pairs_schema() -> str:
    return "u long, v long, sim double"


def _emit(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``node, label, vec, copies``: distinct usable vectors of each label, named by their smallest vec_id.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components have no node.
    """
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    usable = vectors.select("vec_id", "label", "embedding").filter(fine & F.coalesce(finite, F.lit(False)) & some)
    return usable.groupBy("label", F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Each u's k nearest v; pairs may repeat."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return pairs.dropDuplicates(["u", "v"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("u", "v", "sim")


def first_graph(nodes: DataFrame, k: int, threshold: float, tables: int = TABLES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Pairs inside blocks of random hyperplane codes: each node's nearest of another ``home``, and connecting links.

    Labels and dimensions don't mix.
    """
    sizes = nodes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("size"))
    sized = nodes.withColumn("dim", F.size("vec")).join(sizes, ["label", "dim"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            out = []
            for dim, part in frame.groupby("dim"):
                x = _unit(part["vec"].tolist())
                bits = np.maximum(0, np.ceil(np.log2(part["size"].to_numpy() / block))).astype(int)
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), 40))
                    signs = (x @ planes) > 0
                    code = (signs * (np.arange(40)[None, :] < bits[:, None])) @ (1 << np.arange(40, dtype=np.int64))
                    out.append(pd.DataFrame({"label": part["label"], "dim": int(dim), "t": t, "code": code, "node": part["node"], "home": part["home"], "vec": part["vec"]}))
            if out:
                yield from pa.Table.from_pandas(pd.concat(out), preserve_index=False, schema=pa.schema(
                    [("label", pa.string()), ("dim", pa.int32()), ("t", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("home", pa.int64()), ("vec", pa.list_(pa.float64()))]
                )).to_batches()

    coded = sized.select(F.col("label").cast("string"), "dim", "size", "node", "home", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        codes, "label string, dim int, t int, code long, node long, home long, vec array<double>"
    )
    # a crowded code is dealt into parts of about the block's size
    counts = coded.groupBy("label", "dim", "t", "code").agg(F.ceil(F.count("*") / block).alias("parts"))
    keys = ["label", "dim", "t", "code"]
    dealt = coded.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")))
    dealt = dealt.select(F.xxhash64(*keys, "part").alias("block"), "t", "label", "node", "home", "vec")

    def inside(run: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, homes = run["node"].to_numpy(), run["home"].to_numpy()
        if len(ids) < 2:
            return
        x = _unit(run["vec"].to_pylist())
        near = np.zeros((len(ids), len(ids)), dtype=bool)
        for at in range(0, len(ids), 2 * BLOCK):
            s = x[at : at + 2 * BLOCK] @ x.T
            s[homes[at : at + 2 * BLOCK, None] == homes[None, :]] = -2
            near[at : at + 2 * BLOCK] = s >= threshold
            top = np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k]
            sims = np.take_along_axis(s, top, axis=1)
            u = np.repeat(ids[at : at + 2 * BLOCK], top.shape[1])
            keep = sims.ravel() > -2
            yield _emit(u[keep], ids[top].ravel()[keep], sims.ravel()[keep])
        i, j = _forest(near | near.T)
        yield _emit(ids[i], ids[j], (x[i] * x[j]).sum(axis=1).clip(threshold))

    ordered = dealt.repartition("block").sortWithinPartitions("block", "t", "label")
    found = ordered.select("block", "t", "label", "node", "home", "vec").mapInArrow(lambda b: _runs(b, 3, inside), _pairs_schema())
    return found


def descend(nodes: DataFrame, graph: DataFrame, lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: at every node, compare its neighbours in ``graph`` (out and in) of different ``home`` with each other.

    Gives the pairs nearer than the worst of u's ``lists``, and links that connect all that are linked.
    """
    # in-lists are as long as the out-lists; the nearest holders come first
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    incoming = graph.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * k).select(F.col("v").alias("at"), F.col("u").alias("node"))
    members = graph.select(F.col("u").alias("at"), F.col("v").alias("node")).unionByName(incoming).distinct()
    worst = lists.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") < k, F.lit(-2.0)).otherwise(F.col("worst")).alias("worst"))
    about = nodes.select("node", "home", F.col("vec").cast("array<double>").alias("vec")).join(worst, "node", "left")
    met = members.join(about, "node").select("at", "node", "home", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec")

    def inside(run: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, worst_of = run["node"].to_numpy(), run["worst"].to_numpy()
        if len(ids) < 2:
            return
        x = _unit(run["vec"].to_pylist())
        s = x @ x.T
        homes = run["home"].to_numpy()
        s[homes[:, None] == homes[None, :]] = -2
        i, j = np.nonzero(s > worst_of[:, None])
        near = s >= threshold
        p, q = _forest(near | near.T)
        i, j = np.r_[i, p], np.r_[j, q]
        if len(i):
            sims = s[i, j]
            sims[len(i) - len(p) :] = sims[len(i) - len(p) :].clip(threshold)
            yield _emit(ids[i], ids[j], sims)

    found = met.repartition("at").sortWithinPartitions("at").mapInArrow(lambda b: _runs(b, 1, inside), _pairs_schema())
    return found


def links_of(graph: DataFrame, threshold: float) -> DataFrame:
    """Distinct links (a < b) of a neighbour graph."""
    near = graph.filter(F.col("sim") >= threshold)
    return near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a < b").distinct()


def saturated(graph: DataFrame, threshold: float, k: int) -> DataFrame:
    """``v`` of the nodes whose list is full and holds only links."""
    full = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    return full.filter((F.col("n") >= k) & (F.col("worst") >= threshold)).select(F.col("u").alias("v"))


def crossing(nodes: DataFrame, graph: DataFrame, links: DataFrame, threshold: float, k: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(links, components) with the lists of saturated nodes gone on with, outside their component.

    Ends when none of those lists has a link: every link found here joins two components.
    """
    full = cut(saturated(graph, threshold, k))
    while True:
        components = connected_components(links)
        home = components.join(full, "v").select(F.col("v").alias("node"), F.col("component").alias("home"))
        apart = stored(nodes.drop("home").join(home, "node"), "saturated")
        if apart.select("home").distinct().limit(2).count() < 2:
            return links, components
        first = cut(first_graph(apart, k, threshold, seed=seed))
        lists = cut(_nearest(first, k))
        found = descend(apart, graph.unionByName(lists).select("u", "v", "sim"), lists, k, threshold)
        new = cut(links_of(first.unionByName(found), threshold))
        if new.isEmpty():
            return links, components
        links, seed = cut(links.unionByName(new).distinct()), seed + 1


def counted(
    nodes: DataFrame, graph: DataFrame, links: DataFrame, components: DataFrame, threshold: float, k: int, block: int = BLOCK
) -> DataFrame:
    """(node, n) numbers of linked vectors of other nodes, with saturated lists enlarged to their components."""
    crowded = cut(components.join(saturated(graph, threshold, k), "v").select("component").distinct())
    copies = nodes.select("node", "copies")

    # lists that aren't saturated hold all their links
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    settled = both.join(components.join(crowded, "component", "left_anti").select(F.col("v").alias("a")), "a")
    plain = settled.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("n")).withColumnRenamed("a", "node")

    # the others are compared with everything in their component, in pairs of parts
    inside = cut(components.join(crowded, "component").select(F.col("v").alias("node"), "component").join(nodes, "node"))
    parts = inside.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = inside.join(parts, "component").withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    task = lambda role, i, j: dealt.select("component", "part", "node", "copies", F.col("vec").cast("array<double>").alias("vec"), other).select(
        F.xxhash64("component", i, j).alias("task"), "component", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(role).alias("role"), "node", "copies", "vec"
    )
    rows = task(0, "part", "other").unionByName(task(1, "other", "part"))

    def compare(run: pa.Table) -> Iterator[pa.RecordBatch]:
        role = run["role"].to_numpy()
        ids, copies_of = run["node"].to_numpy(), run["copies"].to_numpy()
        x = _unit(run["vec"].to_pylist())
        left, right = role == 0, role == 1
        if left.any() and right.any():
            near = (x[left] @ x[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
            n = near @ copies_of[right]
            yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(n, pa.int64())], names=["node", "n"])

    ordered = rows.repartition("task").sortWithinPartitions("task", "component", "i", "j").select("task", "component", "i", "j", "role", "node", "copies", "vec")
    crowd = ordered.mapInArrow(lambda b: _runs(b, 4, compare), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return plain.select("node", "n").unionByName(crowd.select("node", "n"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, sample: int = AUDITED, few: int = FEW_AUDITED, k: int = NEIGHBOURS) -> float:
    """Mean share of a node's true links that ``found(node, n)`` has, over bounded samples of nodes that have any.

    Nodes found with ``k`` links or more and those with fewer are sampled apart, and the lesser of the two means
    counts, so that a crowd can't outvote lone pairs; 1.0 if no sampled node has links.
    """
    known = nodes.select("node", "label", "vec").join(found.select("node", "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = (F.xxhash64("node", F.lit(SEED)), "node")
    held = known.filter(F.col("n") >= k).orderBy(*order).limit(sample).collect() + known.filter(F.col("n") < k).orderBy(*order).limit(few).collect()
    if not held:
        return 1.0
    by_label: dict = {}
    for r in held:
        by_label.setdefault((r.label, len(r.vec)), []).append(r)
    queries = {key: (np.array([r.node for r in rows]), _unit([r.vec for r in rows])) for key, rows in by_label.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = [], []
            frame = batch.to_pandas()
            for key, part in frame.groupby(["label", frame["vec"].map(len)]):
                for at in range(0, len(part) if key in queries else 0, 1024):  # bounded memory
                    rows = part.iloc[at : at + 1024]
                    names, q = queries[key]
                    near = (q @ _unit(rows["vec"].tolist()).T >= threshold) & (names[:, None] != rows["node"].to_numpy()[None, :])
                    ids += names.tolist()
                    sums += (near @ rows["copies"].to_numpy()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], names=["node", "true_n"])

    true = nodes.select("label", F.col("vec").cast("array<double>").alias("vec"), "node", "copies").mapInArrow(search, "node long, true_n long")
    true = {r.node: r.true_n for r in true.groupBy("node").agg(F.sum("true_n").alias("true_n")).collect()}
    shares: dict[bool, list[float]] = {}
    for r in held:
        if true.get(r.node):
            shares.setdefault(r.n >= k, []).append(min(1.0, r.n / true[r.node]))
    return min((sum(x) / len(x) for x in shares.values()), default=1.0)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, rounds: int = ROUNDS, target: float = TARGET
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, label, embedding)``.

    Rows without a node (see :func:`nodes_of`) link with nothing.  Equal vectors of a label link with each
    other.  ``n_links`` counts other rows; ``component_id`` is the smallest vec_id reachable.  Rounds go on
    while the audit's recall is under ``target``, until ``rounds`` of them in a row found no new link; the last
    recall is logged, as a warning if it is under.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    nodes = stored(nodes_of(vectors).withColumn("home", F.col("node")), "vectors")

    def grown(graph: DataFrame | None, links: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = cut(found)
        new = links_of(found, threshold)
        if graph is None:
            return cut(_nearest(found, k)), cut(new)
        return cut(_nearest(graph.unionByName(found), k)), cut(links.unionByName(new).distinct())

    graph, links = grown(None, None, first_graph(nodes, k, threshold))
    graph, links = grown(graph, links, descend(nodes, graph, graph, k, threshold))
    most, idle, seed = -1, 0, SEED
    while True:
        links, components = crossing(nodes, graph, links, threshold, k, seed)
        numbers = cut(counted(nodes, graph, links, components, threshold, k))
        recall = audit(nodes, numbers, threshold)
        total = numbers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        idle, most = (0, total) if total > most else (idle + 1, most)
        if recall >= target or idle >= rounds:
            break
        seed += 1
        found = first_graph(nodes, k, threshold, seed=seed).unionByName(descend(nodes, graph, graph, k, threshold))
        graph, links = grown(graph, links, found)
    logging.getLogger(__name__).log(logging.INFO if recall >= target else logging.WARNING, "recall of the last audit %.4f, asked for %.4f", recall, target)
    classes = (
        nodes.join(numbers, "node", "left").join(components.withColumnRenamed("v", "node"), "node", "left")
        .select("label", F.col("vec").alias("embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    )
    joined = vectors.join(classes, ["label", "embedding"], "left")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the whole ``embeddings`` table."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embeddings": op10_embeddings}
# every pair of a label in full; fine for a few thousand vectors
ORACLE_SQL = {
    "op10_embeddings": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a AS s, b AS t FROM links UNION SELECT r.s, l.b FROM reach r JOIN links l ON r.t = l.a),
least AS (SELECT s, min(t) AS t FROM reach GROUP BY s), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, coalesce(d.n, 0) AS n_links, least(x.vec_id, coalesce(m.t, x.vec_id)) AS component_id, x.vec_id <= coalesce(m.t, x.vec_id) AS kept
FROM embeddings x LEFT JOIN degree d ON d.a = x.vec_id LEFT JOIN least m ON m.s = x.vec_id
"""
}
