"""Near-duplicate operators against comparisons of all pairs, and toxicity against its labels."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sedimenta.llm import embeddings, linededup, repetition, simhash, toxicity
from sedimenta.llm.common import connected_components


def key(row):
    return tuple((v is not None, v) for v in row)


def components(n, edges):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_that_differ_each_time(spark):
    """Links that only connect may be others when they are worked out again, as those of a crowd are."""

    def star(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            middle = random.SystemRandom().choice(ids)
            rest = [i for i in ids if i != middle]
            yield pa.RecordBatch.from_arrays([pa.array([middle] * len(rest), pa.int64()), pa.array(rest, pa.int64())], names=["a", "b"])

    found = connected_components(spark.range(0, 500, 1, 1).mapInArrow(star, "a long, b long")).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0) for i in range(500)]


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    group = components(len(rows), edges)
    first = {}
    for (doc_id, _), g in zip(rows, group):
        first[g] = min((x for x in (first.get(g), doc_id) if x is not None), default=None)
    expected = [(doc_id, f"{fp:016x}", first[g]) for (doc_id, _), fp, g in zip(rows, fps, group)]
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    return len({g for g in group})


def test_simhash(documents, odd, empty):
    check_simhash(documents)
    check_simhash(odd)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = {r.component_id for r in simhash.similar_documents(odd).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == sorted(ids, key=lambda x: (x is None, x))


def shingles(text, k=5):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def test_similar_documents(spark, documents, odd, empty):
    rng = random.Random(8)
    base = [["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)] for n in (30, 80, 200)]
    texts = []
    for _ in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # the second way: nearly every list is a crowd, compared in parts of four texts
    for df, options in ((made, {}), (made, {"crowded": 1, "part": 4}), (documents, {}), (odd.select("doc_id", "text"), {})):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        sets = [shingles(t) for _, t in rows]
        edges = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        group = components(len(rows), edges)
        first = {}
        for (d, _), g in zip(rows, group):
            first[g] = min((x for x in (first.get(g), d) if x is not None), default=None)
        expected = sorted(((d, first[g]) for (d, _), g in zip(rows, group)), key=key)
        got = sorted((tuple(r) for r in simhash.similar_documents(df, **options).collect()), key=key)
        assert got == expected
    assert simhash.similar_documents(empty).count() == 0


def _pairs_of_edited_texts(edit, n=120):
    """Pairs of texts of their own vocabulary, at least 0.8 alike, far from all others: (rows, mean similarity)."""
    rng = random.Random(21)
    rows, alike = [], []
    while len(rows) < 2 * n:
        words = [f"{len(rows)}w{rng.randrange(10**6)}" for _ in range(300)]
        other = edit(rng, list(words))
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        similarity = len(a & b) / len(a | b)
        if 0.8 <= similarity < 1:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            alike.append(similarity)
    return rows, sum(alike) / len(alike)


def _appended(rng, words):
    return words + [f"new{rng.randrange(10**6)}" for _ in range(rng.randint(60, 74))]


def _truncated(rng, words):
    return words[: rng.randint(242, 250)]


def _block(rng, words):
    at, size = rng.randint(0, 250), rng.randint(20, 28)
    words[at : at + size] = [f"new{rng.randrange(10**6)}" for _ in range(size)]
    return words


@pytest.mark.parametrize("edit", [_appended, _truncated, _block])
def test_similar_documents_of_contiguous_edits(spark, edit):
    rows, mean = _pairs_of_edited_texts(edit)
    assert 0.8 <= mean < 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.similar_documents(df).collect()) == [(d, d - d % 2) for d, _ in rows]


def test_similar_documents_that_repeat_a_passage(spark):
    rng = random.Random(22)
    rows = []
    for times in (2, 4, 8) * 20:
        words = [f"{len(rows)}w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + words[100:130] * times))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.similar_documents(df).collect()) == [(d, d - d % 2) for d, _ in rows]


def test_near_copies_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Lists of up to 32 near copies: about one pair a text is verified, and all copies are one class."""
    rng = random.Random(3)
    rows = []
    for group in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for copy in range(20):
            words = list(base)
            words[rng.randrange(300)] = f"x{copy}"
            words[rng.randrange(300)] = f"y{copy}"
            rows.append((20 * group + copy, " ".join(words)))
    verified, seen = simhash._verified, []

    def counting(sets, pairs, similarity):
        seen.append(pairs.count())
        return verified(sets, pairs, similarity)

    monkeypatch.setattr(simhash, "_verified", counting)
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in found) == [(d, d - d % 20) for d, _ in rows]
    assert sum(seen) <= 2 * len(rows)  # 950 pairs are alike


def test_similar_documents_link_fingerprints_first(spark, monkeypatch):
    """What the byte-position index links is verified; texts that it links but that aren't alike stay apart."""
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, " ".join(f"v{i}" for i in range(400)))]
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < (fps[0] ^ fps[2]).bit_count()
    linked, links = [], simhash.links

    def noted(fps, *more):
        found = links(fps, *more)
        linked.append({frozenset(r) for r in found.collect()})
        return found

    monkeypatch.setattr(simhash, "links", noted)
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0), (1, 0), (2, 2)]
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    assert signed[0] == signed[1] or linked == [{frozenset(signed[:2])}]
    assert len(linked) == 1
    # every fingerprint linked with every other one: only texts that are alike become one class
    monkeypatch.setattr(simhash, "links", lambda fps, *more: fps.crossJoin(fps.toDF("g")).filter("fp < g").toDF("a", "b"))
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0), (1, 0), (2, 2)]


def test_linking_pairs_connect_what_all_pairs_do():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**60, 120))
    sets = [np.zeros(0, dtype=np.int64)]
    for _ in range(150):
        kept = rng.random(len(base)) > rng.choice([0.02, 0.06, 0.1, 0.2])
        sets.append(np.unique(np.r_[base[kept], rng.integers(0, 2**60, int((~kept).sum()))]))
    alike = lambda i, j: len(common := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(common)) and len(common) > 0
    for apart in (None, rng.random(len(sets)) < 0.5):
        a, b = simhash.linking_pairs(np.arange(len(sets)), sets, 0.8, apart)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j) and (apart is None or apart[i] != apart[j])]
        assert components(len(sets), list(zip(a, b))) == components(len(sets), pairs) and len(a) < len(sets) and set(map(frozenset, zip(a, b))) <= set(map(frozenset, pairs))


@pytest.mark.parametrize("hot", [2, 64, 100_000])
def test_links_by_both_ways(spark, hot):
    rng = random.Random(hot)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1, 2**63]
    fps = set(seeds)
    for s in seeds:  # a crowd around each, and a crowd that shares half of its bits
        for _ in range(25):
            fps.add(s ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
            fps.add(s & (2**64 - 2**32) | rng.getrandbits(32))
    fps = sorted(fps)
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    expected = components(len(fps), edges)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, hot).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all((fps[at[a]] ^ fps[at[b]]).bit_count() <= 2 for a, b in found)
    assert components(len(fps), [(at[a], at[b]) for a, b in found]) == expected


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_and_probes():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        b, d = "".join(b), 0
        d = edit_distance(a, b)
        for most in (1, 2, 3):
            assert linededup.banded_distance(a, b, most) == min(d, most + 1)
        if d <= 2 and len(b) >= 3 and len(a) >= 3:
            short, long = sorted((a, b), key=len)
            posted = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(linededup.segments(len(short)))}
            assert posted & {(n, i, long[p : p + size]) for n, i, p, size, _ in linededup.probes(len(long))}


@pytest.fixture(scope="module")
def lined(spark):
    """Lines with edits at all places, of lengths on both sides of the bounds, with repeats and ties."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé 日") for _ in range(n)) for n in (5, 19, 20, 21, 39, 40, 41, 60, 90) for _ in range(3)]
    lines = list(base)
    for _ in range(160):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "d"])
        lines.append("".join(b))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(-(-len(lines) // 4))]
    docs += [(500, None), (501, ""), (502, "\n \n\t\n"), (503, docs[0][1]), (503, docs[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()


def brute_lines(docs):
    rows = [(d, k, x) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    distinct = sorted({x for _, _, x in rows})
    edges = [(i, j) for i, a in enumerate(distinct) for j in range(i) if abs(len(a) - len(distinct[j])) <= 2
             and 0 < edit_distance(a, distinct[j]) <= linededup.allowed(len(a), len(distinct[j]))]
    group = dict(zip(distinct, components(len(distinct), edges)))
    degree = Counter(distinct[i] for e in edges for i in e)
    first = {}
    for d, k, x in rows:
        first[group[x]] = min(first.get(group[x], (d, k)), (d, k))
    return rows, [(d, k, *first[group[x]], degree[x], first[group[x]] == (d, k)) for d, k, x in rows]


def test_lines_against_all_pairs(lined, odd, empty):
    docs = [(r.doc_id, r.text) for r in lined.collect()]
    rows, expected = brute_lines(docs)
    got = [tuple(r) for r in linededup.line_classes(lined).drop("len").collect()]
    assert sorted(got) == sorted(expected) and any(r[4] for r in expected)
    assert linededup.line_classes(empty).count() == 0
    linededup.line_classes(odd).count()

    out = {}
    for r in linededup.without_repeated_lines(lined).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    verdict = {(d, k): keep for d, k, _, _, _, keep in expected}
    for d, t in docs:
        if t is None:
            assert out[d] == [None]
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if verdict.get((d, k), True) or len(x) < linededup.SHORT]
        assert "\n".join(kept) in out[d]
    same = linededup.without_repeated_lines(odd)
    assert same.columns == odd.columns and same.count() == odd.count()


def test_removal_goes_by_row(spark):
    """Rows that share a doc_id lose only their own lines; equal rows share their fate; odd column names come back."""
    a, b, x = ("the letter a, twenty times over", "the second line of the seventh", "a line that occurs only once in all")
    rows = [(1, a, 1, "f"), (7, f"{a}\n{b}", 2, "g"), (7, f"{x}\n{b} too", 3, "h"), (None, x + "!", 4, "i"), (None, None, 5, "j"), (9, f"{b}\nown words of nine, all of them", 6, "k"), (9, f"{b}\nown words of nine, all of them", 6, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone long, __flags string").withColumn("gone", F.lit("mine")).withColumn("row", F.lit(0))
    out = linededup.without_repeated_lines(df)
    assert out.columns == df.columns
    got = {r["__gone"]: (r.doc_id, r.text, r["__flags"], r.gone) for r in out.collect()}
    assert got[1] == (1, a, "f", "mine") and got[2] == (7, b, "g", "mine") and got[5] == (None, None, "j", "mine")
    assert got[4][1] == x + "!" and got[3][0] == 7
    assert got[6] == (9, "own words of nine, all of them", "k", "mine")
    tiny = spark.createDataFrame([(1, "A"), (7, "A\nB"), (7, "X\nY")], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in linededup.without_repeated_lines(tiny, shortest=0).collect()}
    assert kept == {(1, "A"), (7, "B"), (7, "X\nY")}


def test_filters_of_empty_tables(empty):
    for run in (linededup.without_repeated_lines, simhash.one_of_each, repetition.without_repetitive, lambda df: toxicity.without_toxic(df, toxicity.Lexicon({" bad ": 1.0}))):
        out = run(empty)
        assert out.columns == empty.columns and out.count() == 0


def test_names_shared_by_different_lines_do_not_merge_them(spark, monkeypatch):
    """With a name of four values nearly every line shares one; classes still hold equal lines only."""
    monkeypatch.setattr(linededup, "_line_id", lambda raw: raw[0] & 3)
    lines = [f"{w} line number {i} of several" for i, w in enumerate("abcdefgh")]
    docs = spark.createDataFrame([(i, f"{x}\n{lines[0]}") for i, x in enumerate(lines)], "doc_id long, text string").coalesce(1)
    rows = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in linededup.line_classes(docs).collect()}
    assert all(rows[i, 0] == (i, 0) and rows[i, 1] == (0, 0) for i in range(8))


def brute_vectors(rows):
    unit, at = [], []
    for i, (_, label, v) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, dtype=np.float64)
        unit.append(a / np.linalg.norm(a))
        at.append(i)
    edges = []
    for p, i in enumerate(at):
        for q, j in enumerate(at[:p]):
            if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and unit[p] @ unit[q] >= embeddings.THRESHOLD:
                edges.append((i, j))
    degree = Counter(i for e in edges for i in e)
    group = components(len(rows), edges)
    first = {}
    for i, g in enumerate(group):
        first[g] = min(first.get(g, rows[i][0]), rows[i][0])
    return [(v, degree[i], first[group[i]], first[group[i]] == v) for i, (v, _, _) in enumerate(rows)]


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.standard_normal(16).astype("f4").tolist()) for i in range(150)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, 0, (centre + 0.12 * rng.standard_normal(16)).astype("f4").tolist()) for i in range(60)]  # a crowd
    rows += [(2000 + i, r[1], [x * 2 for x in r[2]]) for i, r in enumerate(rows[:10])] + [(2100 + i, r[1], r[2]) for i, r in enumerate(rows[:5])]
    rows += [(3000, 0, None), (3001, 0, [0.0] * 16), (3002, None, rows[0][2]), (3003, 0, [float("nan")] * 16), (3004, 0, [None] + rows[0][2][1:]), (3005, 0, []), (3006, 0, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("node", F.lit("x")).repartition(4)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = {tuple(r) for r in embeddings.near_duplicates(df).collect()}
    expected = set(brute_vectors(rows))
    assert got == expected
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    named = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert {tuple(r) for r in embeddings.near_duplicates(named).collect()} == expected


def test_vectors_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    expected = set(brute_vectors([(r.vec_id, r.label, r.embedding) for r in df.collect()]))
    got = {tuple(r) for r in embeddings.near_duplicates(df).collect()}
    assert got == expected


def linked_clusters(rng, clusters=6, copies=12, dim=32):
    """Near copies around centres that are about 0.95 alike."""
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    centres = [0.975 * q[0] + 0.222 * q[1 + c] for c in range(clusters)]
    return [(i, 0, (centres[i % clusters] + 0.002 * rng.standard_normal(dim)).astype("f4").tolist()) for i in range(clusters * copies)]


def test_vectors_of_linked_clusters(spark):
    rows = linked_clusters(np.random.default_rng(6))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    expected = set(brute_vectors(rows))
    assert {r[2] for r in expected} == {0} and min(r[1] for r in expected) == 71
    assert {tuple(r) for r in embeddings.near_duplicates(df).collect()} == expected


def test_audit_sees_lone_pairs_beside_a_crowd(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    rows = [(i, 0, (centre + 0.05 * rng.standard_normal(64)).tolist()) for i in range(200)]
    for i in range(200, 400, 2):
        v = rng.standard_normal(64)
        rows += [(i, 0, v.tolist()), (i + 1, 0, (v + 0.05 * rng.standard_normal(64)).tolist())]
    nodes = embeddings.nodes_of(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    n = {i: 199 if i < 200 else 1 for i in range(400)}
    assert embeddings.audit(nodes, spark.createDataFrame(list(n.items()), "node long, n long"), embeddings.THRESHOLD) == 1.0
    lost = [(i, x) for i, x in n.items() if i < 360]  # a fifth of the pairs
    assert 0.7 < embeddings.audit(nodes, spark.createDataFrame(lost, "node long, n long"), embeddings.THRESHOLD) < 0.9


def test_fold():
    assert toxicity.fold("An 1D10T,  а fооl！") == " an idiot a fool "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" .,") == " "


def test_exceptions_and_length():
    lex = toxicity.Lexicon({" trash ": 2.0, " vequ": 1.0}, exponent=0.5, cut=1.0)
    a = lex.automaton()
    assert lex.raw(toxicity.fold("the trash can"), a) == 0
    assert lex.raw(toxicity.fold("TRASH"), a) > lex.raw(toxicity.fold("TRASH" + " word" * 500), a) > 0
    assert len(lex.matches(toxicity.fold("vequx avequ vequ trash"), a)) == 3
    assert lex.score(0) == 0 and abs(lex.score(1.0) - 0.7) < 1e-12 and lex.score(50) <= 1
    assert toxicity.Lexicon({}).raw(" a ", toxicity.Lexicon({}).automaton()) == 0


def test_toxicity_on_held_out_labels(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs, lexicon).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = [r.predicted for r in rows if r.toxic]
    assert right > 0.95 and sum(found) / len(found) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    # labels of rows that are held out change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped).weights == lexicon.weights
    scored = toxicity.scored(odd, lexicon).collect()
    assert len(scored) == odd.count() and all(r.held_out is not None for r in scored)
    assert toxicity.without_toxic(odd, lexicon).columns == odd.columns
    assert toxicity.learn(empty, labels).weights == {} and toxicity.scored(empty, lexicon).count() == 0


def naive_raw(lexicon, text):
    """Every entry and phrase looked for at every place of the folded text."""
    folded = toxicity.fold(text)
    places = lambda x: [(i, i + len(x)) for i in range(len(folded)) if folded.startswith(x, i)]
    spared = [s for p in lexicon.exceptions for s in places(toxicity.fold(p))]
    total = sum(w for e, w in lexicon.weights.items() for a, b in places(e) if not any(x <= a and b <= y for x, y in spared))
    return total / (1 + folded.count(" ") / 100) ** lexicon.exponent if total else 0.0


def test_scores_against_naive_matching(spark, documents, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = toxicity.learn(docs, labels)
    assert learned.weights
    common = toxicity.Lexicon({" the ": 0.5, " an": 0.25, " alph": 1.0, "er ": 0.125}, (*learned.exceptions, "the same", "alpha beta"), 0.5, 2.0)
    for lexicon in (learned, common):
        for df in (documents, odd.select("doc_id", "text")):
            rows = [(r.doc_id, r.text) for r in df.collect() if len(r.text or "") < 20_000]
            got = {}
            for r in toxicity.scored(df, lexicon).collect():
                got.setdefault(r.doc_id, []).append(r.score)
            for doc_id, text in rows:
                expected = lexicon.score(naive_raw(lexicon, text))
                assert any(abs(x - expected) < 1e-9 for x in got[doc_id])


def test_fit_takes_one_text_for_each_id(spark):
    a, b = [i for i in range(20) if crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(a, f"text {i}") for i in range(50)] + [(b, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).count() == 2 and toxicity.training_rows(docs, labels, 1).count() == 1


def test_copies_of_a_text_do_not_make_entries():
    support = {" natural ": (1000, 1), " insult ": (40, 30)}
    assert set(toxicity.select_entries(support, {}, 1100, 9000)) == {" insult "}


def test_few_edges_are_united_by_one_task(spark):
    """The same components as the rounds give, from a few jobs whatever the length of the chains."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-600, 600, (700, 2))] + [(k, k + 1) for k in range(5000, 5200)] + [(-(2**63), 2**63 - 1), (7000, 7000), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "")
    few = connected_components(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, connected_components(df, few=0).collect()))
    assert jobs <= 8


@pytest.mark.parametrize("parts", [1, 2, 7, 8, 9, 20, 33])
def test_parts_of_a_crowd_meet_in_rounds(spark, parts):
    """Every two parts meet in one round, and no round has a text more than a fixed number of times."""
    crowds = spark.range(40 * parts).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("crowd"))
    sizes = spark.createDataFrame([(1, parts)], "crowd long, parts int")
    met = []
    for k in range(parts // 2 // simhash.ROUND + 1):
        rows = simhash._meetings(crowds, sizes, k)
        assert rows.groupBy("node").count().agg(F.max("count")).first()[0] <= 2 * simhash.ROUND
        met += [tuple(r) for r in rows.select("part", "other").distinct().collect()]
    assert sorted(met) == [(a, b) for a in range(parts) for b in range(parts)]


def test_links_of_a_large_crowd(spark):
    sets = spark.range(400).selectExpr("id as node", "array_sort(transform(sequence(0, 19), j -> xxhash64(case when j < 18 then id div 2 else id + 1000000 end, j))) as hashes")
    crowds = sets.select("node", F.lit(7).cast("long").alias("crowd"))
    found = {tuple(sorted(r)) for r in simhash._crowd_links(sets, crowds, 0.8, 20).collect()}
    assert found == {(i, i + 1) for i in range(0, 400, 2)}
