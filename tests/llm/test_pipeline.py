"""The stages, each on its own input, against the operators' own verdicts."""

import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sedimenta.llm import linededup, repetition, simhash, toxicity
from sedimenta.llm.common import stored
from sedimenta.llm.token_ids import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scored(docs, toxicity.learn(docs, labels)).filter("predicted = 1").collect()}
    good = {r.doc_id for r in repetition.judged(docs).filter("kept").collect()}
    first = {r.component_id for r in simhash.similar_documents(docs).collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    outs = {name: stages[name](spark, docs, SF) for name in ("toxicity", "quality rules", "line dedup", "near dedup")}
    assert all(df.columns == docs.columns for df in outs.values())
    assert ids(outs["toxicity"]) == ids(docs) - bad
    assert ids(outs["quality rules"]) == good
    assert ids(outs["near dedup"]) == first
    gone = linededup.line_classes(docs).filter(f"not kept and len >= {linededup.SHORT}").count()
    count = lambda df: sum((r.text or "").count("\n") + 1 for r in df.select("text").collect() if r.text)
    emptied = sum(1 for r in outs["line dedup"].select("text").collect() if r.text == "") - sum(1 for r in docs.select("text").collect() if r.text == "")
    assert count(docs) - count(outs["line dedup"]) in range(gone, gone + emptied + 1)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.doc_id, r.start) for r in rows}) == len(rows)
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) == 2048 and sum(n < 2048 for n in used.values()) <= 1


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def groups(n, edges):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def naive_stages(docs, lexicon):
    """Documents (id, text) after each filtering stage, by comparing everything with everything."""

    def score(text):
        folded = toxicity.fold(text)
        places = lambda x: [(i, i + len(x)) for i in range(len(folded)) if folded.startswith(x, i)]
        spared = [s for p in lexicon.exceptions for s in places(toxicity.fold(p))]
        total = sum(w for e, w in lexicon.weights.items() for a, b in places(e) if not any(x <= a and b <= y for x, y in spared))
        return lexicon.score(total / (1 + folded.count(" ") / 100) ** lexicon.exponent if total else 0.0)

    docs = [(d, t) for d, t in docs if score(t) < toxicity.THRESHOLD]
    yield docs

    def kept(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)

        def repeated(k):
            """Places covered by windows of k words that occur twice or more."""
            windows = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
            return {i + j for i in range(n - k + 1) if windows[tuple(words[i : i + k])] > 1 for j in range(k)}

        return n >= 50 and 100 * len(repeated(3)) <= 50 * n and len(repeated(repetition.MIN_REPEAT)) <= repetition.MAX_COVERED * n and not repeated(repetition.MAX_LONGEST + 1)

    docs = [(d, t) for d, t in docs if kept(t)]
    yield docs

    lines = sorted({x for _, t in docs for x in t.split("\n") if len(x) >= linededup.SHORT and x.strip(linededup.BLANKS)}, key=len)
    edges = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            b = lines[j]
            if len(b) > len(a) + linededup.EDITS:
                break
            most = linededup.allowed(len(a), len(b))
            if linededup.banded_distance(a, b, most) <= most:
                edges.append((i, j))
    group, seen, out = dict(zip(lines, groups(len(lines), edges))), set(), []
    for d, t in sorted(docs):
        stay = []
        for x in t.split("\n"):
            if x in group:
                if group[x] in seen:
                    continue
                seen.add(group[x])
            stay.append(x)
        out.append((d, "\n".join(stay)))
    docs = out
    yield docs

    sets = [shingle_set(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = [docs[i] for i, g in enumerate(groups(len(docs), pairs)) if i == g]
    yield docs


def test_stages_against_naive_ones(spark):
    """Every filtering stage on what the one before kept, and the packed ids of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000").cache()
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = list(naive_stages([(r.doc_id, r.text) for r in docs.collect()], lexicon))
    assert len(expected[0]) > len(expected[1]) > len(expected[3]) and expected[1] != expected[2]
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(wanted)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in expected[3]}
    held = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id] += r.length
    assert held == {d: len(x) for d, x in ids.items()}


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
