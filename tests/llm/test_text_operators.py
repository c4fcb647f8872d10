"""Operators on whole texts against plain re-computation: BPE, token files, quality, packing, licenses, sharding."""

import hashlib
import re
import struct
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sedimenta.llm import bpe, licenses, packing, repetition, sharding, token_files, token_ids
from sedimenta.llm.token_ids import ChunkEncoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_chunk_encoder_equals_the_library(odd_rows, byte_tokenizer):
    small = ChunkEncoder(BYTE, most=64)  # turn-overs all the time
    for _ in range(2):
        for _, text in odd_rows:
            assert np.frombuffer(small.encode(text), "<u4").tolist() == byte_tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(documents, odd, empty):
    t = Tokenizer.from_file(WORD)
    for df in (documents, odd):
        expected = []
        for doc_id, text in pairs_of(df):
            ids = t.encode(text or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        got = [tuple(r) for r in bpe.encode_and_decode(df, WORD).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
    assert bpe.encode_and_decode(empty, WORD).count() == 0


def test_merge_takes_the_lowest_rank_then_the_leftmost():
    ranks = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert bpe.merge([1, 1, 1], ranks) == [3]
    assert bpe.merge([1, 1, 1, 1], ranks) == [4]
    assert bpe.merge([5], ranks) == [5] and bpe.merge([], ranks) == []


@pytest.mark.parametrize("high", [1, 2, 300, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_frames_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype("u4")
    ids[::97] = 2**32 - 1  # outliers go to the exception lists
    assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_file_in_doc_id_order(spark, documents, odd, empty, byte_tokenizer, tmp_path):
    for k, df in enumerate((documents, odd)):
        token_files.write_token_file(df, f"file://{tmp_path}/{k}", BYTE)
        got = token_files.read_token_file(spark, f"file://{tmp_path}/{k}").collect()
        start, expected = 0, []
        for doc_id, text in sorted(((d, t or "") for d, t in pairs_of(df)), key=key):
            ids = byte_tokenizer.encode(text, add_special_tokens=False).ids + [2]
            expected.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    token_files.write_token_file(empty, f"file://{tmp_path}/none", BYTE)
    assert token_files.read_token_file(spark, f"file://{tmp_path}/none").count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    triples = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    marked = {i + k for i in range(n - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def brute_repeats(words):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        docs = [rng.integers(0, rng.choice([1, 2, 5, 30]), rng.integers(0, 40)).tolist() for _ in range(4)] + [[7] * 30]
        document = np.repeat(np.arange(5), [len(d) for d in docs])
        got = repetition.longest_repeats(np.array(sum(docs, []), dtype=np.int64), document)
        assert got.tolist() == sum(map(brute_repeats, docs), [])


def test_quality(documents, odd, empty):
    for df in (documents, odd):
        rows = repetition.judged(df).collect()
        expected = Counter((d, *brute_quality(t)) for d, t in pairs_of(df))
        assert Counter(tuple(r)[:6] for r in rows) == expected
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.repeat_covered <= repetition.MAX_COVERED * r.n_words and r.repeat_longest <= repetition.MAX_LONGEST)
    assert repetition.judged(empty).count() == 0
    kept = repetition.without_repetitive(odd)
    assert kept.columns == odd.columns and kept.count() == repetition.judged(odd).filter("kept").count()


def test_covered_fraction_alone_rejects(spark):
    """Nine passages of twelve words, twice each, in a text of 500 words: the base rules pass, the covered fraction is 0.43."""
    rng = np.random.default_rng(2)
    word = iter(rng.permutation(10_000).tolist())
    passages = [[f"p{next(word)}" for _ in range(12)] for _ in range(9)]
    words = []
    for p in passages + passages:
        words += p + [f"w{next(word)}" for _ in range(15)]
    words += [f"w{next(word)}" for _ in range(500 - len(words))]
    r = repetition.judged(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert r.n_words == 500 and r.repeat_covered == 216 and r.repeat_longest == 12 and not r.base_failed and not r.kept
    assert repetition.judged(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), max_covered=0.5).first().kept


def test_repeats_of_a_very_long_text():
    """A million words; a passage of 70,000 occurs twice."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 50_000, 1_000_000)
    words[900_000:970_000] = words[100_000:170_000]
    best = repetition.longest_repeats(words, np.zeros(len(words), dtype=np.int64))
    assert best.max() >= 70_000 and best[100_000] >= 70_000 and best[900_000] == best[100_000] and int((best >= 1000).sum()) < 141_000


def check_packing(df, byte_tokenizer, window=2048):
    rows = packing.pack(df, BYTE, window).collect()
    pool = Counter()
    for doc_id, text in pairs_of(df):
        pool[doc_id, tuple(byte_tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    # the pieces of each document, put together by start, give its ids
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, pieces in by_doc.items():
        expected = Counter()
        for (d, ids), n in pool.items():
            if d == doc_id:
                starts = {(p.start, p.length) for p in pieces if p.doc_tokens == len(ids)}
                for a, k in starts:
                    expected[a, k, crc(ids[a : a + k]), len(ids)] += 0
        assert sum(p.length for p in pieces) == sum(len(ids) * n for (d, ids), n in pool.items() if d == doc_id)
        assert {(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces} <= set(expected)
    assert set(by_doc) == {d for d, _ in pool}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padded += at < window
    assert padded <= 1
    assert sorted(sequences) == list(range(len(sequences)))
    return rows


def test_packing(documents, odd, empty, byte_tokenizer):
    check_packing(documents, byte_tokenizer)
    check_packing(odd, byte_tokenizer)
    check_packing(odd, byte_tokenizer, window=7)
    assert packing.pack(empty, BYTE).count() == 0


def test_fill_is_the_best_multiset():
    rng = np.random.default_rng(3)
    for _ in range(200):
        window = int(rng.integers(5, 40))
        counts = Counter(int(x) for x in rng.integers(1, window, rng.integers(1, 9)))
        first = max(counts)
        items = list((counts - Counter([first])).elements())
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        best = max(s for s in sums if s + first <= window) + first
        got = packing.fill(counts, first, window)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def brute_license(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts = {label: [i for i in range(len(words)) if words[i : i + len(p)] == p] for label, p in ((x, y.split()) for x, y in licenses.BASE)}
    every = sorted(sum(starts.values(), []))
    return words, starts, every


def test_licenses(spark, documents, odd, empty):
    extra = spark.createDataFrame(
        [(900, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (901, "All rights reserved. x CC BY-NC 4.0"), (902, "mit mit license license"),
         (903, "GNU Lesser General Public License and general public license"), (904, "the license of the mit")], "doc_id long, text string",
    )
    for df in (documents, odd.select("doc_id", "text").unionByName(extra)):
        rows = sorted(licenses.scanned(df).collect(), key=key)
        expected = []
        for doc_id, text in pairs_of(df):
            words, starts, every = brute_license(text)
            base = ",".join(sorted(x for x, s in starts.items() if s))
            expected.append((doc_id, len(words), len(every), every[0] if every else None, every[-1] if every else None, base))
        assert [tuple(r)[:6] for r in rows] == sorted(expected, key=key)
        for r in rows:
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[900].labels == "apache,mit" and by_id[900].score == 1.0
    assert by_id[901].labels == "cc-by,cc-by-nc,proprietary" or by_id[901].labels == "cc-by-nc,proprietary"
    assert by_id[902].labels == "mit" and by_id[903].labels == "gpl,lgpl" and by_id[904].labels == ""
    assert licenses.scanned(empty).count() == 0


def test_every_notice_counts_however_many_or_common(spark):
    every = ". ".join(notice for _, notice, _ in licenses.TEMPLATES)
    rows = [(i, "some prose. all rights reserved. more prose") for i in range(20)] + [(20, every), (21, "plain prose")]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].labels == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert all(got[i].labels == "proprietary" and got[i].score == 1.0 for i in range(20)) and got[21].labels == ""


def test_license_scan_is_native(documents):
    plan = licenses.scanned(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sharding(spark, documents, odd, empty, tmp_path):
    for k, df in enumerate((documents, odd, empty)):
        sharding.write_shards(df, f"file://{tmp_path}/{k}", shards=16, bucket_bytes=4096)
        rows = spark.read.parquet(f"file://{tmp_path}/{k}").collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(pairs_of(df))
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        sizes = [len(slots.get(s, [])) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(16))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the outcome doesn't depend on how the input arrives
    sharding.write_shards(documents.repartition(7), f"file://{tmp_path}/again", bucket_bytes=4096)
    place = lambda p: sorted((r.doc_id, r.shard, r.slot) for r in spark.read.parquet(f"file://{tmp_path}/{p}").collect())
    assert place("again") == place("0")


def test_shards_computed_again(spark, documents, tmp_path):
    """Bucket, permutation and place of every record, worked out row by row."""
    sharding.write_shards(documents, f"file://{tmp_path}/s", shards=5, seed=3, bucket_bytes=20_000)
    rows = spark.read.parquet(f"file://{tmp_path}/s").collect()
    h = {(r.doc_id, r.text): (r.h, r.s) for r in documents.selectExpr("doc_id", "text", "xxhash64(doc_id, text) h", "xxhash64(xxhash64(doc_id, text), 3) s").collect()}
    size = sum(len((t or "").encode()) + 16 for _, t in h)
    buckets = {}
    for record, (name, scattered) in h.items():
        buckets.setdefault(scattered % -(-size // 20_000), []).append((record[0], name, record))
    order = []
    for b in sorted(buckets):
        records = [x[2] for x in sorted(buckets[b], key=lambda x: x[:2])]
        order += [records[i] for i in sharding.fisher_yates(len(records), 3, b)]
    small, large = divmod(len(order), 5)
    ends = np.cumsum([small + (s < large) for s in range(5)])
    shard = lambda g: int(np.searchsorted(ends, g, side="right"))
    expected = {r: (shard(g), g - (int(ends[shard(g) - 1]) if shard(g) else 0)) for g, r in enumerate(order)}
    assert {(r.doc_id, r.text): (r.shard, r.slot) for r in rows} == expected


def test_copies_are_scattered(spark, tmp_path):
    rows = spark.range(100_000, numPartitions=4).selectExpr("cast(1 as bigint) doc_id", "'one and the same record' text").unionByName(spark.range(2000).selectExpr("id doc_id", "'own' text"))
    sharding.write_shards(rows, f"file://{tmp_path}/c", bucket_bytes=50_000)
    sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/c").groupBy("bucket").count().collect()]
    assert sum(sizes) == 102_000 and max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 50


def test_equal_rows_share_the_token_file(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=4).selectExpr("cast(null as bigint) doc_id", "'one and the same record' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small to be left apart otherwise
    try:
        token_files.write_token_file(rows, f"file://{tmp_path}/t", BYTE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(f"file://{tmp_path}/t").groupBy("part").sum("n_ids").collect()
    assert len(parts) > 1 and token_files.read_token_file(spark, f"file://{tmp_path}/t").count() == 20_000


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(100, 1, 2)) == list(range(100))
    assert (sharding.fisher_yates(100, 1, 2) == sharding.fisher_yates(100, 1, 2)).all()
    assert (sharding.fisher_yates(100, 1, 2) != sharding.fisher_yates(100, 1, 3)).any()


def test_workers_give_encoders_back():
    """A worker that goes on with another operator keeps no encoder; ids are the same afterwards."""
    path = tokenizer_path("byte_bpe_50k.json")
    ids = token_ids.encoder(path).encode("some words, again and again")
    assert token_ids._ENCODERS
    token_ids.forget_encoders()
    assert not token_ids._ENCODERS and token_ids.encoder(path).encode("some words, again and again") == ids


def test_encoder_takes_many_texts_at_once(byte_tokenizer, monkeypatch):
    """The library's ids; each different chunk of all texts is encoded once, even by a worker that keeps none."""
    parts = ["a", "Wörd", "x.", "(y)%%%", "don't", "日本", "ɐb", "<|endoftext|>", "\t", "\r\n", "\x00", "\x1f", "", " ", "\n", "\n\n"]
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\n", "\na", "a\n", *("".join(parts[i] + " \n"[j : j + 1] for i, j in rng.integers(0, (len(parts), 3), (k % 9, 2))) for k in range(3000))]
    expected = [array("I", byte_tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert ChunkEncoder(BYTE).encode_all(pa.array(texts, kind)) == expected
    assert ChunkEncoder(BYTE, most=2000).encode_all(pa.array(texts).slice(7, 900)) == expected[7:907]
    assert ChunkEncoder(BYTE).encode_all(pa.array([], pa.string())) == []
    monkeypatch.setattr(token_ids, "SLICE", 4)
    assert ChunkEncoder(BYTE).encode_all(pa.array(texts)) == expected
    monkeypatch.undo()
    encoder, asked = ChunkEncoder(BYTE, most=0), []
    for chunks in (encoder.first, encoder.rest):
        chunks.piece = lambda text, piece=chunks.piece: asked.append(text) or piece(text)
    text = "one two three one two three"
    assert encoder.encode_all(pa.array([text] * 50)) == [ChunkEncoder(BYTE).encode(text)] * 50
    assert sorted(asked) == [" one", " three", " two", "one"]


def test_words_with_marks_behind_go_to_the_model(byte_tokenizer):
    """Runs of marks are encoded once, not once a word."""
    encoder, asked = ChunkEncoder(BYTE), []
    encoder.rest.whole = lambda text, whole=encoder.rest.whole: asked.append(text) or whole(text)
    text = "x " + " ".join(f"{a}{b}{m}" for a in "abcd" for b in "abcd" for m in ("%%%", ")", "\"", "|>", "_", "-"))
    assert encoder.encode(text) == array("I", byte_tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert set(asked) == {"%%%", ")", "\"", "|>", "_", "-"}


@pytest.mark.parametrize("width", range(1, 33))
def test_block_layout(width):
    """The lowest bit of a block's first difference comes first, whatever the width."""
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 512, dtype=np.uint64).astype("u4")
    ids[::256], ids[1::256] = 0, (1 << width) - 1
    payload = token_files.pack(ids, percentile=1)
    size, at = 32 * width, 20
    for block in ids.reshape(2, 256):
        bits = [(int(v) >> k) & 1 for v in block for k in range(width)]
        assert payload[at : at + 7] == struct.pack("<IBH", 0, width, 0)
        assert payload[at + 7 : at + 7 + size] == np.packbits(bits, bitorder="little").tobytes()
        at += 7 + size
    assert at == len(payload) and (token_files.unpack(payload) == ids).all()


def test_encoder_holds_the_words_of_a_large_corpus():
    """300,000 different words still are in a worker's dictionary when they come again."""
    encoder = ChunkEncoder(BYTE)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:300_000]
    ids = encoder.encode(" ".join(["x", *words]))
    assert all(word in encoder.rest or word in encoder.rest.old for word in words)
    assert encoder.encode(" ".join(["x", *words])) == ids
