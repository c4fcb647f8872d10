"""Tables, containers, modes, storage and the string surface."""

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalar as S
from sedimenta.plans import resolve as R
from sedimenta.sources import config
from sedimenta.sources.engine import AlreadyOpen, Engine
from sedimenta.sources.strings import StringApi, halves_hash, open_database, text_hash


class Clock:
    now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture(params=["persistent", "ultra"])
def db(spark, tmp_path, clock, request):
    with Engine.open(spark, f"file://{tmp_path}/db", mode=request.param, clock=clock) as engine:
        yield engine


def visit(url, visits, ts, title="Page"):
    return {"url_hash": text_hash(url), "ts_ms": ts, "url": url, "title": title, "visit_count": visits}


def test_ranked_search(db):
    db.history().insert([visit("https://a.example/x", 5, 10), visit("https://b.EXAMPLE/y", 50, 9), visit("https://other/z", 100, 8, "none")])
    assert [r.visit_count for r in db.history().hot_search("Example", 10).collect()] == [50, 5]
    assert [r.visit_count for r in db.history().hot_search("", 2).collect()] == [100, 50]
    assert db.history().hot_search("", 0).count() == 0
    db.history().insert([visit("https://t1", 7, 1), visit("https://t2", 7, 2)])
    assert [r.url for r in db.history().hot_search("https://t", 5).collect()] == ["https://t2", "https://t1"]


def test_ttl_and_counters(db, clock):
    h = db.history()
    h.insert_with_ttl([visit("u1", 1, 0)], 1)
    h.insert_with_ttl([visit("u2", 1, 0)], 60_000)
    clock.now += 1
    assert h.count() == 2  # the last millisecond counts
    clock.now += 1
    assert h.count() == 1 and h.get(text_hash("u1")) is None
    h.increment(text_hash("u2"), 4)
    h.increment(text_hash("u2"), 5)
    assert h.get(text_hash("u2")).visit_count == 10
    clock.now += 100_000
    assert h.count() == 1  # an increment clears the time to live
    h.delete({"url_hash": text_hash("u2")})
    assert h.count() == 0
    h.increment(text_hash("u2"), 7)
    assert h.get(text_hash("u2")).visit_count == 7
    assert h.purge_expired() == 1 and h.purge_expired() == 0
    h.compact()
    assert h.get(text_hash("u2")).visit_count == 7


def test_wipe_domain_and_wipe(db):
    h = db.history()
    h.insert([visit("https://evil.com/track", 1, 0), visit("https://fine.org", 1, 0), visit("https://x.org/?r=evil.com", 1, 0)])
    assert h.wipe_domain("evil.com") == 2 and h.count() == 1 and h.wipe_domain("evil.com") == 0
    assert db.stats().first().total_count == 1
    db.wipe()
    assert db.stats().first().total_count == 0 and h.count() == 0
    h.insert(visit("https://again", 1, 0))
    assert h.count() == 1


def test_cookies_cache_bookmarks_settings(db):
    db.cookies().insert([{"domain_hash": "0a", "name": "sid", "value": "1", "expiry_s": 9, "flags": S.SECURE | S.HTTP_ONLY, "path": "/", "domain": "d"}, {"domain_hash": "0b", "name": "p", "value": "2", "expiry_s": 9}])
    c = db.cookies().get("0a", "sid")
    assert c.flags == 3 and db.cookies().get("0b", "p").path == "" and db.cookies().get("0b", "sid") is None
    assert db.cookies().count() == 2
    db.cookies().delete({"domain_hash": "0a", "name": "sid"})
    assert [r.name for r in db.cookies().rows().collect()] == ["p"]
    db.cache().insert({"url_hash": "0c", "headers": "h", "body": b"\x00\x01", "etag": "e", "last_modified_ms": 1})
    assert bytes(db.cache().get("0c").body) == b"\x00\x01" and db.cache().get("0d") is None
    db.bookmarks().insert({"url_hash": text_hash("u"), "url": "u", "title": "t", "folder": "f", "created_at": 1})
    assert db.bookmarks().get_all().count() == 1
    db.bookmarks().delete({"url_hash": text_hash("u")})
    assert db.bookmarks().count() == 0
    db.settings().set("theme", "dark")
    db.settings().set("theme", "light")
    assert db.settings().get("theme") == "light" and db.settings().get("none") is None
    db.settings().remove("theme")
    assert db.settings().get("theme") is None


def test_local_store_query(db):
    ls = db.localstore()
    origin = text_hash("o")
    ls.insert([{"origin_hash": origin, "key": f"prefixed_key_{i:03}", "value": f"v{i % 2}"} for i in range(20)])
    ls.insert_with_index({"origin_hash": origin, "key": "k_only", "value": "v"}, ["key"])
    ls.insert_with_index({"origin_hash": origin, "key": "k_default", "value": "v"}, [])
    assert [r.key for r in ls.query().value_eq("v").execute().collect()] == ["k_default"]
    assert ls.query().value_eq("v1").filter(F.col("key") > "prefixed_key_005").limit(3).execute().count() == 3
    assert ls.query().filter(lambda key, value: key.endswith("7") and value == "v1", "key", "value").execute().count() == 2
    assert ls.query().limit(0).execute().count() == 0
    assert ls.query().prefix(bytes.fromhex(origin)[::-1]).execute().count() == 22
    assert ls.query().prefix(b"\x01" + bytes.fromhex(origin)[::-1]).execute().count() == 0
    with pytest.raises(ValueError):
        ls.insert_with_index({"origin_hash": origin, "key": "a", "value": "b"}, ["colour"])
    ls.remove(origin, "k_only")
    assert ls.get(origin, "k_only") is None and ls.clear_origin(origin) == 21 and ls.count() == 0


def test_binary_prefix_and_order(db):
    b = db.binarystore()
    b.put([{"key": k, "value": v} for k, v in ((b"cherry", b"red"), (b"apple", b"red"), (b"banana", b"yellow"), (b"\xff\xff", b"x"))])
    assert [bytes(r.key) for r in b.all_entries().collect()] == [b"apple", b"banana", b"cherry", b"\xff\xff"]
    assert [bytes(r.key) for r in b.scan_prefix(b"a").collect()] == [b"apple"]
    assert [bytes(r.key) for r in b.scan_prefix(b"\xff").collect()] == [b"\xff\xff"]
    assert [bytes(r.key) for r in b.iterate()][0] == b"apple"
    b.put(b"apple", b"x" * 200_000)
    assert len(b.get(b"apple")) == 200_000
    b.delete(b"apple")
    assert b.get(b"apple") is None
    b.batch([{"key": b"n", "value": b"1"}], [{"key": b"cherry"}])
    assert b.count() == 3


def test_hash_keys_order_little_endian(db):
    hashes = [f"{i:032x}" for i in (1, 2, 255, 256, 257)]
    db.bookmarks().insert([{"url_hash": h, "url": h, "title": "", "folder": "", "created_at": 0} for h in hashes])
    assert [int(r.url_hash, 16) for r in db.bookmarks().get_all().collect()] == [256, 1, 257, 2, 255]


def test_containers_and_names(db):
    db.container("normal").settings().set("theme", "light")
    db.container("private-1").settings().set("theme", "dark")
    assert db.container("normal").settings().get("theme") == "light"
    assert db.settings().get("theme") is None
    for bad in ("", "a/b", "a b", "../x"):
        with pytest.raises(ValueError):
            db.container(bad)


def test_mode_round_trip(db, clock):
    db.history().insert_with_ttl(visit("a", 3, 1), 50)
    other = {"persistent": "ultra", "ultra": "persistent"}
    first = db.container("default").mode
    db.set_mode(other[first])
    db.history().insert(visit("b", 4, 2))
    db.history().delete({"url_hash": text_hash("zzz")})
    assert db.history().count() == 2
    db.set_mode(first)
    assert {r.url for r in db.history().rows().collect()} == {"a", "b"}
    clock.now += 100
    assert db.history().count() == 1


def test_lock_and_reopen(spark, tmp_path):
    path = f"file://{tmp_path}/locked"
    with Engine.open(spark, path) as first:
        first.settings().set("a", "1")
        with pytest.raises(AlreadyOpen):
            Engine.open(spark, path)
        assert open_database(spark, path) is None
        assert Engine.open(spark, path, lock=False).settings().get("a") == "1"
    with Engine.open(spark, path) as again:
        assert again.settings().get("a") == "1"


def test_unfinished_batch_is_invisible(spark, tmp_path):
    with Engine.open(spark, f"file://{tmp_path}/torn") as db:
        db.settings().set("kept", "1")
        db.settings().set("lost", "1")
        log = db.settings().log
        log._files.delete(f"{log._root}/_commits/{log.batches()[-1]}")
        assert db.settings().get("kept") == "1" and db.settings().get("lost") is None


def test_string_surface(spark, tmp_path):
    api = open_database(spark, f"file://{tmp_path}/strings")
    assert isinstance(api, StringApi)
    h = int(text_hash("https://example.com"), 16)
    low, high = h & (2**64 - 1), h >> 64
    assert halves_hash(low, high) == text_hash("https://example.com") == "13fc431128cb6c796f14ce4cebdfbbcb"
    assert api.history_insert("https://example.com", "Example") == 0 and api.history_get_title(low, high) == "Example"
    assert api.history_increment(low, high) == 0
    assert api.localstore_insert("o", "k", "v") == 0 and api.localstore_get("o", "k") == "v"
    seen = []
    assert api.localstore_get_all("o", lambda k, v: seen.append((k, v))) == 0 and seen == [("k", "v")]
    assert api.localstore_clear("o") == 0 and api.localstore_get("o", "k") is None
    assert api.settings_set("a", "b") == 0 and api.settings_get("a") == "b" and api.settings_remove("a") == 0 and api.settings_get("a") is None
    assert api.close() == 0


def test_config():
    assert config.parse(None).lsm_tree.max_level0_files == 4
    assert config.parse("[lsm_tree]\nmax_level0_files = 9").lsm_tree.max_level0_files == 4  # a part of the table is an error
    full = "[lsm_tree]\nmax_level0_files = 9\nmax_memtable_size_mb = 1\nlevel_thresholds_mb = [1, 2]\n[heatmap]\nmax_entries = 5"
    assert config.parse(full).lsm_tree.max_level0_files == 9 and config.parse(full).heatmap.max_entries == 5
    assert config.parse("= broken") == config.Config()


def counter_log(spark, *ops):
    rows = [("k", i, op, v, 0) if not isinstance(v, tuple) else ("k", i, op, v[0], v[1]) for i, (op, v) in enumerate(ops)]
    return spark.createDataFrame(rows, "k string, seq long, op string, val long, expires_at long")


@pytest.mark.parametrize(
    ("ops", "expected"),
    [
        ([("put", 5), ("inc", 2), ("inc", 3)], 10),
        ([("inc", 1), ("del", None), ("inc", 7)], 7),
        ([("put", 9), ("del", None)], None),
        ([("inc", 4)], 4),
        ([("put", (1, 1000))], 1),
        ([("put", (1, 999))], None),
        ([("put", (1, 999)), ("inc", 1)], 2),
        ([("put", 2**63 - 1), ("inc", 1)], -(2**63)),
    ],
)
def test_counter_rules(spark, ops, expected):
    log = counter_log(spark, *ops)
    rows = R.resolve_counters(log, ["k"], F.col("val"), F.col("val"), 1000).collect()
    assert [r.value for r in rows] == ([] if expected is None else [expected])


def test_compaction_keeps_the_meaning(spark):
    older = counter_log(spark, ("put", 10), ("inc", 1)).filter("seq < 2")
    newer = counter_log(spark, ("put", 0), ("put", 0), ("inc", 5), ("inc", 6)).filter("seq >= 2")
    part = R.compacted(newer, ["k"], F.col("val"), F.col("val"), final=False).withColumnRenamed("value", "val").select(older.columns)
    assert part.first().op == "inc"
    whole = R.resolve_counters(older.unionByName(part), ["k"], F.col("val"), F.col("val"), 1000)
    assert whole.first().value == 22


def test_prefix_range_is_pushed(spark, tmp_path):
    spark.createDataFrame([(b"a1",), (b"b",)], "key binary").write.parquet(f"{tmp_path}/keys")
    plan = spark.read.parquet(f"{tmp_path}/keys").filter(S.has_prefix(F.col("key"), b"a"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert S.successor(b"a\xff") == b"b" and S.successor(b"\xff") is None


def test_fnv_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("https://example.com",), ("default",), ("ü" * 300,)], "s string").select("s", S.fnv1a128(F.col("s")).alias("h"))
    assert all(r.h == text_hash(r.s) for r in rows.collect())
    assert text_hash("") == "6c62272e07bb014262b821756295c58d"


def test_stream_ingest_into_a_log(spark, tmp_path):
    from sedimenta.streaming.ingest import append_to

    source = [(f"k{i}", "put", (f"v{i}",), None, i, 0, i) for i in range(5)]
    ddl = "key string, op string, row struct<value: string>, delta bigint, ts_ms bigint, expires_at bigint, pos bigint"
    spark.createDataFrame(source, ddl).write.parquet(f"{tmp_path}/in")
    with Engine.open(spark, f"file://{tmp_path}/db") as db:
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        append_to(db.settings().log, f"{tmp_path}/checkpoint", stream).awaitTermination()
        assert db.settings().get("k3") == "v3" and db.settings().count() == 5
        append_to(db.settings().log, f"{tmp_path}/checkpoint", stream).awaitTermination()
        assert db.settings().count() == 5


def test_increments_wrap_around(db):
    h = db.history()
    h.insert(visit("u", 2**63 - 1, 0))
    h.increment(text_hash("u"), 1)
    assert h.get(text_hash("u")).visit_count == -(2**63)
    h.increment(text_hash("new"), 2**63 - 1)
    h.increment(text_hash("new"), 2**63 - 1)
    assert h.get(text_hash("new")).visit_count == -2


def test_a_micro_batch_counts_once(db, spark):
    h = db.history()
    h.insert(visit("u", 1, 0))
    one = h._mutations(h._frame({"url_hash": text_hash("u")}, "url_hash string"), "inc", delta=F.lit(1))
    assert h.log.append(one, source=("stream", 0)) is not None
    assert h.log.append(one, source=("stream", 0)) is None  # retried after a failure
    assert h.log.append(one, source=("stream", 1)) is not None and h.log.append(one, source=("other", 0)) is not None
    assert h.get(text_hash("u")).visit_count == 4
    h.compact()
    assert h.log.append(one, source=("stream", 1)) is None and h.get(text_hash("u")).visit_count == 4


def test_many_commits_fold(db):
    s = db.settings()
    for i in range(25):
        s.set(f"k{i % 7}", str(i))
    assert {r.key: r.value for r in s.rows().collect()} == {f"k{i % 7}": str(i) for i in range(18, 25)}
    log = s.log
    if hasattr(log, "_root"):
        assert any(n.endswith(".all") for n in log._files.names(f"{log._root}/_commits"))
        assert len(log._files.names(f"{log._root}/_commits")) < 25


def test_later_writes_win_after_a_mode_round_trip(db):
    other = {"persistent": "ultra", "ultra": "persistent"}
    first = db.container("default").mode
    for mode in (other[first], first, other[first], first):
        for i in range(12):
            db.settings().set("k", f"{mode}{i}")
        db.set_mode(mode)
        db.settings().set("k", mode)
        assert db.settings().get("k") == mode


def test_levels_cascade(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "sedimenta.toml").write_text("[lsm_tree]\nmax_level0_files = 3\nmax_memtable_size_mb = 1\nlevel_thresholds_mb = [0, 1000]\nverify_checksums = true")
    with Engine.open(spark, f"file://{tmp_path}/db") as db:
        h = db.history()
        h.insert([visit("a", 1, 0), visit("b", 1, 0)])
        h.increment(text_hash("a"), 1)
        assert h.maintain() == []
        h.delete({"url_hash": text_hash("b")})
        assert h.maintain() == [0, 1]  # the first result makes level 1 due, the second rests at level 2
        assert list(h.log.levels()) == [2]
        h.increment(text_hash("a"), 5)
        h.increment(text_hash("a"), 5)
        h.delete({"url_hash": text_hash("zz")})
        assert h.maintain() == [0, 1] and sorted(h.log.levels()) == [2]
        rows = h.log.read()
        assert rows.filter("op = 'inc' and delta = 10").count() == 1 and rows.filter("op = 'del'").count() == 1  # their base lies deeper
        assert h.get(text_hash("a")).visit_count == 12 and h.count() == 1
        assert h.maintain() == []


def test_batches_are_sorted_and_have_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    with Engine.open(spark, f"file://{tmp_path}/db") as db:
        db.settings().put([{"key": f"k{i * 7919 % 1000:04}", "value": "v"} for i in range(1000)])
        files = list((tmp_path / "db" / "container=default" / "settings" / "data").rglob("*.parquet"))
        for f in files:
            keys = pq.read_table(f).column("key").to_pylist()
            assert keys == sorted(keys)
        plan = db.settings().find(key="k0007")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(key,k0007)" in plan and db.settings().get("k0007") == "v"


def test_damaged_pages_are_told(spark, tmp_path):
    import random

    value = random.Random(1).randbytes(10_000)
    for name, verify in (("checked", "true"), ("unchecked", "false")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "sedimenta.toml").write_text(f"[lsm_tree]\nmax_level0_files = 4\nmax_memtable_size_mb = 1\nlevel_thresholds_mb = [10]\nverify_checksums = {verify}")
        with Engine.open(spark, f"file://{tmp_path}/{name}") as db:
            db.binarystore().put(b"key", value)
            holding = [f for f in (tmp_path / name).rglob("part-*.parquet") if value[5000:5040] in f.read_bytes()]
            assert holding
            for f in holding:
                raw = bytearray(f.read_bytes())
                raw[raw.find(value[5000:5040])] ^= 255
                f.write_bytes(raw)
                f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            if verify == "true":
                with pytest.raises(Exception, match="(?i)checksum|crc"):
                    db.binarystore().get(b"key")
            else:
                assert db.binarystore().get(b"key") != value


def test_heat_of_reads_and_writes(db, clock):
    s = db.settings()
    s.set("a", "1")
    for _ in range(3):
        s.get("a")
    now = clock.now // 1000
    assert s.heat.heat(("settings", "a"), now) == 2 + 3 and s.heat.heat(("settings", "b"), now) == 0
    assert s.heat.heat(("settings", "a"), now + 120) == int(5 * 0.95**2)
    s.remove("a")
    assert s.heat.heat(("settings", "a"), now) == 8


def test_heat_map_is_bounded():
    from sedimenta.operators.heat import HeatMap

    heat = HeatMap(config.HeatConfig(max_entries=64, hot_threshold=3))
    for i in range(1000):
        heat.record(("t", i), "read", 0)
    assert len(heat) <= 64
    for _ in range(5):
        for i in range(1000, 1064):
            heat.record(("t", i), "write", 0)
    hot = [i for i in range(1000, 1064) if heat.heat(("t", i), 0) >= 3]
    for i in range(2000, 3000):
        heat.record(("t", i), "read", 0)
    assert all(heat.heat(("t", i), 0) >= 3 for i in hot)  # keys at the threshold stay


def test_lock_of_a_dead_process(spark, tmp_path):
    path = f"file://{tmp_path}/stale"
    Engine.open(spark, path)  # never closed
    with pytest.raises(AlreadyOpen):
        Engine.open(spark, path, stale_after_s=3600)
    with Engine.open(spark, path, stale_after_s=-1) as db:
        db.settings().set("a", "1")


def test_purge_counts_and_memory(db, clock):
    db.settings().put([{"key": "a", "value": "1"}, {"key": "b", "value": "1"}], ttl_ms=5)
    db.settings().set("c", "1")
    db.history().insert(visit("u", 1, 0))
    clock.now += 6
    counts = db.purge_counts()
    assert counts["settings"] == 2 and sum(counts.values()) == 2 and db.purge_expired() == 0
    if db.container("default").mode == "ultra":
        assert db.settings().log.read().count() == 1


def test_own_index(db):
    ls = db.localstore()
    ls.insert([{"origin_hash": text_hash("o"), "key": k, "value": v} for k, v in (("a", "red apple"), ("b", "green pear"), ("c", "none"))])
    ls.add_index("second", F.when(F.instr("value", " ") > 0, F.split_part("value", F.lit(" "), F.lit(2))))
    assert [r.key for r in ls.by_index("second", "pear").collect()] == ["b"] and ls.index_entries("second").count() == 2


def test_bytes_at_the_string_surface(spark, tmp_path):
    api = open_database(spark, f"file://{tmp_path}/bytes")
    assert api.settings_set(b"caf\xc3\xa9", b"bad \xff") == 0 and api.settings_get("café") == "bad \ufffd"
    assert api.settings_get(b"caf\xc3\xa9") == "bad \ufffd" and api.settings_get(b"\xff") is None
    api.close()


def test_key_prefix_counts_bytes(spark):
    rows = spark.createDataFrame([("ab:c:d",), ("ééééé",), ("né:x",), ("",), (":",)], "k string").select(S.key_prefix(F.col("k")).alias("p")).collect()
    assert [bytes(r.p) for r in rows] == [b"ab:", "éééé".encode(), "né:".encode(), b"", b":"]


def test_crc32_is_that_of_zlib(spark):
    import zlib

    texts = ["", "a", "naïve 日本", "x" * 10_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.crc32(F.col("t").cast("binary")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == {t: zlib.crc32(t.encode()) for t in texts}


def test_tags(spark):
    from sedimenta.sources.schema import table_of_tag

    rows = spark.range(0, 10).select("id", table_of_tag(F.col("id")).alias("t")).collect()
    assert [r.t for r in rows] == ["history", "history", "cookies", "cache", "localstore", "settings", "bookmarks", "binarystore", "history", "history"]


def test_bloom_filter(spark):
    from sedimenta.operators import bloom

    bits, hashes = bloom.shape(5000, 0.01)
    assert hashes == 6 or hashes == 7 or bits == bloom.PAGE_BITS
    pages = bloom.built(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k")), "k", bits, hashes)
    found = bloom.may_contain(spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("k")), "k", pages, bits, hashes)
    counts = found.groupBy((F.col("id") < 5000).alias("held")).count().collect()
    counts = {r.held: r["count"] for r in counts}
    assert counts[True] == 5000 and counts.get(False, 0) < 600


def test_state_that_expires(spark, tmp_path):
    """A row with a time to live is reported, then given back once event time has passed it."""
    from sedimenta.streaming.ingest import expiring_values

    ddl = "k string, val long, op string, ts_ms long, expires_at long"
    batches = [[("a", 1, "put", 1000, 5000), ("b", 2, "put", 1000, 0)], [("c", 3, "put", 9000, 0)], [("b", 0, "del", 9500, 0), ("d", 4, "put", 9600, 0)], [("e", 5, "put", 20000, 0)]]
    seen = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = expiring_values(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect()))
        q.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert seen.count(("a", "1", True)) == 1 and seen.count(("a", "1", False)) == 1 and ("b", None, False) in seen
    assert ("c", "3", True) in seen and ("e", "5", True) in seen and ("c", "3", False) not in seen


def test_large_values_stand_apart(db):
    b = db.binarystore()
    large = [bytes([i]) * (65_537 + i) for i in range(3)]
    b.put([{"key": b"a", "value": large[0]}, {"key": b"b", "value": b"x" * 65_536}, {"key": b"c", "value": large[1]}])
    on_disk = db.container("default").mode == "persistent"
    if on_disk:
        assert b.blobs.read().count() == 2 and b.live().filter("blob is null").count() == 1
    assert {bytes(r.key): bytes(r.value) for r in b.rows().collect()} == {b"a": large[0], b"b": b"x" * 65_536, b"c": large[1]}
    b.put(b"a", large[2])
    b.batch([{"key": b"d", "value": large[2]}], [{"key": b"c"}])
    assert b.get(b"a") == large[2] and b.get(b"c") is None and b.get(b"d") == large[2]
    assert b.gc_blobs() == (3 if on_disk else 0) and b.gc_blobs() == 0  # two dead ones, and one that was held twice
    other = {"persistent": "ultra", "ultra": "persistent"}[db.container("default").mode]
    db.set_mode(other)
    b = db.binarystore()
    assert b.get(b"a") == large[2] and b.get(b"b") == b"x" * 65_536 and b.count() == 3
    assert (b.blobs is None) == (other == "ultra") and (b.blobs is None or b.blobs.read().count() == 2)
    db.wipe()
    assert b.count() == 0 and b.get(b"a") is None


def test_wide_rows_are_read_one_at_a_time(spark, tmp_path):
    """Batches of 4,096 large values, in readers and in writers before they look at what they hold, fill an executor."""
    with Engine.open(spark, f"file://{tmp_path}/wide") as db:
        b = db.binarystore()
        b.put(spark.range(64).selectExpr("cast(cast(id as string) as binary) as key", "cast(repeat(sha2(cast(id as string), 512), 16000) as binary) as value"))
        plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in (b.blobs.read(), b.live(), b.rows())]
        assert all("Batched: false" in p and "Batched: true" not in p for p in plans)
        assert "first(value" not in plans[2] and "SortMergeJoin" not in plans[2]  # values are neither aggregated nor sorted
        assert b.blobs.read().sparkSession is spark and spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
        found = b.rows().selectExpr("cast(key as string) as key", "md5(value) as digest", "octet_length(value) as n").collect()
        expected = spark.range(64).selectExpr("cast(id as string) as key", "md5(cast(repeat(sha2(cast(id as string), 512), 16000) as binary)) as digest").collect()
        assert {(r.key, r.digest) for r in found} == {(r.key, r.digest) for r in expected} and {r.n for r in found} == {2_048_000}
        b.put(spark.range(8).selectExpr("cast(concat('again', id) as binary) as key", "cast(repeat(sha2(cast(id as string), 512), 16000) as binary) as value"))
        assert b.blobs.read().count() == 72 and b.rows().count() == 72
        b.delete(spark.range(8).selectExpr("cast(concat('again', id) as binary) as key"))
        b.delete(spark.range(0, 64, 2).selectExpr("cast(cast(id as string) as binary) as key"))
        assert {(r.key, r.value) for r in b.mapped(F.md5).select(F.col("key").cast("string"), "value").collect()} == {(r.key, r.digest) for r in expected if int(r.key) % 2}
        assert b.gc_blobs() == 40 and b.count() == b.blobs.read().count() == 32


def test_blobs_query_takes_every_source(spark):
    from sedimenta.plans.dml import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.key for r in QUERIES["dml_blobs"](spark, sf).select("key").collect()}
    keys = {f"{r.source}/{r.lang}/{r.doc_id}" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len({k.split("/")[0] for k in keys}) > 1 and found == {k for k in keys if not k.endswith("1")}
