import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.operators import chunking, resolving, results, store
from hashloom.sources import tables, writing
from hashloom.streaming import twins


def dig(b):
    return hashlib.sha256(b).hexdigest(), len(b)


def blobs(spark, *bodies):
    return spark.createDataFrame([(*dig(b), b) for b in bodies], "hash string, size_bytes long, data binary")


def asked(spark, *digests):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(digests)], "pos long, hash string, size_bytes long")


def test_missing_keeps_order_and_repeats(spark):
    held = blobs(spark, b"one")
    want = asked(spark, dig(b"two"), dig(b"one"), dig(b"two"))
    assert [(r.pos, r.hash) for r in store.find_missing(want, held).orderBy("pos").collect()] == [(0, dig(b"two")[0]), (2, dig(b"two")[0])]
    assert store.find_missing(want.where("false"), held).count() == 0


def test_wrong_size_counts_by_key(spark):
    held, want = blobs(spark, b"one"), asked(spark, (dig(b"one")[0], 4))
    assert store.find_missing(want, held).count() == 1
    assert store.find_missing(want, held, key="hash").count() == 0


def test_empty_blob(spark):
    want = asked(spark, dig(b""))
    assert store.find_missing(want, blobs(spark, b"x")).count() == 1
    assert store.find_missing(want, blobs(spark, b"x"), empty_is_present=True).count() == 0


def test_lying_row_is_refused_and_not_stored(spark):
    rows = spark.createDataFrame([(0, *dig(b"hello"), b"world"), (1, *dig(b"ok"), b"ok"), (2, *dig(b"ok"), b"ok"), (3, "abc", 1, b"x")], "pos long, hash string, size_bytes long, data binary")
    statuses, after = store.batch_update(blobs(spark, b"old"), rows)
    assert [r.code for r in statuses.orderBy("pos").collect()] == [3, 0, 0, 3]
    assert {r.hash for r in after.collect()} == {dig(b"old")[0], dig(b"ok")[0]} and after.count() == 2
    assert [(r.pos, r.code) for r in store.first_failure(statuses).collect()] == [(0, 3)]


def test_read_of_the_absent_is_a_row(spark):
    got = store.batch_read(asked(spark, dig(b"a"), dig(b"absent"), dig(b"a")), blobs(spark, b"a")).orderBy("pos").collect()
    assert [(r.code, r.data and bytes(r.data)) for r in got] == [(0, b"a"), (5, None), (0, b"a")]


def test_persists(spark, tmp_path):
    path = f"file://{tmp_path}/cas"
    assert tables.open_store(spark, path).count() == 0
    rows = blobs(spark, b"persist me", b"persist me", b"two").withColumn("pos", F.monotonically_increasing_id())
    assert {r.code for r in writing.append_blobs(rows, path).collect()} == {0}
    writing.append_blobs(rows, path)
    assert tables.open_store(spark, path).count() == 2


def test_cache_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/ac"
    assert tables.open_cache(spark, path).count() == 0
    kind = tables.schemas.CACHED.simpleString()
    result = lambda code: (code, b"out", None, None, None, None)
    rows = lambda *x: spark.createDataFrame([(h, result(c), n) for h, c, n in x], f"action_hash string, result {kind[kind.index('result:') + 7:-1]}, seq long")
    writing.upsert_results(rows(("a", 0, 1), ("a", 7, 2), ("b", 0, 1)), path, ["seq"])
    after = writing.upsert_results(rows(("b", 3, 9)), path, ["seq"])
    assert {r.action_hash: r.result.exit_code for r in after.collect()} == {"a": 7, "b": 3}


def sequential(rows, never=()):
    held, out = {}, []
    for seq, key, code, skip in rows:
        hit = not skip and key in held
        out.append((seq, hit, held[key] if hit else seq, 0 if hit else code))
        if not hit and code == 0 and seq not in never:
            held[key] = seq
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_a_sequential_client(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i, r.choice("aaaaab"), int(r.random() < 0.5), r.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, k string, exit_code int, skip boolean").withColumn("part", F.floor(F.col("seq") / 37))
    got = results.replay(df, "k", "seq", "part").orderBy("seq").collect()
    assert [(x.seq, x.hit, x.source_seq, x.replayed_exit) for x in got] == sequential(rows)


def test_miss_then_hit_and_failures_never(spark):
    from hashloom.plans import running

    cache = spark.createDataFrame([], running.OUTCOME)
    held = spark.createDataFrame([], "hash string, size_bytes long, data binary")
    rows = spark.createDataFrame([(0, ["/bin/echo", "hello world"], False), (1, ["/bin/false"], False), (2, ["/no/such/program"], False)], "seq long, argv array<string>, skip boolean")
    first, cache, held = running.execute(rows, cache, held)
    cache = spark.createDataFrame(cache.toPandas(), cache.schema)
    got = {r.seq: r for r in first.collect()}
    assert (got[0].exit_code, bytes(got[0].stdout), got[0].cache_hit) == (0, b"hello world\n", False)
    assert got[1].exit_code != 0 and got[2].exit_code == 127
    again, _, _ = running.execute(rows, cache, held)
    assert {r.seq: r.cache_hit for r in again.collect()} == {0: True, 1: False, 2: False}
    assert dig(b"hello world\n")[0] in {r.hash for r in held.collect()}


def test_result_cache(spark, tmp_path):
    from hashloom.plans.result_cache import ResultCache

    cache, made = ResultCache(spark, f"file://{tmp_path}"), []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("r", {"n": 3}, ["x"], make)[1] is False
    df, hit = cache.get("r", {"n": 3}, ["x"], make)
    assert hit and df.count() == 3 and len(made) == 1
    assert cache.get("r", {"n": 3}, ["x"], make, skip_lookup=True)[1] is False and len(made) == 2


def test_tree_leaves_out_what_is_missing(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("orphan", "x")], "parent string, child string")
    got = resolving.expand(edges, spark.createDataFrame([("r",)], "root string"), 5).collect()
    assert {(x.node, x.depth) for x in got} == {("r", 0), ("a", 1), ("b", 1), ("c", 2)}
    assert resolving.expand(edges, spark.createDataFrame([("none",)], "root string"), 5).count() == 1


def test_required_target(spark):
    rows, target = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="blob not found"):
        resolving.resolve(rows, target, "k", required="v").collect()


@pytest.mark.parametrize("split", [lambda b: chunking.split_gear(b, 1024), lambda b: chunking.split_longest(b, 64), lambda b: chunking.split_fixed(b, 100)])
def test_chunks_splice_back(spark, split):
    import random

    r = random.Random(5)
    bodies = [b"", b"x", bytes(r.randrange(256) for _ in range(9000)), b"ab" * 6000]
    chunks = split(blobs(spark, *bodies))
    assert all(x.ok for x in chunking.splice(chunks).collect())


def whole_longest_cuts(body, least, horizon):
    """By the definition, from hashes of the whole blob."""
    hashes = chunking.gear_hashes(np.frombuffer(body, dtype=np.uint8), np.array(chunking.GEAR, dtype=np.uint64))

    def cut(start, stop):
        if stop - start < 2 * least:
            return [stop]
        low, high = start + least, min(start + least + horizon, stop - least)
        at = low + int(hashes[low - 1 : high].argmax())
        return cut(start, at) + cut(at, stop)

    return cut(0, len(body))


def test_long_blobs_are_hashed_and_cut_in_slices(monkeypatch):
    body = np.random.default_rng(3).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    monkeypatch.setattr(chunking, "_SLICE", 3000)
    longest, hashed = [], chunking.gear_hashes
    monkeypatch.setattr(chunking, "gear_hashes", lambda data, gear: longest.append(len(data)) or hashed(data, gear))
    got = {args: chunking.longest_cuts(body, *args) for args in [(64, 512), (256, 2048), (100, 5000), (128, 0)]}
    assert max(longest) < 6000
    assert got == {args: whole_longest_cuts(body, *args) for args in got}


def test_chunks_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(chunking, "_SLICE", 3000)
    r = np.random.default_rng(4)
    bodies = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in r.integers(0, 2000, 200)] + [b"", None, bytes(9000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(bodies))]), pa.array(bodies, pa.binary())], ["hash", "data"])
    for part in (batch, batch.slice(50), batch.slice(7, 1)):
        out = list(chunking._split(chunking.longest_cuts, 64, 512)([part]))
        assert all(sum(map(len, b.column("data").to_pylist())) <= 3000 or len(set(b.column("blob").to_pylist())) == 1 for b in out)
        assert len(out) > 20 or part.num_rows == 1
        want = []
        for blob, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
            ends = chunking.longest_cuts(body or b"", 64, 512)
            want += [(blob, i, a, (body or b"")[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends))]
        assert [x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want


@pytest.mark.parametrize("name", ["split_fastcdc", "split_repmaxcdc", "compression_round_trip", "digest_functions_exotic"])
def test_batches_for_python_are_bounded(spark, data, name):
    from hashloom import catalogue

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for key in keys:
        spark.conf.unset(key)
    catalogue.QUERIES[name](spark, data)
    assert [spark.conf.get(k) for k in keys] == ["2000", "8388608b"]


def test_chunk_sizes():
    import random

    r = random.Random(6)
    body = bytes(r.randrange(256) for _ in range(60_000))
    ends = chunking.gear_cuts(body, 1024)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(body) and max(sizes) <= 4096 and min(sizes[:-1]) >= 256
    moved = chunking.gear_cuts(b"!" + body, 1024)
    assert len({len(body) - e for e in ends} & {len(body) + 1 - e for e in moved}) > len(ends) * 0.8  # cuts follow the content
    ends = chunking.longest_cuts(body, 100, 800)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(body) and all(100 <= s < 200 for s in sizes)


def test_merkle_changes_with_any_leaf(spark):
    rows = [("r", "", "r", 0, "x"), ("r/a", "r", "a", 1, "1"), ("r/b", "r", "b", 1, "2"), ("r/a/c", "r/a", "c", 2, "3")]
    root = lambda rows: resolving.merkle(spark.createDataFrame(rows, "node string, parent string, name string, depth int, content string")).where("node = 'r'").first().digest
    assert root(rows) == root(rows[::-1])
    assert root(rows) != root([*rows[:3], ("r/a/c", "r/a", "c", 2, "4")])


def test_stream_first_of(spark, tmp_path):
    blobs(spark, b"a", b"b", b"a").select("hash", "size_bytes").write.parquet(f"{tmp_path}/t.parquet")
    stream = twins.source(spark, f"file://{tmp_path}", "t", "hash string, size_bytes long")
    assert twins.drained(twins.first_of(stream, "hash")).count() == 2


def test_a_command_runs_once(spark, tmp_path):
    from hashloom.plans import running

    log = tmp_path / "runs"
    rows = spark.createDataFrame([(0, ["/bin/sh", "-c", f"echo x >> {log}; date +%s%N"], False), (1, ["/bin/sh", "-c", f"echo x >> {log}; date +%s%N"], False)], "seq long, argv array<string>, skip boolean")
    outcomes, cache, held = running.execute(rows, spark.createDataFrame([], running.OUTCOME), spark.createDataFrame([], "hash string, size_bytes long, data binary"))
    said = {bytes(r.stdout) for r in outcomes.collect()}
    assert len(said) == 1 and said == {bytes(r.stdout) for r in cache.collect()}
    assert dig(said.pop())[0] in {r.hash for r in held.collect()}
    assert log.read_text() == "x\n"


def plain_gear(body, average, seed=0):
    """Byte by byte, the hash from each chunk's least size on."""
    masks = [chunking.MASKS[average.bit_length() + 1], chunking.MASKS[average.bit_length() - 3]]
    ends, start = [], 0
    while len(body) - start > average // 4:
        stop = min(len(body) - start, average * 4)
        h, cut = 0, stop
        for i in range(average // 4 // 2 * 2, stop // 2 * 2):
            h = ((h << 1) + (chunking.GEAR[body[start + i]] ^ seed)) % (1 << 64)
            if not h & masks[i >= min(average, stop) // 2 * 2]:
                cut = i
                break
        start += cut
        ends.append(start)
    return ends + [len(body)] * (start < len(body) or not body)


def test_gear_cuts_equal_byte_by_byte(monkeypatch):
    import random

    r = random.Random(7)
    monkeypatch.setattr(chunking, "_SLICE", 1500)  # slices join without a seam
    for n in (0, 1, 255, 256, 257, 319, 320, 321, 1023, 4097, 20_001, 60_000):
        body = bytes(r.randrange(256) for _ in range(n))
        for average, seed in ((1024, 0), (256, 0), (1024, 666)):
            assert chunking.gear_cuts(body, average, seed) == plain_gear(body, average, seed)
    assert chunking.gear_cuts(bytes(10_240), 256) == list(range(1024, 10_241, 1024))  # as published: zeros are cut at the most


def test_longest_cuts_equal_byte_by_byte():
    import random

    r = random.Random(9)
    for n in (100, 127, 128, 500, 5000):
        body = bytes(r.randrange(4) for _ in range(n))
        h, hashes = 0, []
        for b in body:
            h = ((h << 1) + chunking.GEAR[b]) % (1 << 64)
            hashes.append(h)

        def parts(start, stop):
            if stop - start < 128:
                return [stop]
            cut = max(range(start + 64, min(start + 64 + 512, stop - 64) + 1), key=lambda i: (hashes[i - 1], -i))
            return parts(start, cut) + parts(cut, stop)

        assert chunking.longest_cuts(body, 64, 512) == parts(0, n)


def test_tree_of_any_depth(spark):
    rows = [("/".join("n" * k), "/".join("n" * (k - 1)), "n", k, "n") for k in range(1, 13)]
    nodes = spark.createDataFrame(rows, "node string, parent string, name string, depth int, content string")
    edges = nodes.selectExpr("parent", "node as child")
    assert resolving.expand(edges, spark.createDataFrame([("",)], "root string")).count() == 13
    assert resolving.merkle(nodes).count() == 12
    assert resolving.merkle(nodes.where("false")).count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert resolving.expand(loop, spark.createDataFrame([("a",)], "root string"), 4).count() == 5


def test_replaced_table_has_one_version_that_counts(spark, tmp_path):
    from hashloom.sources import tables, writing

    path = f"file://{tmp_path}/t"
    writing.replace(spark.range(3), path)
    early = tables.open_store(spark, path, "id long")
    writing.replace(tables.open_store(spark, path, "id long").union(spark.range(3, 5)), path)
    assert tables.open_store(spark, path, "id long").count() == 5 and early.count() == 3
    with pytest.raises(Exception, match="boom"):
        writing.replace(spark.range(1).selectExpr("raise_error('boom') as id"), path)
    assert tables.open_store(spark, path, "id long").count() == 5


def test_stream_replay_over_micro_batches(spark, tmp_path):
    """Files in an order that isn't that of time: a batch is replayed where it comes, in its own order."""
    import random

    from hashloom.operators import results

    r = random.Random(11)
    rows = [(i % 4 if i % 3 else 0, f"2024-01-01 00:{i % 60:02}:{i % 7:02}", i, int(r.random() < 0.4), r.random() < 0.2) for i in range(400)]
    r.shuffle(rows)
    shape = "user_id long, ts string, event_id long, exit_code int, skip boolean"
    import os
    import time

    for n in range(8):
        spark.createDataFrame(rows[50 * n : 50 * n + 50], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
        for name in os.listdir(f"{tmp_path}/log.parquet"):
            at = f"{tmp_path}/log.parquet/{name}"
            if name.endswith(".parquet") and not os.path.exists(f"{tmp_path}/{name}.seen"):
                open(f"{tmp_path}/{name}.seen", "w").close()
                os.utime(at, (time.time() - 1000 + 10 * n,) * 2)
    stream = twins.source(spark, f"file://{tmp_path}", "log", shape, max_files=1).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {x.event_id: (x.hit, x.source_id, x.replayed_exit) for x in twins.replay(stream).collect()}
    whole = spark.createDataFrame([(i // 50, *x) for i, x in enumerate(rows)], f"batch int, {shape}").withColumn("seq", F.struct("batch", "ts", "event_id"))
    want = results.replay(whole, "user_id", "seq", "batch")
    assert got == {x.event_id: (x.hit, x.source_seq.event_id, x.replayed_exit) for x in want.collect()}
