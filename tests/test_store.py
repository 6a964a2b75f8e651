"""The store's operators on small cases: lookups, recovery, levels, frames, logs as a source, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import layout, wire
from tidelog.operators import kv, lsm
from tidelog.operators.wal import decode_files, file_status, truncated
from tidelog.sources.kvwal import KvWal, repair
from tidelog.streaming.replay import stream_apply, stream_replay

LOG = "seq bigint, op string, k string, v string"
STATE = "k string, v string, seq bigint"


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def test_previous_values(spark):
    log = spark.createDataFrame([(1, "P", "key", "value1"), (2, "P", "key", "value2"), (3, "D", "key", None), (4, "P", "key", ""), (4, "P", "key", ""), (5, "D", "other", None), (6, "P", "other", "x")], LOG)
    assert rows(kv.previous_values(log), "seq", "prev") == [(1, None), (2, "value1"), (3, "value2"), (4, None), (5, None), (6, None)]


def test_replay_codes(spark):
    log = spark.createDataFrame([(1, "G", "k", None), (2, "P", "k", ""), (3, "G", "k", None), (4, "D", "k", None), (5, "G", "k", None), (6, "D", "none", None), (7, "G", "", None), (8, "G", None, None)], LOG)
    assert rows(kv.replay(log), "seq", "rc", "payload") == [(1, 2, None), (2, 0, None), (3, 0, ""), (4, 0, ""), (5, 2, None), (6, 0, None), (7, 2, None), (8, 2, None)]
    assert rows(kv.replay(log.limit(0))) == []


def test_tombstones_hide_and_absence_falls_through(spark):
    delta = spark.createDataFrame([("both", "new", 5), ("dead", None, 6), ("delta", "d", 7)], STATE)
    base = spark.createDataFrame([("both", "old", 1), ("dead", "old", 2), ("base", "b", 3)], STATE)
    assert rows(kv.merge_on_read(delta, base)) == [("base", "b"), ("both", "new"), ("delta", "d")]
    assert ("dead", None) in rows(kv.merge_on_read(delta, base, True))


def test_model(spark):
    """Random operations: replay, newest, merge on read, flush and compaction agree with a dict."""
    rng = random.Random(4)
    model, before, answers, log = {}, None, [], []
    for seq in range(400):
        op, k = rng.choice("PPDG"), rng.choice("abcdefgh")
        v = f"v{seq}" if op == "P" else None
        answers.append((seq, 2 if op == "G" and model.get(k) is None else 0, model.get(k)))
        if op != "G":
            model[k] = v
        log.append((seq, op, k, v))
        if seq == 199:
            before = dict(model)
    table = spark.createDataFrame(log, LOG)
    want = sorted((k, v) for k, v in model.items() if v is not None)
    assert rows(kv.replay(table), "seq", "rc", "payload") == sorted(answers, key=repr)
    assert rows(kv.latest(table), "k", "v") == want
    base, delta = kv.newest(table.where("seq < 200")), kv.newest(table.where("seq >= 200"))
    assert rows(base, "k", "v") == sorted(before.items(), key=repr)
    assert rows(kv.merge_on_read(delta, base)) == want
    entries = base.withColumn("lvl", F.lit(1)).unionByName(delta.withColumn("lvl", F.lit(0)))
    assert rows(lsm.compact(entries), "k", "v") == want
    assert rows(lsm.level_lookup(entries).where("v is not null"), "k", "v") == want


def test_recovery(spark):
    base = [("P", "key1", "value1"), ("P", "key1", "new_value1"), ("P", "key2", "value2"), ("D", "key2", None), ("P", "key3", "value3")]
    log = spark.createDataFrame([(s, *o) for s, o in zip((0, 35, 90, 125, 153), base)], LOG)
    assert rows(kv.newest(log), "k", "v") == [("key1", "new_value1"), ("key2", None), ("key3", "value3")]
    assert rows(kv.recover_from(log, 90), "k", "v") == [("key2", None), ("key3", "value3")]
    assert rows(kv.recover_prefix(log, F.col("seq") == 90), "k", "v") == [("key1", "new_value1")]
    assert rows(kv.recover_prefix(log, F.lit(False)), "k", "v") == rows(kv.newest(log), "k", "v")


def test_return_codes(spark):
    names = [None, "IoError", "NotFound", "Shutdown", "InvalidKey", "InvalidValue", "MissingValue", "MalformedPayload", "InvalidRequestType", "UnknownFlags", "UnsupportedVersion", "TimedOut", "WrongMagicBytes"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, e string").select("i", kv.return_code(F.col("e")))
    assert [r[1] for r in sorted(got.collect())] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 255]


PUT = "00000018726b7673000000000000000000000000000004000002000000000010000000036b65790000000576616c7565"
GET = "00000018726b7673000000000000000000000000000002000001000000000007000000036b6579"


def test_frames(spark):
    frames = {
        PUT: ("P", "key", "value", None),
        GET: ("G", "key", None, None),
        PUT.replace("726b7673", "736b7673"): ("P", None, None, "WrongMagicBytes"),
        PUT[:48] + "01" + PUT[50:]: ("P", None, None, "UnsupportedVersion"),
        PUT[:50] + "03" + PUT[52:]: (None, None, None, "InvalidRequestType"),
        PUT[:50] + "01" + PUT[52:]: ("G", None, None, "MalformedPayload"),
        PUT[:50] + "00" + PUT[52:]: ("D", None, None, "MalformedPayload"),
        GET[:50] + "02" + GET[52:]: ("P", None, None, "MissingValue"),
        GET[:52] + "ffff" + GET[56:]: ("G", "key", None, None),  # flags are not looked at
        GET[:-6] + "ff6579": ("G", None, None, "InvalidKey"),
        PUT[:-10] + "ff616c7565": ("P", None, None, "InvalidValue"),
        GET[:-2]: ("G", None, None, "MalformedPayload"),
        GET[:64] + "000000ff" + GET[72:]: ("G", None, None, "MalformedPayload"),
        PUT[:-18] + "000000ff" + PUT[-10:]: ("P", None, None, "MalformedPayload"),
        "0000001872": (None, None, None, "MalformedPayload"),
        "": (None, None, None, "MalformedPayload"),
    }
    table = spark.createDataFrame([(h, bytes.fromhex(h)) for h in frames], "h string, f binary")
    got = {r.h: (r.op, r.k, r.v, r.error) for r in wire.decode_requests(table.withColumn("op", F.lit("clash")), "f").collect()}
    assert {h: x[3] for h, x in got.items()} == {h: x[3] for h, x in frames.items()}
    assert {h: x[1:3] for h, x in got.items()} == {h: x[1:3] for h, x in frames.items()}
    row = spark.range(1).select(
        F.lower(F.hex(wire.encode_request(wire.correlation_id(F.lit(1024)), F.lit("P"), F.lit("key"), F.lit("value")))),
        F.lower(F.hex(wire.encode_request(wire.correlation_id(F.lit(512)), F.lit("G"), F.lit("key"), F.lit(None).cast("string")))),
        F.lower(F.hex(wire.encode_response(wire.correlation_id(F.lit(1)), F.lit(0), F.lit("value")))),
        F.lower(F.hex(wire.close_notification())),
    )
    assert tuple(row.first()) == (PUT, GET, "0" * 31 + "1" + "00" + "76616c7565", "0" * 32 + "0b")


def test_raw_files(spark):
    w = layout.LogWriter(1 << 16)
    for i in range(10):
        w.append("P", f"k{i}", "v")
    data = w.take()[0][1]
    bad = bytearray(data)
    bad[len(data) // 2] ^= 1
    table = spark.createDataFrame([("a", len(data), data), ("b", None, bytes(bad)), ("c", 0, b""), ("d", None, None), ("e", 4, bytes(4))], "path string, length bigint, content binary")
    assert decode_files(table).where("path = 'a'").count() == 10
    status = {r.path: r for r in file_status(table).collect()}
    assert [status[p].status for p in "abcde"] == ["clean", "corrupted", "clean", "clean", "padding"] and status["b"].records < 6
    cut = {r.path: r.content for r in truncated(table).collect()}
    assert cut["a"] == data and len(cut["b"]) == status["b"].readable and cut["d"] is None
    assert decode_files(table.limit(0)).count() == 0


def test_logs_go_on(spark, tmp_path):
    """Written, opened anew and written further: the logs are as if they had been written at once."""
    spark.dataSource.register(KvWal)
    rng, folders = random.Random(1), (f"file://{tmp_path}/twice", f"file://{tmp_path}/once")
    rows_ = [("P", f"k{i}", "v" * rng.randrange(60)) for i in range(200)]

    def write(some, folder):
        table = spark.createDataFrame(some, "op string, k string, v string").coalesce(1)
        table.write.format("kvwal").option("segmentSize", 256).option("resume", "true").mode("append").save(folder)

    for a, b in ((0, 1), (1, 70), (70, 70), (70, 200)):
        write(rows_[a:b], folders[0])
    write(rows_, folders[1])
    read = [rows(spark.read.format("kvwal").option("segmentSize", 256).load(f), "seq", "op", "k", "v") for f in folders]
    assert read[0] == read[1] and sorted(r[1:] for r in read[0]) == sorted(rows_)
    logs = [{p.name: p.read_bytes() for p in (tmp_path / x / "part-00000").iterdir()} for x in ("twice", "once")]
    assert logs[0] == logs[1] and len(logs[0]) > 10


def test_levels(spark, tmp_path):
    tree = lsm.Levels(spark, f"file://{tmp_path}/tree")
    assert tree.state().count() == 0 and tree.get("a") is None and tree.highest() is None
    tree.flush(spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "1", 3)], STATE))
    tree.flush(spark.createDataFrame([("a", "2", 4), ("b", None, 5)], STATE))
    pinned = tree.version()
    want = [("a", "2"), ("c", "1")]
    assert rows(tree.state().where("v is not null"), "k", "v") == want and tree.get("b") is None and tree.get("a") == "2" and tree.highest() == 5
    tree.compact(target=10)
    assert {p["lvl"] for p in tree.live()} == {1}
    assert rows(tree.state(), "k", "v") == want  # the tombstone is gone at the bottom
    assert sum(p["n"] for p in tree.live(pinned)) == 5 and tree.state(pinned).count() == 3
    tree.flush(spark.createDataFrame([], STATE))
    assert tree.version() == pinned + 1
    assert tree.vacuum() >= 2 and rows(tree.state(), "k", "v") == want
    assert tree.vacuum() == 0


def test_compaction_by_intervals(spark, tmp_path):
    tree, rng, model = lsm.Levels(spark, f"file://{tmp_path}/tree"), random.Random(6), {}
    for turn in range(4):
        some = {f"{'abc'[turn % 3]}{rng.randrange(100):03d}": f"v{turn}" if rng.random() < 0.8 else None for _ in range(80)}
        tree.flush(spark.createDataFrame([(k, v, turn * 1000 + i) for i, (k, v) in enumerate(some.items())], STATE))
        model |= some
        before = {p["file"]: p for p in tree.live()}
        tree.compact(target=300)
        after = {p["file"] for p in tree.live()}
        if turn == 2:  # segments of other keys stay as they are
            assert any(p["lvl"] == 1 and f in after for f, p in before.items())
        for lvl in range(1, 4):
            own = sorted((p["mn"], p["mx"]) for p in tree.live() if p["lvl"] == lvl)
            assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        assert rows(tree.state().where("v is not null"), "k", "v") == sorted((k, v) for k, v in model.items() if v is not None)
    for k in ("a001", "b050", "zzz", *[k for k, v in model.items() if v is None][:2]):
        assert tree.get(k) == model.get(k)
        held = tree.holding(k)
        assert len(held) < len(tree.live()) and len([p for p in held if p["lvl"] == 1]) <= 1
    part = lambda lvl, born, n: {"lvl": lvl, "born": born, "mn": str(born), "bytes": n, "file": f"{lvl}.{born}"}
    parts = [part(1, 3, 10), part(1, 1, 10), part(1, 2, 10), part(0, 9, 5), part(0, 8, 5)]
    assert [p["born"] for p in tree.to_merge(parts, 1, 15)] == [1, 2] and tree.to_merge(parts, 1, 30) == []
    assert len(tree.to_merge(parts, 0, 9)) == 2 and tree.to_merge(parts, 0, 10) == []
    ranges = lsm.intervals([{"mn": a, "mx": b} for a, b in ("ac", "bd", "fg", "xx")])
    assert ranges == [("a", "d"), ("f", "g"), ("x", "x")]
    assert [p["mn"] for p in lsm.overlapping([{"mn": a, "mx": b} for a, b in ("AB", "aa", "df", "ee", "hw", "hx", "yz")], ranges)] == ["a", "d", "h"]


def test_overlaps_and_containing_segments(spark):
    rng = random.Random(6)
    segments = []
    for lvl in range(4):
        for sg in range(30):
            a, b = sorted((f"{rng.randrange(500):03d}", f"{rng.randrange(500):03d}"))
            segments.append((lvl, lvl * 100 + sg, a, b, 1, 1, 1))
    segments += [(0, 999, None, "x", 1, None, 1), segments[3]]
    table = spark.createDataFrame(segments, "lvl int, sg int, mn string, mx string, hi bigint, bytes bigint, n bigint")
    whole = {s[:4] for s in segments if s[2]}
    want = sorted((a[0], a[1], sum(b[0] == a[0] + 1 and a[2] <= b[3] and b[2] <= a[3] for b in whole)) for a in whole)
    assert rows(lsm.overlaps(table)) == sorted(want, key=repr)
    ranges = [(1, i, f"{10 * i:03d}", f"{10 * i + 5:03d}", 1, 1, 1) for i in range(20)]
    table = spark.createDataFrame(ranges, table.schema)
    keys = spark.createDataFrame([(f"{i:03d}",) for i in range(0, 230, 3)], "k string")
    want = [(f"{i:03d}", 1, i // 10) for i in range(0, 200, 3) if i % 10 <= 5]
    assert rows(lsm.containing_segments(keys, table)) == sorted(want, key=repr)


def test_log_source(spark, tmp_path):
    spark.dataSource.register(KvWal)
    folder = f"file://{tmp_path}/log"
    data = spark.createDataFrame([("P" if i % 3 else "D", f"key{i}", "v" * (i % 40) if i % 3 else None) for i in range(500)], "op string, k string, v string")
    data.repartition(3).write.format("kvwal").option("segmentSize", 256).mode("append").save(folder)
    read = spark.read.format("kvwal").option("segmentSize", 256)
    back = read.load(folder)
    assert rows(back, "op", "k", "v") == rows(data)
    assert back.select("file").distinct().count() > 30
    log = next(p for p in (tmp_path / "log").iterdir())
    whole = read.load(f"file://{log}").orderBy("seq").collect()
    assert [r.seq for r in read.option("from", whole[50].seq).load(f"file://{log}").orderBy("seq").collect()] == [r.seq for r in whole[50:]]
    read = spark.read.format("kvwal").option("segmentSize", 256)
    (log / "notes.txt").write_text("other")
    name = sorted(p.name for p in log.glob("*.wal"))[4]
    damaged = bytearray((log / name).read_bytes())
    damaged[100] ^= 1
    (log / name).write_bytes(bytes(damaged))
    found = read.option("corrupt", "true").load(f"file://{log}").collect()
    bad = next(r for r in found if r.op == "!")
    assert len(repair(f"file://{log}", 256, bad.file.rsplit("/", 1)[1], bad.pos)) > 0
    with pytest.raises(Exception, match="more than a segment"):
        spark.read.format("kvwal").option("segmentSize", 128).load(f"file://{log}").collect()
    again = read.load(f"file://{log}").collect()
    assert len(again) == len(found) - 1 and not any(r.op == "!" for r in again)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    kinds = "seq bigint, op string, k string, v string, shard int"
    table, folder = f"{tmp_path}/kv_log.parquet", f"file://{tmp_path}/run"
    log = [(i, "PGDG"[i % 4], f"k{i % 3}" if i % 11 else None, f"v{i}" if i % 4 == 0 else None, 0) for i in range(60)]
    spark.createDataFrame(log[:30], kinds).coalesce(1).write.parquet(table)
    stream_replay(spark, table, folder)
    base = spark.createDataFrame([("k0", "base", -5), ("z", "base", -4)], STATE)
    stream_apply(spark, table, base, folder + "a")
    spark.createDataFrame(log[30:] + log[25:32], kinds).coalesce(1).write.mode("append").parquet(table)
    from tidelog.schema import requests
    from tidelog.operators.changes import apply_changes

    all_ = spark.createDataFrame(log, kinds)
    assert rows(stream_replay(spark, table, folder)) == rows(kv.replay(requests(all_)).select("seq", "k", "op", "rc", "payload"))
    assert rows(stream_apply(spark, table, base, folder + "a")) == rows(apply_changes(base, all_))
    # a batch rewrites only the buckets it touches, and versions that no bucket is in any more are gone
    spark.createDataFrame([(99, "P", "k1", "late", 0)], kinds).write.mode("append").parquet(table)
    assert stream_apply(spark, table, base, folder + "a").where("k = 'k1'").first().v == "late"
    versions = {p.name: sorted(x.name for x in p.iterdir() if x.name.startswith("b=")) for p in (tmp_path / "runa" / "state").iterdir()}
    assert "v=2" in versions and len(versions[max(versions)]) == 1


def test_stream_answers_late_requests(spark, tmp_path):
    rng = random.Random(11)
    log = [(i * 3, rng.choice("PPDGG"), "hot" if rng.random() < 0.8 else rng.choice(["a", "b", "", None]), f"v{i}") for i in range(2500)]
    log = [(s, op, k, v if op == "P" else None) for s, op, k, v in log]
    rng.shuffle(log)
    table = f"{tmp_path}/kv_log.parquet"
    for i in range(4):
        spark.createDataFrame(log[i * 625 : (i + 1) * 625] + log[:40], LOG).coalesce(1).write.mode("append").parquet(table)
    from tidelog.schema import requests

    want = rows(kv.replay(requests(spark.createDataFrame(log, LOG))), "seq", "k", "op", "rc", "payload")
    assert rows(stream_replay(spark, table, files_per_trigger=1), "seq", "k", "op", "rc", "payload") == want


def test_history_in_small_blocks(monkeypatch):
    from tidelog.streaming import replay

    class Cell:
        def __init__(self):
            self.held = {}

        def exists(self):
            return "x" in self.held

        def get(self):
            return self.held["x"]

        def update(self, value):
            self.held["x"] = tuple(map(tuple, value))

        def getValue(self, key):
            return self.held[key]

        def updateValue(self, key, value):
            self.held[key] = value

    monkeypatch.setattr(replay, "BLOCK", 3)
    monkeypatch.setattr(replay, "KEPT", 2)
    rng = random.Random(4)
    for keys in ["k"] * 20 + ["ab", "", "abcde"] * 20:
        log = [(rng.choice(keys) if keys else "", s, rng.choice("PGGGD"), f"v{s}") for s in rng.sample(range(300), 80)]
        log = [(k, s, op, v if op == "P" else None) for k, s, op, v in log]
        index, blocks, given = Cell(), Cell(), {}
        for at in range(0, 80, 9):
            history = replay.History(index, blocks)
            for k, seq, *answer in history.answers(history.add(sorted({*log[at : at + 9], *log[:3]}, key=lambda r: r[:2]))):
                assert (k, seq) not in given or answer[-1] > (-1 if given[k, seq][-1] is None else given[k, seq][-1])
                given[k, seq] = answer
        last, want = {}, {}
        for k, seq, op, v in sorted(log, key=lambda r: r[:2]):
            before, value = last.get(k, (None, None))
            want[k, seq] = [op, 2 if op == "G" and value is None else 0, value, before]
            last[k] = (seq, v) if op != "G" else (before, value)
        assert given == want


def test_empty_keys_are_refused(spark):
    with pytest.raises(ValueError):
        layout.LogWriter(64).append("P", "", "v")
