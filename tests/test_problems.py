"""Change feed, increments and small files: brute force, and odd tables."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidelog import schema
from tidelog.functions.records import encode
from tidelog.operators import skew
from tidelog.operators.changes import apply_changes
from tidelog.operators.compaction import compact_log_files, first_seq, footer_of
from tidelog.operators.incremental import Increments, covered_batches, maybe_open, pending_changes
from tidelog.operators.lsm import healed_manifest
from tidelog.operators.membership import may_be_among
from tidelog.plans import p_queries
from tidelog.plans.p_queries import consolidate
from tidelog.session import work_dir
from tidelog.sources.files import read_whole
from tidelog.sources.parquet_blocks import compact_parquet, merge_files, read_footer

LOG = "seq bigint, op string, k string, v string, shard int, batch_no int"
RUN = "run_id bigint, shard int, batch_from int, batch_to int, outcome string"


def feed(rng, n, hot=0.4):
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice(["a", "A", " a", "b", "ü", "", None, *map(str, range(40))])
        op = rng.choice(["P", "p ", "P", "D", " d", "G", None])
        v = None if rng.random() < 0.1 else rng.choice(["", "x", f"v{i}"])
        rows.append((100 + 7 * i, op, k, v, i % 3, i // 50))
    rows += [rng.choice(rows) for _ in range(n // 5)]
    rng.shuffle(rows)
    return rows


def valid(op, k, v):
    op = (op or "").strip().upper()
    return bool(k) and (op == "P" and v is not None or op == "D")


def expected_state(base, rows):
    best = {k: (s, v) for k, v, s in base if k}
    for seq, op, k, v, *_ in rows:
        if valid(op, k, v) and seq > best.get(k, (-1, 0))[0]:
            best[k] = (seq, v if op.strip().upper() == "P" else None)
    return {(k, v, s) for k, (s, v) in best.items() if v is not None}


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.95])
def test_changes_against_brute_force(spark, hot):
    rng = random.Random(hot)
    rows = feed(rng, 1500, hot)
    # older than, in the midst of and ahead of the key's changes; tombstones; the same version as a change
    base = [("hot", "base", 5000), ("a", "old", 1), ("A", None, 10**9), ("b", "ahead", 10**9), ("only", "base", 3), ("", "x", 4), (None, "x", 5), ("gone", None, 6)]
    one = next(r for r in rows if valid(*r[1:4]) and r[1].strip().upper() == "P" and r[2] not in ("hot", "a", "A", "b"))
    base.append((one[2], one[3], one[0]))
    got = apply_changes(spark.createDataFrame(base, schema.KV_STATE), spark.createDataFrame(rows, LOG))
    assert {tuple(r) for r in got.collect()} == expected_state(base, rows)
    assert got.count() == len(expected_state(base, rows))
    kept = apply_changes(spark.createDataFrame(base, schema.KV_STATE), spark.createDataFrame(rows, LOG), tombstones=True)
    assert kept.where("k = 'gone' and v is null").count() == 1


def test_changes_of_odd_tables(spark):
    none, empty = spark.createDataFrame([], schema.KV_STATE), spark.createDataFrame([], LOG)
    assert apply_changes(none, empty).collect() == []
    base = spark.createDataFrame([("k", "v", 1, "extra")], schema.KV_STATE + ", m string")
    assert [tuple(r) for r in apply_changes(base, empty).collect()] == [("k", "v", 1)]
    clash = spark.createDataFrame([(2, "P", "k", "w" * 100_000, 0, 0, 9, 9)], LOG + ", _part int, m int")
    assert [(r.k, len(r.v), r.seq) for r in apply_changes(base, clash).collect()] == [("k", 100_000, 2)]
    nulls = spark.createDataFrame([(None, None, None, None, None, None), (None, "P", "k", "z", 0, 0)], LOG)
    assert [tuple(r) for r in apply_changes(base, nulls).collect()] == [("k", "v", 1)]


def test_increments_against_brute_force(spark):
    rng = random.Random(5)
    rows = feed(rng, 900)
    rows = [(s, o, k, v, None if rng.random() < 0.02 else sh, None if rng.random() < 0.02 else b) for s, o, k, v, sh, b in rows]
    runs = [(1, 0, 0, 3, "started"), (1, 0, 0, 3, "done"), (1, 0, 0, 3, "done"), (2, 1, 2, 9, "failed"), (3, 1, 2, 5, " DONE "), (4, 2, 9, 4, "done"), (5, None, 1, 2, "done"), (6, 0, None, 2, "done"), (7, 2, 0, 6, "killed"), (8, 2, 6, 7, "started"), (9, 0, 2, 6, "done")]
    cover = {(sh, b) for r, sh, f, t, _ in runs if any(x[0] == r and x[4].strip().lower() == "done" for x in runs) and None not in (sh, f, t) for b in range(f, t + 1)}
    taken = {r[0] for r in rows if (r[4], r[5]) in cover}
    want = {r[0] for r in rows if valid(*r[1:4]) and r[0] not in taken}
    log, run_log = spark.createDataFrame(rows, LOG), spark.createDataFrame(runs, RUN)
    got = [r.seq for r in pending_changes(log, run_log).collect()]
    assert sorted(got) == sorted(want)
    assert {tuple(r) for r in covered_batches(run_log).collect()} == cover
    nothing = spark.createDataFrame([], RUN)
    assert pending_changes(log, nothing).count() == len({r[0] for r in rows if valid(*r[1:4])})
    assert pending_changes(spark.createDataFrame([], LOG), run_log).count() == 0
    clash = log.withColumn("_done", F.lit(True)).withColumn("outcome", F.lit("x"))
    assert sorted(r.seq for r in pending_changes(clash, run_log).collect()) == sorted(want)


def test_runs_survive_failures(spark, tmp_path):
    folder, out = f"file://{tmp_path}/runs", f"file://{tmp_path}/out"
    rows = [("a", 1), ("b", 2), (None, 3), ("c", 4)]
    runs = Increments(spark, folder)

    def process(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/n={n}")

    def dies(batch, n):
        process(batch, n)
        raise OSError("lost")

    table = lambda some: spark.createDataFrame(some, "k string, seq bigint").withColumn("low", F.lit("clash"))
    with pytest.raises(OSError):
        runs.run(table(rows), dies)
    assert runs.last() is None
    assert runs.run(table([*rows, rows[0]]), process, oldest_open=3) == 0
    assert runs.run(table([*rows, ("d", 3), ("e", 9)]), process, oldest_open=9) == 1
    assert runs.run(table([*rows, ("d", 3), ("e", 9)]), process) == 2
    got = spark.read.parquet(out).select("k", "seq").collect()
    assert sorted(map(str, got)) == sorted(map(str, table([*rows, ("d", 3), ("e", 9)]).select("k", "seq").collect()))


def test_runs_read_from_the_oldest_open_record(spark, tmp_path, monkeypatch):
    source = f"file://{tmp_path}/source"
    spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq")).repartitionByRange(10, "seq").write.parquet(source)
    runs, taken = Increments(spark, f"file://{tmp_path}/runs"), []
    run = lambda upto, low: runs.run(spark.read.parquet(source).where(F.col("seq") < upto), lambda b, n: taken.append(b.count()), low)
    run(300, 250)
    run(700, 650)
    plan = runs.pending(spark.read.parquet(source))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(seq,650)") >= 2
    assert [p["path"][:9] for p in runs.last()["ledger"]] == ["batches/1"]
    monkeypatch.setattr("tidelog.operators.incremental.LEDGER_BATCHES", 1)
    run(900, 650)
    assert [p["path"] for p in runs.last()["ledger"]] == ["ledger/2"]
    run(1000, 650)
    run(1000, 650)
    assert taken == [300, 400, 200, 100, 0]
    other = Increments(spark, runs.folder)
    with pytest.raises(FileExistsError):
        other.run(spark.read.parquet(source), lambda b, n: runs.run(spark.read.parquet(source), lambda *_: None, 650), 650)


def test_covered_batches_are_not_read(spark):
    runs = [(1, 0, 1, 4, "done"), (2, 1, 1, 6, "done"), (3, 0, 6, 7, "done")]
    covered = covered_batches(spark.createDataFrame(runs, RUN))
    log = spark.createDataFrame([(s, b) for s in (0, 1, 2, None) for b in (0, 1, 3, 4, 5, 7, None)], "shard int, batch_no int")
    left = {tuple(r) for r in log.where(~maybe_open(covered)).collect()}
    assert left == {(s, b) for s in (0, 1) for b in (1, 3, 4)}
    assert log.where(maybe_open(covered.limit(0))).count() == log.count()


def wal_rows(rng):
    """Files with copies of records, torn and damaged ones; the records that can be read from them."""
    seq, files, want, pool = 0, [], {}, []
    for i in range(60):
        data, dead = b"", False
        for _ in range(rng.choice([0, 1, 2, 5, 40])):
            if pool and rng.random() < 0.2:
                record, s = rng.choice(pool)
            else:
                seq += rng.randrange(1, 90)
                v = None if rng.random() < 0.3 else "é" * rng.randrange(200)
                record, s = encode("D" if v is None else "P", f"key{seq}", v, seq), seq
                pool.append((record, s))
            if rng.random() < 0.03:
                record, dead = record[:9] + bytes([record[9] ^ 1]) + record[10:], True
            data += record
            if not dead:
                want[s] = record
        tail = rng.choice([b"", b"", bytes(4), bytes(9), encode("D", "cut", None, 10**9)[:-3]])
        files.append((f"logs/s{i % 3}/{rng.choice(['', 'retry/'])}{i:024x}.wal", None if rng.random() < 0.1 else len(data + tail), data + tail))
    return files, want


def test_compaction_against_brute_force(spark):
    files, want = wal_rows(random.Random(3))
    files += [files[0], (files[1][0], 0, files[2][2]), ("empty", 0, b""), ("null", None, None), (None, 1, files[3][2]), ("junk", 5, b"\x07" * 64)]
    table = spark.createDataFrame(files, schema.WAL_FILE).withColumn("fid", F.lit("clash")).withColumn("bin", F.lit(1))
    out = compact_log_files(table, target=4096)
    got = [r.seq for r in out.sequence_numbers().collect()]
    assert sorted(got) == sorted(want)
    made = out.files.collect()
    assert sum(f.n for f in made) == len(want) and 3 <= len(made) < 20
    for f in made:
        data = read_whole(f.file)
        for at, size, n, path, offset in footer_of(data)["blocks"]:
            source = next(c for p, _, c in files if (p or "") == path and c and c[offset : offset + size] == data[at : at + size])
            assert source and n > 0
    records = {r for f in made for r in [f.bytes]}
    assert all(b <= 4096 + max(len(c or b"") for _, _, c in files) for b in records)


def test_first_sequence_number(spark):
    good = encode("P", "k", "v", 12345) + encode("P", "k", "w", 99)
    cases = [(good, 12345), (good[:-3], 12345), (b"", 0), (None, 0), (b"\x07", 0), (bytes(64), 0), (b"\xff" * 64, 0), (b"\x09\0\0\0" + b"\xff" * 9, 0)]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary").select("i", first_seq(F.col("content")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: x for i, (_, x) in enumerate(cases)}


def test_contents_are_shuffled_once(spark, monkeypatch):
    """Without any broadcast by size: one exchange of contents, and no join of them by file."""
    files, want = wal_rows(random.Random(5))
    table = spark.createDataFrame(files + [(f"logs/s1/copy{i}.wal", None, files[0][2]) for i in range(200)], schema.WAL_FILE)
    plans = []
    write = DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = compact_log_files(table, target=2048)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.seq for r in out.sequence_numbers().collect()) == sorted(want)
    # the other exchange is of the table of bits that is broadcast
    assert plans[-1].count("Exchange hashpartitioning(bin#") == 1 and plans[-1].count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" not in plans[-1]


def test_compaction_of_nothing(spark):
    empty = spark.createDataFrame([], schema.WAL_FILE)
    assert compact_log_files(empty).sequence_numbers().collect() == []
    assert compact_log_files(spark.createDataFrame([("p", None, None), ("q", 0, b""), ("r", 3, b"abc")], schema.WAL_FILE)).files.count() == 0


def test_compaction_of_one_record_in_most_files(spark):
    record = encode("P", "k", "v", 7)
    files = [(f"s0/{i}.wal", None, record + encode("P", "k", "v", 100 + i)) for i in range(300)]
    got = compact_log_files(spark.createDataFrame(files, schema.WAL_FILE)).sequence_numbers().collect()
    assert sorted(r.seq for r in got) == [7, *range(100, 400)]


def test_parquet_blocks(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.array("id").alias("a"), F.when(F.col("id") % 3 > 0, F.struct(F.rand(1).alias("x"))).alias("n"))
    rows.repartition(17).write.option("parquet.bloom.filter.enabled#s", "true").parquet(f"file://{tmp_path}/in/one")
    spark.range(5).select(F.lit("z").alias("other")).write.parquet(f"file://{tmp_path}/in/two")
    into, written = compact_parquet(spark, f"file://{tmp_path}/in", target=20_000)
    made = written.collect()
    assert sum(f.n for f in made) == 1005 and 2 <= len(made) < 17
    first = [f.file for f in made if f.n != 5]
    back = spark.read.parquet(*first)
    source = spark.read.parquet(f"file://{tmp_path}/in/one")
    assert back.schema == source.schema and back.count() == 1000
    assert sorted(map(str, back.collect())) == sorted(map(str, source.collect()))
    assert back.where("s = '3'").count() == source.where("s = '3'").count()
    with pytest.raises(ValueError, match="schema differs"):
        merge_files([made[0].file, *[f.file for f in made if (f.n == 5) != (made[0].n == 5)]], f"{tmp_path}/no.parquet")
    import pyarrow.parquet as pq

    assert pq.ParquetFile(first[0].replace("file://", "")).metadata.num_row_groups == read_footer(first[0])[0][4][1][1].__len__()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not a parquet file")
    with pytest.raises(Exception, match="not a Parquet file"):
        compact_parquet(spark, f"file://{tmp_path}/bad")


def test_segments_go_into_few_files(spark):
    rows = [(lvl, sg, f"k{i}", f"v{i}" if i % 5 else None, i) for lvl, sg, n in ((0, 1, 3), (0, 2, 1), (1, 3, 40), (1, 4, 2), (1, 5, 2), (None, 6, 4)) for i in range(n)]
    entries = spark.createDataFrame(rows * 2, schema.KV_SST)
    manifest = spark.createDataFrame([(1, 3, "k0", "k9", 1, 500, 40)], schema.MANIFEST)
    placed, written = consolidate(spark, entries, healed_manifest(manifest, entries), target=1000)
    files, made = placed.collect(), written.collect()
    assert sorted((f.sg, f.rows) for f in files) == [(1, 6), (2, 2), (3, 80), (4, 4), (5, 4), (6, 8)]
    assert sum(m.files for m in made) == len(files) > len(made) and sum(m.n for m in made) == len(rows) * 2
    back = spark.read.schema(entries.schema).parquet(*[m.file for m in made])
    assert sorted(map(str, back.collect())) == sorted(map(str, entries.collect()))


def test_p4_blocks_merges(spark, sf):
    counts = p_queries.p4_files(spark, sf).first()
    assert counts.files_before > 50 and counts.files_after <= 4
    assert counts.n_before == counts.n_after == spark.read.parquet(f"{sf}/kv_sst.parquet").count()


def test_order_within_hot_keys(spark):
    rng = random.Random(9)
    rows = [(s, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None])) for s in rng.sample(range(10**9), 3000)]
    table = spark.createDataFrame(rows, "seq bigint, k string, v string")
    split, hot = skew.hot_split(table, "k", "seq")
    assert hot and split.where("k = 'hot'").select("_part").distinct().count() > 20
    got = {r.seq: r._last for r in skew.last_before(table, "k", "seq", F.col("v")).collect()}
    last, want = {}, {}
    for s, k, v in sorted(rows, key=lambda r: r[0]):
        want[s] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert got == want


def test_largest_of_one_place_counts(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else "a", rng.randrange(120), rng.choice("pqrst")) for _ in range(900)]
    got = skew.last_before(spark.createDataFrame(rows, "k string, seq int, v string"), "k", "seq", F.col("v"), largest="v").collect()
    top, want, last = {}, set(), {}
    for k, s, v in rows:
        top[k, s] = max(v, top.get((k, s), ""))
    for (k, s), v in sorted(top.items()):
        want.add((k, s, v, last.get(k)))
        last[k] = v
    assert {(r.k, r.seq, r.v, r._last) for r in got} == want and len(got) == len(want)


def test_many_ranges(spark):
    table = spark.createDataFrame([(i * 3, "hot" if i % 3 else f"k{i % 5}", i) for i in range(4000)], "seq bigint, k string, v bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        want = sorted(map(tuple, skew.last_before(table, "k", "seq", F.col("v")).collect()))
        sums = sorted(map(tuple, skew.running_sum(table, "seq", F.col("v"), "a").collect()))
        spark.conf.set("spark.sql.shuffle.partitions", 560)
        assert 1000 < len(skew.whole_points(table, "seq", 1200)) < 1600
        spark.conf.set("spark.sql.shuffle.partitions", 530)
        assert sorted(map(tuple, skew.last_before(table, "k", "seq", F.col("v")).collect())) == want
        assert sorted(map(tuple, skew.running_sum(table, "seq", F.col("v"), "a").collect())) == sums
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_follow_the_rows_of_a_key(spark, monkeypatch):
    # one key in 300, one with a third of the rows, and many small ones
    n = 60_000
    table = spark.range(n).select((F.col("id") * 7).alias("seq"), F.expr("CASE WHEN id % 3 = 0 THEN 'third' WHEN id % 300 = 1 THEN 'some' ELSE concat('k', id % 30000) END").alias("k"))
    parts = lambda: {r.k: r.n for r in skew.hot_split(table, "k", "seq", n)[0].groupBy("k").agg(F.count_distinct("_part").alias("n")).collect()}
    got = parts()
    assert got["some"] >= 3 and got["third"] >= 256 and max(v for k, v in got.items() if k.startswith("k")) == 1
    monkeypatch.setattr(skew, "RANGE_ROWS", 500)
    got = parts()
    assert got["some"] == 1 and 32 <= got["third"] <= 80
    monkeypatch.setattr(skew, "COARSE", 4)
    two_steps = {k: p for k, p in skew.split_points(table, "k", "seq", {"third": 64, "some": 2}).items()}
    assert len(two_steps["some"]) == 1 and len(two_steps["third"]) == 63 and two_steps["third"] == sorted(two_steps["third"])
    gaps = [b - a for a, b in zip(two_steps["third"], two_steps["third"][1:])]
    assert max(gaps) < 3 * 7 * n / 64


def test_rows_that_may_be_among_members(spark):
    table = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit("clash").alias("_word"))
    some = table.where("k % 500 = 7").unionByName(spark.createDataFrame([(None, None)], "k string, _word string"))
    hash_ = lambda: F.when(F.col("k").isNotNull(), F.xxhash64("k"))
    got = may_be_among(table.unionByName(some), hash_(), some, hash_())
    assert got.where("k % 500 = 7").count() == 800 and got.count() < 850 and got.columns == table.columns
    assert may_be_among(table, hash_(), some.limit(0), hash_()).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), rng.randrange(9), f"{rng.random():.5f}") for i in rng.sample(range(10**6), 2000)]
    table = spark.createDataFrame(rows, "i bigint, g string, n int, s string")
    got = {r.i: (r.a, r.b) for r in skew.running_sum(skew.running_sum(table, "i", F.col("n"), "a"), "i", F.col("n"), "b", by=["g"]).collect()}
    total, of = 0, {"x": 0, "y": 0}
    for i, g, n, _ in sorted(rows):
        assert got[i] == (total, of[g])
        total, of[g] = total + n, of[g] + n
    text = {r.i: r.c for r in skew.running_sums(table, ["s", "i"], {"c": F.col("n")}, ["g"]).collect()}
    of = {"x": 0, "y": 0}
    for i, g, n, s in sorted(rows, key=lambda r: (r[3], r[0])):
        assert text[i] == of[g]
        of[g] += n
    assert skew.running_sum(table.limit(0), "i", F.col("n"), "a").collect() == []


def test_running_sums_keep_a_null_group(spark):
    table = spark.createDataFrame([(i, None if i % 3 == 0 else "x", 1) for i in range(90)], "i bigint, g string, n int")
    want = [(i, i // 3 if i % 3 == 0 else i - i // 3 - 1) for i in range(90)]
    assert sorted((r.i, r.a) for r in skew.running_sum(table, "i", F.col("n"), "a", by=["g"]).collect()) == want
    assert sorted((r.i, r.a) for r in skew.running_sums(table, ["i"], {"a": F.col("n")}, ["g"]).collect()) == want


def test_shared_folder_is_the_sessions(spark):
    assert work_dir(spark, "x").rsplit("/", 1)[0] == (spark.conf.get("spark.checkpoint.dir", None) or work_dir(spark, "y").rsplit("/", 1)[0]).rstrip("/")
