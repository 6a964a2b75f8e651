"""Operators for training data: brute force, round trips, labelled pages, odd tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import mixing, queries, ranking, seen, stuffing, survivors, tokens

SST = "lvl int, sg int, k string, v string, seq bigint"
DOC = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(name, compare):
    compare(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


# ---- best record


def test_parsing_and_known_values(spark):
    cases = [
        ('{"hash":"00ff00ff00ff00ff","size":5,"owner":"x"}', ("00ff00ff00ff00ff", None, None, "5", "x")),
        (' { "size": "007", "parent": "tree/1/root", "stamp": "2020-02-29T00:00:00Z" } ', (None, "tree/1/root", "2020-02-29T00:00:00Z", "007", None)),
        ("hash=00FF00ff00ff00ff; owner= me ;size=12;", ("00FF00ff00ff00ff", None, None, "12", "me")),
        ('{"hash":"00ff00ff00ff00ff","ow', (None,) * 5),
        ("hash=00ff00ff00ff00ff;own", (None,) * 5),
        ("owner=N/A;size=-1;stamp=1970-01-01T00:00:00Z;hash=0000000000000000;parent=-;", (None,) * 5),
        ('{"owner":null,"size":0,"stamp":"2021-02-30T00:00:00Z","hash":"xyz","parent":"idx"}', (None,) * 5),
        ('{"owner":{"a":1},"size":1.5}', ('{"a":1}', None)),
        ("", (None,) * 5),
        (None, (None,) * 5),
        ("[]", (None,) * 5),
    ]
    rows = [(0, 0, "k", v, i) for i, (v, _) in enumerate(cases)]
    got = {r.seq: tuple(r)[3:] for r in survivors.node_records(spark.createDataFrame(rows, SST)).collect()}
    for i, (v, want) in enumerate(cases):
        if len(want) == 5:
            assert got[i] == want, v
        else:
            assert (got[i][4], got[i][3]) == want


def test_best_records_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        k = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        rows.append((k, rng.randrange(400), rng.random() < 0.03, rng.choice([None, "a", "b", "c"]), rng.choice([None, "1", "2"])))
    rows = [(k, t, d, None if d else a, None if d else b) for k, t, d, a, b in rows]
    table = spark.createDataFrame(rows, "k string, seq bigint, dead boolean, a string, b string")
    got = {r.k: r for r in survivors.best_records(table, fields=("a", "b")).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        tomb = max((r[1] for r in own if r[2]), default=-1)
        assert got[k].n == len(own)
        for i, f in ((3, "a"), (4, "b")):
            best = max(((r[1], r[i]) for r in own if r[i] is not None and r[1] > tomb), default=None)
            best = best if best and not any(r[i] and r[1] <= tomb and r[1] == best[0] for r in own) else best
            assert (got[k][f] and tuple(got[k][f])) == best
    assert survivors.best_records(table.limit(0), fields=("a", "b")).collect() == []


def test_currency_of_values_without_a_time(spark):
    # z_new -> used -> a_sold is learned from timed rows; then groups where times are missing
    rows = [(f"t{i}", t, v) for i in range(5) for t, v in ((1, "z_new"), (2, "used"), (3, "a_sold"))] + [("t0", 9, "z_new")]
    rows += [("g", None, "used"), ("g", None, "z_new"), ("h", 5, "used"), ("h", None, "a_sold"), ("i", 5, "a_sold"), ("i", None, "z_new"), ("j", None, "odd"), ("j", None, "odd"), ("j", None, "zzz"), ("l", None, None), (None, None, "z_new")]
    # not direct successors; nothing known of the other value
    rows += [("m", None, "z_new"), ("m", None, "a_sold"), ("n", 5, "z_new"), ("n", None, "a_sold"), ("o", 5, "odd"), ("o", None, "a_sold"), ("p", None, "odd"), ("p", None, "a_sold")]
    table = spark.createDataFrame(rows, "k string, at bigint, owner string")
    got = {r.k: r.owner and tuple(r.owner) for r in survivors.best_records(table, "k", "at", ("owner",), None).collect()}
    assert got["g"] == (None, "used") and got["h"] == (None, "a_sold") and got["i"] == (5, "a_sold") and got["j"] == (None, "odd")
    assert got["l"] is None and got[None] == (None, "z_new") and got["t0"] == (9, "z_new") and got["t1"] == (3, "a_sold")
    assert got["m"] == got["n"] == (None, "a_sold") and got["o"] == (5, "odd") and got["p"] == (None, "a_sold")
    order = {tuple(r) for r in survivors.precedence(table, "k", "at", ("owner",)).collect()}
    assert {("owner", "z_new", "used"), ("owner", "used", "a_sold")} <= order
    numbers = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 2, 6), (3, None, 6), (3, None, 5)], "id int, at int, num int")
    assert {r.id: r.num.val for r in survivors.best_records(numbers, "id", "at", ("num",), None).collect()} == {1: "6", 2: "6", 3: "6"}


def brute_ranks(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {v: {b for a, b in edges if a == v} for v in nodes}
    while any(reach[v] != (new := reach[v].union(*(reach[w] for w in reach[v]))) and reach.update({v: new}) is None for v in nodes):
        pass
    same = lambda a, b: a == b or b in reach[a] and a in reach[b]

    def depth(v):
        return max((1 + depth(u) for u in nodes if v in reach[u] and not same(u, v)), default=0)

    part = {v: v for v in nodes}
    for _ in nodes:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    return {v: (depth(v), part[v]) for v in nodes}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=14))
def test_ranks_against_brute_force(edges):
    assert ranking.rank_graph(edges) == brute_ranks(edges)


def test_ranks_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(f, rng.choice("abcdefghij"), rng.choice("abcdefghij")) for f in "xy" for _ in range(11)] + [("z", str(i), str(i + 1)) for i in range(4)] + [("z", None, "1"), (None, "a", "b")]
    table = spark.createDataFrame(edges, "fld string, a string, b string")
    want = {(f, v): r for f in "xyz" for v, r in brute_ranks([e[1:] for e in edges if e[0] == f and None not in e]).items()}
    assert {(r.fld, r.val): (r["rank"], r.part) for r in ranking.ranks(table).collect()} == want
    monkeypatch.setattr(ranking, "GRAPH_EDGES", 0)
    assert {(r.fld, r.val): (r["rank"], r.part) for r in ranking.ranks(table).collect()} == want
    assert ranking.ranks(table.limit(0)).collect() == []


def test_stamped_values_below_a_tombstone_are_gone(spark):
    rec = lambda **f: "".join(f"{n}={v};" for n, v in f.items())
    rows = [("gone", rec(owner="old", stamp="2021-01-01T00:00:00Z"), 1), ("gone", None, 2)]
    rows += [("back", rec(owner="old", size=1, stamp="2022-01-01T00:00:00Z"), 1), ("back", None, 2), ("back", rec(owner="new", stamp="2020-01-01T00:00:00Z"), 3)]
    # sizes: 5 is followed by 6; without a time 6 is taken
    for i in range(3):
        rows += [(f"t{i}", rec(size=5, stamp="2020-01-01T00:00:00Z"), 1), (f"t{i}", rec(size=6, stamp="2021-01-01T00:00:00Z"), 2)]
    rows += [("u", rec(size=5, stamp="2022-01-01T00:00:00Z"), 1), ("u", rec(size=6), 2)]
    best = queries.by_stamp(spark.createDataFrame([(0, 0, *r) for r in rows], SST))
    got = {r.k: r for r in best.collect()}
    assert "gone" not in got and got["back"].owner.val == "new" and got["back"]["size"] is None
    assert got["u"]["size"].val == "6" and got["t0"]["size"].val == "6"


# ---- seen before


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=200), st.integers(0, 30))
def test_coded_blocks_round_trip(values, rice):
    values = np.array(sorted(values), dtype=np.int64)
    rice = max(rice, 26)  # else the unary part of such gaps is long
    unary, bits = seen.encode_block(values, rice)
    assert seen.decode_block(bits, len(values), rice, unary).tolist() == values.tolist()


def test_coded_blocks_of_dense_values():
    values = np.arange(1000)
    for rice in (0, 1, 5):
        unary, bits = seen.encode_block(values, rice)
        assert seen.decode_block(bits, 1000, rice, unary).tolist() == values.tolist()


def test_seen_against_brute_force(spark):
    rng = random.Random(8)
    earlier = [(rng.choice([None, "", *map(str, range(500))]),) for _ in range(3000)]
    asked = [(i, "hot" if rng.random() < 0.4 else rng.choice([None, "", "1 ", "ü", *map(str, range(1500))])) for i in rng.sample(range(10**6), 3000)]
    known, want, before = {k for (k,) in earlier if k}, set(), set()
    for i, k in sorted(asked):
        if k and (k in known or k in before):
            want.add(i)
        before.add(k)
    left, right = spark.createDataFrame(earlier, "k string"), spark.createDataFrame(asked, "in_id bigint, k string").withColumn("maybe", F.lit(1))
    out = seen.seen_before(left, right, fp_bits=4, audit=True)
    assert sorted(r.in_id for r in out.rows.collect()) == sorted(want)
    report = out.report().first()
    assert report.false_negatives == 0 and report.false_positives > 0 and report.keys_held <= 500
    assert 0.2 * report.fp_theory < report.fp_audited < 4 * report.fp_theory and report.bits_per_key < 16
    told = {r.in_id for r in out.told.collect()}
    assert told >= want and len(told - want) == report.false_positives
    few = seen.seen_before(left, right)
    assert sorted(r.in_id for r in few.rows.collect()) == sorted(want)
    nothing = seen.seen_before(left.limit(0), right)
    assert sorted(r.in_id for r in nothing.rows.collect()) == sorted(i for i, k in asked if k and any(j < i for j, x in asked if x == k))
    assert seen.seen_before(left, right.limit(0), audit=True).report().first().keys_asked == 0


def test_set_is_kept(spark, tmp_path):
    held = seen.build(spark.range(20_000).select(F.col("id").cast("string").alias("k")))
    assert held.blocks.count() > 1
    held.save(str(tmp_path / "set"))
    back = seen.GolombSet.load(spark, str(tmp_path / "set"))
    asked = spark.range(10_000, 40_000).select(F.col("id").cast("string").alias("k"))
    found = seen.probe(back, asked).where("maybe")
    assert found.where("cast(k as int) < 20000").count() == 10_000 and found.count() < 10_100


def test_set_is_extended(spark):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
    held = seen.build(keys(0, 30_000))
    some = keys(29_990, 30_020).unionByName(spark.createDataFrame([(None,), ("",)], "k string"))
    more = seen.extended(held, some)
    assert more.blocks.count() == held.blocks.count() > 2
    assert more.blocks.agg(F.sum("n")).first()[0] - held.blocks.agg(F.sum("n")).first()[0] in range(18, 21)
    assert seen.probe(more, keys(0, 30_020)).where("not maybe").count() == 0
    assert seen.probe(more, keys(40_000, 50_000)).where("maybe").count() < 30
    first = seen.extended(seen.build(keys(0, 0)), keys(0, 50))
    assert seen.probe(first, keys(0, 50)).where("maybe").count() == 50
    assert seen.extended(held, keys(0, 0)).blocks.count() == held.blocks.count()


def test_groups_of_asked_keys_are_bounded(spark, monkeypatch):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
    held = seen.build(keys(0, 5000))
    monkeypatch.setattr(seen, "ASK_ROWS", 4000)
    groups, subs = seen.asked_groups(held, keys(0, 200_000), "k")
    assert held.blocks.count() == 1 and subs == 50
    assert groups.groupBy("_block", "_sub").count().agg(F.max("count")).first()[0] < 4600
    found = seen.probe(held, keys(0, 200_000)).where("maybe")
    assert found.where("cast(k as int) < 5000").count() == 5000 and found.count() < 5200
    # an extension by many keys is cut into more blocks
    more = seen.extended(held, keys(5000, 120_000))
    assert more.block_bits > held.block_bits and more.blocks.agg(F.max("n")).first()[0] < 2 * seen.BLOCK_KEYS
    assert seen.probe(more, keys(0, 120_000)).where("not maybe").count() == 0
    same = seen.divided(held, 3)
    assert same.blocks.count() == 8 and same.blocks.agg(F.sum("n")).first()[0] == held.blocks.agg(F.sum("n")).first()[0]
    assert seen.probe(same, keys(0, 5000)).where("not maybe").count() == 0


def test_check_shuffles_no_unasked_keys(spark, monkeypatch):
    left = spark.range(100_000).select(F.col("id").cast("string").alias("k"))
    right = spark.range(50).select(F.col("id").alias("in_id"), (F.col("id") + 99_975).cast("string").alias("k"))
    out = seen.seen_before(left, right)
    assert sorted(r.in_id for r in out.rows.collect()) == list(range(25))
    plan = out.confirmed._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "Range (0, 100000" in x][0].index("Range")
    above = [x.strip(" :+-*()0123456789") for x in plan[: plan.index("Range (0, 100000")].splitlines()]
    assert scan and [x.split()[0] for x in above if x.startswith(("BroadcastHashJoin", "Exchange"))][-1] == "BroadcastHashJoin"


# ---- tokens

ODD = ["", None, " ", "a", "naïve 数据 🙂🙂", "<|endoftext|> is text", "\n\n\t  x", "é", "ﬀ​﻿", "\x00\x01", "word " * 30_000, "x" * 200_000, "🙂" * 3000]


def test_tokens_round_trip(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    coded = tokens.encode(table, offsets=True)
    got = {r.doc_id: r for r in coded.collect()}
    assert got[0].ids == [] and got[1].ids == [] and len(got) == len(ODD)
    back = {r.doc_id: r.text for r in tokens.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    for i, t in enumerate(ODD):
        r = got[i]
        assert len(r.ids) == len(r.starts) == len(r.ends) and all(0 <= a < b <= len(t) for a, b in zip(r.starts, r.ends))
    library = tokens.tokenizer(tokens.BYTE_BPE_50K)
    for i, t in enumerate(ODD):
        assert list(zip(got[i].starts, got[i].ends)) == library.encode(t or "", add_special_tokens=False).offsets
    plain = {r.doc_id: r.ids for r in tokens.encode(table).collect()}
    assert plain == {i: r.ids for i, r in got.items()}
    assert 50256 not in plain[5]
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(table).collect()}
    assert counts == {i: len(x) for i, x in plain.items()}
    assert tokens.encode(table.limit(0)).collect() == []


def test_other_library_agrees():
    import base64

    import tiktoken

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = tokens.tokenizer(tokens.BYTE_BPE_50K)
    for t in ODD:
        assert mine.encode(t or "", add_special_tokens=False).ids == other.encode_ordinary(t or "")
    assert [tokens.token_bytes(tokens.BYTE_BPE_50K)[i] for i in range(50256)] == [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]


def test_split_characters(spark):
    cut = tokens.tokenizer(tokens.BYTE_BPE_50K).encode("a🙂", add_special_tokens=False).ids
    lists = [(0, cut[:2]), (1, None), (2, []), (3, cut), (4, cut[1:]), (5, list(range(50257)) * 40)]
    got = {r.doc_id: r.text for r in tokens.decode(spark.createDataFrame(lists, "doc_id bigint, ids array<int>")).collect()}
    assert got == {i: None if x is None else tokens.decode_ids(x) for i, x in lists} and got[3] == "a🙂" and got[0] == "a�"
    ids = tokens.tokenizer(tokens.BYTE_BPE_50K).encode("数🙂", add_special_tokens=False).ids
    assert len(ids) > 2 and tokens.decode_ids(ids) == "数🙂" and tokens.decode_ids(ids[:1]) == "�"
    assert len(tokens.byte_alphabet()) == 256


# ---- mixing


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 9), "big") for i in range(4000)] + [(10_000 + i, "word " * (1 + i % 7), "small") for i in range(400)] + [(20_000 + i, "x", "free") for i in range(50)] + [(30_000, None, "small"), (30_001, "", None), (30_002, "null source", None)]
    target = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2), ("empty", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeat int")
    sizes = mixing.sized(spark.createDataFrame(docs, DOC), target)
    rated = mixing.rates(sizes, target)
    rate = {r.source: r for r in rated.collect()}
    assert set(rate) == {"big", "small", "empty"} and rate["empty"].rate == 0 and max(r.rate / r.max_repeat for r in rate.values()) == pytest.approx(1)
    used = mixing.mix(sizes, rated).collect()
    by = {}
    for r in used:
        by.setdefault((r.source, r.doc_id), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= rate[s].max_repeat for (s, _), c in by.items())
    assert all(len(c) in (int(rate[s].rate), int(rate[s].rate) + 1) for (s, _), c in by.items())
    got = {r.source: r for r in mixing.shares(mixing.mix(sizes, rated), rated).collect()}
    assert abs(got["big"].actual_share - 0.6) < 0.02 and abs(got["small"].actual_share - 0.4) < 0.02 and got["empty"].tokens == 0
    assert sorted(map(str, used)) == sorted(map(str, mixing.mix(sizes.repartition(7), rated).collect()))
    whole = mixing.mix(mixing.sized(spark.createDataFrame(docs, DOC), target, keep=("text",)), rated).collect()
    texts = {i: t for i, t, _ in docs}
    assert sorted((r.doc_id, r["copy"]) for r in whole) == sorted((r.doc_id, r["copy"]) for r in used) and all(r.text == texts[r.doc_id] for r in whole)
    cut = mixing.rates(sizes, target, total=1e9)
    assert {r.source: r.rate for r in cut.collect()} == {"big": 1.0, "small": 3.0, "empty": 0.0}
    assert mixing.mix(sizes.limit(0), mixing.rates(sizes.limit(0), target)).collect() == []
    assert mixing.shares(mixing.mix(sizes.limit(0), rated), rated).where("actual_share is null").count() == 3


# ---- stuffed pages

PROSE = "The inquiry into the garden was opened on Friday, when Mr. Hale said\nthat the old bridge had been repaired before June. It is reported from\nNorby that nobody was hurt, but the mill and the school were damaged.\nVisitors will notice how the station has changed; more will follow."
STUFFED = {
    "keywords": "cheap boots best boots boots coats cheap\nboots, boots, coats boots sale boots\ncoats cheap boots coats best coats boots\nboots boots cheap coats sale boots coats",
    "phrases": "where to buy boots - boots in Norby - who sells boots in\nHalby - how much are boots - boots near Selby - the best\nboots of all - boots for you - where to buy boots - boots\nand boots - who sells boots in Torby - boots in Linby",
    "links": "http://www.boots.example/p12.html\nsales@boots-online.invalid\nwww.coats24.test?id=77\ncheap hats http : // hats-shop . example/hats\ninfo@gloves.example",
    "menu": "» home\n» see boots\n» next\n» all coats here\n» back\n» see boots\n» more coats\n» home\n» next\n» see coats",
    "tags": "#boots #coats12 #hats #boots\n#hatsCoats #boots #gloves\n#coats #hats #boots7 #gloves\n#boots #gloves #hats",
    "articles": "Art. 1234 boots cheap coats best\nArt. 2234 hats sale boots finest\nArt. 9234 coats cheap hats best\nArt. 4423 boots best coats sale",
}
OTHER = {
    "prose": PROSE,
    "timetable": "13.06 Torford > Cromham > Yarden 22.52\n19.14 Marmere > Torcombe > Garham 10.07\n11.13 Calmouth > Holmouth > Torden 17.02\n9.08 Fenden > Quillgate > Kelmouth 20.27",
    "prices": "Coats .......... 11s. 1d.\nHats ........... 4s. 6d.\nBoots .......... 12s. 0d.\nSelmouth  33  36  -1",
    "results": "1. Hale (Norby) 3m 26s\n2. Holund (Thorn) 2m 44s\n3. Brenost (Selby) 4m 1s\n4. Dunash (Quill) 1m 29s",
    "names": "Mrs. Brenoran, Miss Holelin,\nMr. Dorett, Mrs. Pemock, Mr.\nKelund, Dr. Velison, Miss Ash,\nMrs. Veloran, Dr. Dunett, Mr. Hale",
    "links in an article": PROSE + "\nwww.garden.example\n" + PROSE,
    "nothing": "- 3 -",
    "few": "boots boots boots",
    "empty": "",
    "blank": " \n\n \t",
    "null": None,
}


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    return stuffing.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/page_label.parquet"))


def test_stuffed_pages(spark, model):
    pages = [*STUFFED.items(), *OTHER.items(), ("mixed", PROSE.split("\n")[0] + "\n" + STUFFED["keywords"]), ("long", (PROSE + "\n") * 2000)]
    table = spark.createDataFrame(pages, "doc_id string, text string").withColumn("share", F.lit("clash")).withColumn("words", F.lit(1))
    got = {r.doc_id for r in stuffing.stuffed_pages(table, model=model).collect()}
    assert got - {"mixed"} == set(STUFFED)
    assert stuffing.stuffed_pages(table.limit(0), model=model).collect() == []
    assert {r.doc_id for r in stuffing.stuffed_pages(table, model=model, least_words=30).collect()} < got
    assert stuffing.non_prose_share(table).where("doc_id in ('null', 'empty', 'blank')").where("words = 0 and share = 0").count() == 3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths = [1, 4, 2, 5, 3]
    page = np.repeat(np.arange(5) * 2, lengths)
    n = len(stuffing.LABELS)
    score = np.log(rng.random((len(page), n)))
    got = stuffing.most_likely(page, score, stuffing.prior())
    move = np.log(np.where(np.eye(n), stuffing.STAY, (1 - stuffing.STAY) / (n - 1)))
    for p in np.unique(page):
        own = np.nonzero(page == p)[0]
        best = max(itertools.product(range(n), repeat=len(own)), key=lambda x: np.log(stuffing.START[x[0]]) + sum(score[i, s] for i, s in zip(own, x)) + sum(move[a, b] for a, b in zip(x, x[1:])))
        assert tuple(got[own]) == best
    assert len(stuffing.most_likely(np.zeros(0, int), np.zeros((0, n)), stuffing.prior())) == 0


def test_chances_add_up():
    for table in stuffing.prior().emissions.values():
        assert np.allclose(np.sum(table, axis=1), 1) and len(table) == len(stuffing.LABELS)


def test_training(spark):
    pages = [(i, t) for i, t in enumerate([*STUFFED.values(), *OTHER.values()])]
    documents = spark.createDataFrame(pages, "doc_id bigint, text string").withColumn("is_spam", F.lit("clash"))
    kinds = "doc_id bigint, rater string, is_spam int"
    labels = [(i, "a", int(i < len(STUFFED))) for i, _ in pages] + [(0, "b", None), (1, "b", 0), (None, "a", 1), (999, "a", 1), (2, "c", 7), (6, "b", 0)]
    base, model = stuffing.prior(), stuffing.fit(documents, spark.createDataFrame(labels, kinds), pages=50)
    for table in [*model.emissions.values(), model.move, model.start[None]]:
        assert np.allclose(table.sum(axis=1), 1) and (table > 0).all()
    assert model.emissions["capitals"][stuffing.MENU, 0] > base.emissions["capitals"][stuffing.MENU, 0]
    none = stuffing.fit(documents, spark.createDataFrame([], kinds))
    assert all(np.allclose(none.emissions[n], t) for n, t in base.emissions.items()) and np.allclose(none.move, base.move)
    # a page that is no spam is never counted with labels of spam, nor the other way round
    kept = stuffing.count_lines(pa.array([OTHER["links in an article"], STUFFED["menu"]]), np.array([0, 1]), base)
    assert kept["signs"].sum() == 19 and kept["move"][: stuffing.LINKS, : stuffing.LINKS].sum() >= 8
    assert kept["start"][stuffing.RECORD] + kept["start"][stuffing.NOTICE] <= 1 and kept["start"].sum() == 2
    spam = stuffing.count_lines(pa.array([STUFFED["menu"]]), np.array([1]), base)
    assert spam["signs"][[stuffing.RECORD, stuffing.NOTICE]].sum() == 0


def test_labels_decide(spark, model):
    """Held-out labels, some of which are wrong; and what was learned flags other pages than the first guess."""
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/page_label.parquet")
    got = stuffing.held_out(documents, labels)
    assert got["pages"] > 300 and got["recall"] >= 0.9 and got["precision"] >= 0.9
    first, learned = ({r.doc_id for r in stuffing.stuffed_pages(documents, model=m).collect()} for m in (stuffing.prior(), model))
    assert len(first ^ learned) > 20


def test_labelled_pages(spark):
    """Accuracy against the raters' opinions, some of which are wrong."""
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id for r in queries.p8_found(spark, sf).collect()}
    label = spark.read.parquet(f"{sf}/page_label.parquet").where("is_spam is not null").groupBy("doc_id").agg(F.avg("is_spam").alias("y")).where("y in (0, 1)").collect()
    right = sum((r.doc_id in found) == (r.y == 1) for r in label)
    assert right >= 0.95 * len(label)


def test_misread_words_are_one():
    known: dict = {}
    assert stuffing._same_as("boots", known) == stuffing._same_as("b0ots", known) == stuffing._same_as("hoots", known) != stuffing._same_as("coats", known)
    assert stuffing._same_as("1900", known) == stuffing._same_as("where" if "where" in stuffing.FUNCTION_WORDS else "the", known) == -1


def test_parts_of_long_pages():
    size = stuffing.PAGE_BYTES
    texts = pa.array(["a", None, "b" * size, "c", "d" * (size // 2), "e" * (size // 2)] + ["f"] * 5000)
    parts = list(stuffing._parts(texts))
    assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == len(texts)
    assert max(p[1] for p in parts) <= stuffing.PAGES and list(stuffing._parts(texts.slice(0, 0))) == []


def test_features_of_no_pages():
    assert len(stuffing.line_features(pa.array([], pa.string()))["page"]) == 0
