"""The store as a whole, against a dict."""

import random

import pytest

from tidelog import store as module
from tidelog.store import Store

KINDS = "ord bigint, op string, k string, v string"


@pytest.mark.parametrize("flush_at", [1 << 30, 400])
def test_store_against_a_dict(spark, tmp_path, flush_at, monkeypatch):
    rng, model, log, folder = random.Random(flush_at), {}, {}, f"file://{tmp_path}/store"
    for batch in range(3):
        store = Store(spark, folder, flush_at, level_target=500)  # opened anew each time
        flushed = store.levels.highest()
        log = {k: x for k, x in log.items() if flushed is None or x[1] > flushed}
        rows, want = [], []
        for i in range(25):
            op, k = rng.choice(["P", " p", "D", "G", "G"]), rng.choice("abcdefgh")
            v = f"v{batch}.{i}" if op.strip().upper() == "P" else None
            rows.append((i, op, k, v))
            now = model.get(k)
            if op == "G":
                want.append((i, 2 if now is None else 0, now))
            else:
                # previous values are those of the log alone
                want.append((i, 0, now if k in log else None))
                model[k] = v
                log[k] = (v, 1 << 60)
        rows += [(100, "P", "a", None), (101, "P", "", "x"), (102, "D", None, None), (103, "?", "a", None), (104, "G", None, None)]
        want += [(100, 6, None), (101, 7, None), (102, 7, None), (103, 7, None), (104, 2, None)]
        got = store.write(spark.createDataFrame(rows, KINDS).repartition(3))
        answers = got.collect()
        assert sorted((r.ord, r.rc, r.payload) for r in answers) == sorted(want)
        assert {r.ord for r in answers if r.seq is not None} == {i for i, o, k, v in rows[:25] if o != "G"}
        for r in answers:
            if r.seq is not None:
                log[r.k] = (log[r.k][0], max(r.seq, log[r.k][1] if log[r.k][1] < 1 << 60 else -1))
        again = Store(spark, folder, flush_at, level_target=500)
        assert {r.k: r.v for r in again.state().collect()} == {k: v for k, v in model.items() if v is not None}
        assert again.get("a") == model.get("a") and again.get("none") is None
    found = again.multi_get(spark.createDataFrame([(k,) for k in "abz"], "k string")).collect()
    assert {r.k: (r.rc, r.v) for r in found} == {k: (0, model[k]) if model.get(k) is not None else (2, None) for k in "abz"}
    if flush_at == 400:
        assert again.levels.highest() is not None
        # parts of the log that were flushed and can be no longer read by answers are gone
        again.flush()
        again.flush()
        parts = again._parts()
        assert len(parts) == 1 and parts[0]["part"] == f"{2:012d}" and len(list((tmp_path / "store" / "log").iterdir())) == 1
        assert {r.k: r.v for r in again.state().collect()} == {k: v for k, v in model.items() if v is not None}
    before = again.state().collect()

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(module, "write_new", dies)
    with pytest.raises(OSError):
        again.write(spark.createDataFrame([(0, "P", "a", "never")], KINDS))
    monkeypatch.undo()
    assert sorted(map(str, Store(spark, folder).state().collect())) == sorted(map(str, before))
    Store(spark, folder).write(spark.createDataFrame([(0, "P", "a", "after")], KINDS))
    assert Store(spark, folder).get("a") == "after"
