import random

from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.operators import index as IX


def snapshot(spark, docs, mtimes):
    rows = [(p, t, len(t.encode()), mtimes[p]) for p, t in sorted(docs.items())]
    return spark.createDataFrame(rows, "path string, text string, size long, mtime_ns long")


def tables(idx):
    post = sorted(tuple(r) for r in idx.postings.select("term", "path", "tf", "dl").collect())
    ts = sorted((r.term, r.df, round(r.idf, 9)) for r in idx.term_stats.collect())
    ds = sorted(tuple(r) for r in idx.ordinal().select("path", "dl", "prank").collect())
    return post, ts, ds


def test_refresh_equals_rebuild_random(spark):
    rnd = random.Random(3)
    vocab = list("abcdefgh")
    for _ in range(3):
        docs1 = {f"f{i}.txt": " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 6))) for i in range(8)}
        m1 = {p: 1 for p in docs1}
        docs2, m2 = {}, {}
        for p, t in docs1.items():
            r = rnd.random()
            if r < 0.2:
                continue                                    # removed
            if r < 0.5:
                docs2[p], m2[p] = t + " " + rnd.choice(vocab), 2   # changed
            else:
                docs2[p], m2[p] = t, 1                      # unchanged
        for i in range(rnd.randint(0, 3)):
            docs2[f"new{i}.txt"], m2[f"new{i}.txt"] = rnd.choice(vocab), 1
        prev, _ = IX.refresh(IX.empty_state(spark), snapshot(spark, docs1, m1))
        new, changes = IX.refresh(prev.__class__(prev.manifest, prev.index.materialize(), prev.config),
                                  snapshot(spark, docs2, m2))
        fresh = bm25.build_index(snapshot(spark, docs2, m2))
        assert tables(new.index) == tables(fresh)


def test_unchanged_and_single_change(spark):
    docs = {"a.txt": "alpha beta", "b.txt": "gamma"}
    s1 = snapshot(spark, docs, {"a.txt": 1, "b.txt": 1})
    state, _ = IX.refresh(IX.empty_state(spark), s1)
    again, ch = IX.refresh(state, s1)
    assert IX.changed_flag(ch).first().changed is False
    s2 = snapshot(spark, {"a.txt": "alpha beta delta", "b.txt": "gamma"}, {"a.txt": 2, "b.txt": 1})
    new, ch2 = IX.refresh(state, s2)
    assert {r.path: r.status for r in ch2.collect()} == {"a.txt": "changed", "b.txt": "unchanged"}
    old_h = {r.path: r.hash for r in state.manifest.collect()}
    new_h = {r.path: r.hash for r in new.manifest.collect()}
    assert old_h["b.txt"] == new_h["b.txt"] and old_h["a.txt"] != new_h["a.txt"]


def test_hash_compare_sees_same_stat_edits(spark):
    s1 = snapshot(spark, {"a.txt": "alpha"}, {"a.txt": 1})
    s2 = snapshot(spark, {"a.txt": "omega"}, {"a.txt": 1})     # same size and mtime
    state, _ = IX.refresh(IX.empty_state(spark), s1)
    assert IX.refresh(state, s2)[1].first().status == "unchanged"
    assert IX.refresh(state, s2, compare="hash")[1].first().status == "changed"


def test_state_round_trip_and_corrupt_state(spark, tmp_path):
    s1 = snapshot(spark, {"a.txt": "alpha", "b.txt": "beta"}, {"a.txt": 1, "b.txt": 1})
    state, _ = IX.refresh(IX.empty_state(spark), s1)
    IX.write_state(state, str(tmp_path / "st"))
    back = IX.read_state(spark, str(tmp_path / "st"))
    assert tables(back.index) == tables(state.index)
    assert IX.refresh(back, s1)[1].filter("status != 'unchanged'").count() == 0
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk" / "config").write_text("not parquet")
    assert IX.read_state(spark, str(tmp_path / "junk")).manifest.count() == 0


def test_save_to_the_folder_it_was_read_from(spark, tmp_path):
    base = str(tmp_path / "st")
    docs = {"a.txt": "alpha", "b.txt": "beta"}
    IX.write_state(IX.refresh(IX.empty_state(spark), snapshot(spark, docs, {p: 1 for p in docs}))[0], base)
    docs2 = {"a.txt": "alpha gamma", "c.txt": "delta"}
    new, _ = IX.refresh(IX.read_state(spark, base), snapshot(spark, docs2, {p: 2 for p in docs2}))
    IX.write_state(new, base)
    back = IX.read_state(spark, base)
    assert tables(back.index) == tables(bm25.build_index(snapshot(spark, docs2, {p: 2 for p in docs2})))
    assert IX.drop_old_versions(spark, base) == 1
    assert sorted(r.path for r in IX.read_state(spark, base).manifest.collect()) == ["a.txt", "c.txt"]


def test_unchanged_refresh_reads_no_text(spark, tmp_path):
    path = str(tmp_path / "corpus")
    snapshot(spark, {"a.txt": "alpha", "b.txt": "!!!"}, {"a.txt": 1, "b.txt": 1}).write.parquet(path)
    corpus = spark.read.parquet(path)
    state, first = IX.refresh(IX.empty_state(spark), corpus)
    assert {r.path: r.indexed for r in state.manifest.collect()} == {"a.txt": True, "b.txt": False}
    again, changes = IX.refresh(state, corpus)
    assert changes.filter("status <> 'unchanged'").count() == 0 and again.index is state.index
    assert "text" not in again.manifest._jdf.queryExecution().executedPlan().toString()


def test_token_pattern_takes_effect(spark):
    corpus = snapshot(spark, {"a.txt": "foo-bar", "b.txt": "foo"}, {"a.txt": 1, "b.txt": 1})
    state, _ = IX.refresh(IX.empty_state(spark), corpus, IX.default_config(token_pattern="[a-z-]+"))
    assert sorted(r.term for r in state.index.postings.collect()) == ["foo", "foo-bar"]


def test_other_failures_are_not_an_empty_state(spark):
    import pytest
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        IX.read_state(spark, "nosuchscheme://x/state")


def test_config_change_invalidates(spark):
    s1 = snapshot(spark, {"a.txt": "alpha"}, {"a.txt": 1})
    state, _ = IX.refresh(IX.empty_state(spark), s1)
    cfg = IX.default_config(max_file_bytes=100)
    _, ch = IX.refresh(state, s1, config=cfg)
    assert [r.status for r in ch.collect()] == ["added"]


def test_a_lost_bucket_of_a_stored_index_is_repaired(spark):
    """Postings are looked at themselves, not the list of documents."""
    import os
    import shutil

    from quarry.session import scratch_path
    docs = {f"f{i:02d}.txt": " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 6 + 1)) for i in range(20)}
    corpus = snapshot(spark, docs, dict.fromkeys(docs, 1))
    base = scratch_path(spark, "state").replace("file:", "")
    state = IX.write_state(IX.refresh(IX.empty_state(spark), corpus)[0], base)
    folder = f"{IX.current_version(spark, base)}/index/postings".replace("file:", "")
    lost = sorted(b for b in os.listdir(folder) if b.startswith("bucket="))[0]
    terms = {r["term"] for r in spark.read.parquet(f"{folder}/{lost}").select("term").distinct().collect()}
    shutil.move(f"{folder}/{lost}", f"{base}/lost")
    again, changes = IX.refresh(IX.read_state(spark, base), corpus)
    want = {p: "repaired" if terms & set(t.split()) else "unchanged" for p, t in docs.items()}
    assert "repaired" in want.values() and {r["path"]: r["status"] for r in changes.collect()} == want
    assert tables(again.index) == tables(bm25.build_index(corpus))
    assert state.config == again.config
