"""Stored state: buckets of holdings, late fetches, and open work kept up to date."""

import datetime as dt
import os
import random

import pytest

from mintlens.operators import state
from mintlens.plans import jobs

HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
OUT = "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp"
DAY = [dt.datetime(2026, 3, 1) + dt.timedelta(days=k) for k in range(40)]


def holdings(spark, rows):
    return spark.createDataFrame([(s, n, a, "u", None, "{}", t) for s, n, a, t in rows], HOLD)


def outcomes(spark, rows):
    return spark.createDataFrame([(a, s, ok, True, t) for a, s, ok, t in rows], OUT)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted((r.symbol, r.nft_id, r.account, r.refreshed_at) for r in df.collect())


def test_refresh_rewrites_only_the_buckets_of_its_account(spark, tmp_path):
    path = str(tmp_path / "h")
    old = [("OAK", k, "ann" if k % 10 == 0 else "bea", DAY[0]) for k in range(200)] + [("ELM", k, "ann", DAY[0]) for k in range(5)]
    jobs.write_holdings(holdings(spark, old), path, buckets=32)
    before = files(path)
    fetched = [("OAK", k, "ann", DAY[1]) for k in (10, 20, 1000)]
    touched = jobs.apply_holdings_table(spark, path, holdings(spark, fetched), outcomes(spark, [("ann", "OAK", True, DAY[1]), ("bea", "ELM", False, DAY[1])]), buckets=32)
    want = [r for r in old if r[0] == "ELM" or r[2] == "bea"] + fetched
    assert rows_of(spark.read.parquet(path)) == sorted(want)
    changed = {tuple(f.split(os.sep)[-3:-1]) for f in before ^ files(path)}
    assert changed <= {(f"symbol={s}", f"bucket={b}") for s, b in touched} and 0 < len(touched) <= 21
    assert {s for s, _ in touched} == {"OAK"}


def test_emptied_buckets_are_removed(spark, tmp_path):
    path = str(tmp_path / "h")
    jobs.write_holdings(holdings(spark, [("A b/c", k, "ann", DAY[0]) for k in range(4)] + [("A b/c", 9, "bea", DAY[0])]), path, buckets=16)
    jobs.apply_holdings_table(spark, path, holdings(spark, []), outcomes(spark, [("ann", "A b/c", True, DAY[1])]), buckets=16)
    assert rows_of(spark.read.parquet(path)) == [("A b/c", 9, "bea", DAY[0])] and len(files(path)) == 1


def test_late_fetch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "h")
    jobs.write_holdings(holdings(spark, [("OAK", 1, "ann", DAY[0]), ("OAK", 2, "ann", DAY[0])]), path, buckets=4)
    jobs.apply_holdings_table(spark, path, holdings(spark, [("OAK", 2, "ann", DAY[9])]), outcomes(spark, [("ann", "OAK", True, DAY[9])]), buckets=4)
    after = rows_of(spark.read.parquet(path))
    assert after == [("OAK", 2, "ann", DAY[9])]
    for late in ([], [("OAK", 1, "ann", DAY[5]), ("OAK", 2, "ann", DAY[5]), ("OAK", 3, "ann", DAY[5])]):
        assert jobs.apply_holdings_table(spark, path, holdings(spark, late), outcomes(spark, [("ann", "OAK", True, DAY[5])]), buckets=4) == []
        assert rows_of(spark.read.parquet(path)) == after


def test_late_fetch_without_a_log_keeps_newer_rows(spark):
    cur = holdings(spark, [("OAK", 1, "ann", DAY[10]), ("OAK", 2, "ann", DAY[1]), ("OAK", 3, "ann", None)])
    out = state.apply_holdings(cur, holdings(spark, [("OAK", 1, "ann", DAY[5])]), outcomes(spark, [("ann", "OAK", True, DAY[5])]))
    assert rows_of(out) == [("OAK", 1, "ann", DAY[10])]


def test_late_book_is_ignored(spark, tmp_path):
    path, book = str(tmp_path / "b"), "symbol string, nft_id bigint, price double, pos bigint"
    out = "symbol string, ok boolean, complete boolean, fetched_at timestamp"
    spark.createDataFrame([("OAK", 1, 5.0), ("ELM", 2, 6.0)], "symbol string, nft_id bigint, price double").write.partitionBy("symbol").parquet(path)
    step = lambda rows, s, t: jobs.apply_book_table(spark, path, spark.createDataFrame(rows, book), spark.createDataFrame([(s, True, True, t)], out))
    assert step([("OAK", 7, 1.0, 0)], "OAK", DAY[9]) == ["OAK"]
    assert step([("OAK", 8, 1.0, 0)], "OAK", DAY[3]) == [] and step([], "OAK", DAY[3]) == []
    assert sorted(r.nft_id for r in spark.read.parquet(path).collect()) == [2, 7]
    assert step([], "OAK", DAY[9]) == ["OAK"]       # of the same time: the same fetch again
    assert [r.nft_id for r in spark.read.parquet(path).collect()] == [2]


TOUCH = "account string, symbol string, touched_at timestamp"
TRACK = "account string"


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_state_equals_full_recomputation(spark, tmp_path, seed):
    """Ten updates with rows in any order and equal times; accounts become tracked on the way."""
    rng, path = random.Random(seed), str(tmp_path / "s")
    scopes = [(a, s) for a in ("ann", "bea", "cat", "dan") for s in ("OAK", "ELM", "")]
    touches = [(*rng.choice(scopes), rng.choice(DAY)) for _ in range(60)]
    outs = [(*rng.choice(scopes), rng.random() < 0.4, rng.choice([True, True, None, False]), rng.choice(DAY)) for _ in range(90)]
    sent_t, sent_o = [], []
    for k in range(10):
        new_t, new_o = touches[k::10], outs[k::10]
        sent_t, sent_o = sent_t + new_t, sent_o + new_o
        frames = spark.createDataFrame(new_t, TOUCH), spark.createDataFrame(new_o, OUT)
        for _ in range(2 if k in (3, 9) else 1):
            jobs.update_scope_state(spark, path, *frames, batch=k, buckets=3)
        if k in (0, 3, 6, 9):
            tracked = spark.createDataFrame([(a,) for a in ("ann", "bea", "cat", "dan")[:1 + k // 2]], TRACK)
            want = state.pending_scopes(spark.createDataFrame(sent_t, TOUCH), spark.createDataFrame(sent_o, OUT), tracked, DAY[-1])
            got = state.pending_from_state(*jobs.scope_state(spark, path), tracked)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and want.count() > 0


def test_an_update_reads_the_state_of_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    names = [f"a{k}" for k in range(40)]
    none = spark.createDataFrame([], OUT)
    jobs.update_scope_state(spark, path, spark.createDataFrame([(n, "OAK", DAY[0]) for n in names], TOUCH),
                            spark.createDataFrame([(n, "OAK", False, True, DAY[1]) for n in names], OUT), 0, buckets=16)
    before = files(path)
    hit = jobs.update_scope_state(spark, path, spark.createDataFrame([("a7", "ELM", DAY[2])], TOUCH), none, 1, buckets=16)
    changed = {f.split(os.sep)[-2] for f in before ^ files(path)}
    assert len(hit) == 1 and changed == {f"bucket={hit[0]}"}
    plan = state.pending_from_state(*jobs.scope_state(spark, path), spark.createDataFrame([("a7",)], TRACK))
    assert all(path in f for f in plan.inputFiles())
    assert jobs.update_scope_state(spark, path, spark.createDataFrame([], TOUCH), none, 2) == []


def test_the_rows_of_a_large_bucket_are_written_by_several_tasks(spark, tmp_path):
    path, conf = str(tmp_path / "s"), {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                                       "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    names = spark.range(20_000).selectExpr("'a' || sha2(CAST(id AS string), 256) AS account", "'OAK' AS symbol")
    touches = names.selectExpr("*", "TIMESTAMP '2026-01-01' AS touched_at").repartition(8)
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert jobs.update_scope_state(spark, path, touches, spark.createDataFrame([], OUT), 0, buckets=1) == [0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([f for f in files(path) if "scopes" in f and f.endswith(".parquet")]) > 1
    assert jobs.scope_state(spark, path)[0].distinct().count() == 20_000
