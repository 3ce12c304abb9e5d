"""apply_holdings (C2 + C3) against a plain-Python model on random inputs."""

import datetime as dt
import random

from mintlens.operators import state

HOLD = "symbol string, nft_id bigint, account string, owned_by string, delegated_to string, properties string, refreshed_at timestamp"
OUT = "account string, symbol string, ok boolean, complete boolean, fetched_at timestamp"
T0 = dt.datetime(2026, 7, 1)


def model(cur, fetched, outcomes):
    # the latest fetch of a scope that succeeded and was complete; later failures take nothing back
    confirmed = {}
    for a, s, ok, complete, t in outcomes:
        if ok and complete is not False:
            confirmed[a, s] = max(confirmed.get((a, s), t), t)
    rows = [(r, 0) for r in cur if (r[2], r[0]) not in confirmed or r[6] > confirmed[r[2], r[0]]]
    rows += [((s, n, a, o, d, p, t or confirmed[a, s]), 1) for s, n, a, o, d, p, t in fetched if (a, s) in confirmed]
    best = {}
    for r, src in rows:
        k = (r[0], r[1])
        rank = (r[6], src, r[2])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, r)
    return sorted(r for _, r in best.values())


def test_apply_holdings_matches_model(spark):
    rng = random.Random(3)
    accounts, symbols = ["a", "b", "c", "d"], ["S", "T", "U"]
    t = lambda h: T0 + dt.timedelta(hours=h)
    for _ in range(4):
        cur = [(rng.choice(symbols), n, rng.choice(accounts), "u", None, "{}", t(rng.randint(0, 5))) for n in range(40)]
        fetched = [(rng.choice(symbols), rng.randint(0, 60), rng.choice(accounts), "u", rng.choice([None, "z"]), "{}",
                    rng.choice([None, t(rng.randint(3, 9))])) for _ in range(30)]
        seen = set()
        fetched = [f for f in fetched if not ((f[0], f[1], f[2]) in seen or seen.add((f[0], f[1], f[2])))]
        outcomes = [(rng.choice(accounts), rng.choice(symbols), rng.random() < 0.7, rng.choice([True, True, False, None]),
                     t(rng.randint(2, 8))) for _ in range(12)]
        got = state.apply_holdings(spark.createDataFrame(cur, HOLD), spark.createDataFrame(fetched, HOLD),
                                   spark.createDataFrame(outcomes, OUT))
        got_rows = sorted(tuple(r) for r in got.select("symbol", "nft_id", "account", "owned_by", "delegated_to",
                                                        "properties", "refreshed_at").collect())
        assert got_rows == model(cur, fetched, outcomes)


def pending_model(touches, outcomes, tracked, as_of, base=60, cap=21600):
    tr = set(tracked)
    last_touch = {}
    for a, s, t in touches:
        if t <= as_of and a in tr:
            last_touch[(a, s)] = max(last_touch.get((a, s), t), t)
    last_ok, fails = {}, {}
    for a, s, ok, t in outcomes:
        if t <= as_of and ok:
            last_ok[(a, s)] = max(last_ok.get((a, s), t), t)
    for a, s, ok, t in outcomes:
        if t <= as_of and not ok and ((a, s) not in last_ok or t > last_ok[(a, s)]):
            n, last = fails.get((a, s), (0, t))
            fails[(a, s)] = (n + 1, max(last, t))
    out = []
    for k in set(last_touch) | set(fails):
        lt, (n, lf) = last_touch.get(k), fails.get(k, (0, None))
        touched = lt is not None and (k not in last_ok or lt > last_ok[k])
        if touched or n > 0:
            queued = max(x for x in (lt, lf) if x is not None)
            nb = lf + dt.timedelta(seconds=min(base * 2 ** (n - 1), cap)) if n > 0 else queued
            out.append((k[0], k[1], queued, n, nb))
    return sorted(out)


def test_pending_scopes_matches_model(spark):
    rng = random.Random(8)
    accounts, symbols = ["a", "b", "c"], ["S", "T", ""]
    t = lambda m: T0 + dt.timedelta(minutes=m)
    for _ in range(4):
        touches = [(rng.choice(accounts + ["zz"]), rng.choice(symbols), t(rng.randint(0, 20))) for _ in range(15)]
        outcomes = [(rng.choice(accounts), rng.choice(symbols), rng.random() < 0.5, t(rng.randint(0, 20))) for _ in range(20)]
        tracked = accounts
        as_of = t(15)
        got = state.pending_scopes(
            spark.createDataFrame(touches, "account string, symbol string, touched_at timestamp"),
            spark.createDataFrame(outcomes, "account string, symbol string, ok boolean, fetched_at timestamp"),
            spark.createDataFrame([(a,) for a in tracked], "account string"), as_of)
        rows = sorted((r.account, r.symbol, r.queued_at, r.attempts, r.not_before) for r in got.collect())
        assert rows == pending_model(touches, outcomes, tracked, as_of)
