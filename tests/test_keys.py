"""Escaped, repeated and nested keys against a walk of the value that Python's parser reads (its last of repeated keys counts too)."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mintlens import functions as L
from mintlens.operators import display, parse, views

NAMES = ("account", "to", "from", "counterparty", "issuer")


def walk(value):
    """Every text under an account key, at any depth."""
    todo, found = [value], set()
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            found |= {x for k, x in v.items() if k in NAMES and isinstance(x, str) and x}
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def spelled(rng, text):
    """A JSON string for a text, with some characters escaped that need not be."""
    out = ""
    for c in text:
        plain = json.dumps(c, ensure_ascii=False)[1:-1]
        out += f"\\u{ord(c):04x}" if ord(c) < 0x10000 and rng.random() < 0.2 else plain
    return f'"{out}"'


def random_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["1", "null", "true", "1.50", spelled(rng, rng.choice(["bob", "", "é😀", 'a"b', "c\\", '{"to":"x"}', ',"to":"y"', "to"]))])
    if kind < 0.5:
        return "[" + ",".join(random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))) + "]"
    keys = [rng.choice([*NAMES, "x", 'x"to', "to ", "To", "memo", "{", ","]) for _ in range(rng.randint(0, 5))]
    blank = rng.choice(["", " ", "\n\t"])
    return "{" + ",".join(f"{blank}{spelled(rng, k)}{blank}:{blank}{random_json(rng, depth - 1)}" for k in keys) + "}"


def test_account_walk_on_random_documents(spark):
    rng = random.Random(8)
    docs = [random_json(rng, rng.randint(1, 6)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(docs)), "k long, j string")
    got = {r.k: r.found for r in df.select("k", parse._scan_accounts(F.col("j")).alias("found")).collect()}
    hits = 0
    for k, text in enumerate(docs):
        want = walk(json.loads(text))
        assert {a for a in got[k] if a} == want, text
        hits += len(want)
    assert hits > 800


def test_deep_nesting(spark):
    text = '{"a":[' * 300 + '{"\\u0074o":"bottom"}' + "]}" * 300
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(parse._scan_accounts(F.col("j")).alias("f")).first().f == ["bottom"]


def test_usable_and_unusable_share_one_rule(spark):
    docs = ['{"blockNumber":1,"transactions":[{"payload":{"a":1,"a":2}}]}', '{"blockNumber":2,', "[3]", '{"tag":4}', " ", "",
            '{"blockNumber":5,"blockNumber":6}', '{"blockNumber":"x"}']
    df = spark.createDataFrame([(d,) for d in docs], "value string")
    assert sorted(r.blockNumber for r in parse.usable_blocks(df).collect()) == [1, 6]
    assert sorted((r.raw, r.reason) for r in parse.unusable_documents(df).collect()) == sorted(
        [(docs[1], "not a JSON object"), (docs[2], "not a JSON object"), (docs[3], "no block number"), (docs[7], "no block number")])


def test_last_of_repeated_keys_counts(spark):
    df = spark.createDataFrame([('{"price":1,"x":null,"price":"12345678901234567890.123456789012345678","x":{"b":12345678901234567890}}',)], "j string")
    m = df.select(L.json_map("j").alias("m")).first().m
    assert m == {"price": "12345678901234567890.123456789012345678", "x": '{"b":12345678901234567890}'}


@pytest.mark.parametrize("text,key", [('{"a":1,"a":2}', '{"a":2}'), ('{"\\u0061":{"b":1,"b":3}}', '{"a":{"b":3}}')])
def test_group_with_repeated_keys(spark, text, key):
    assert spark.createDataFrame([(text,)], "g string").select(L.grouping_key("g").alias("k")).first().k == key


def test_paths_through_odd_keys_and_non_objects(spark):
    props = '{"o":{"it\'s":5,"q\\"":{"x":null}},"l":[{"a":1}],"s":"text"}'
    items = spark.createDataFrame([("A", 1, props), ("B", 1, props), ("C", 1, props), ("D", 1, props)], "symbol string, nft_id long, properties string")
    rules = [(s, 1, json.dumps({"name": {"from": f"properties.{p}"}})) for s, p in
             (("A", "o.it's"), ("B", 'o.q".x'), ("C", "l.a"), ("D", "s.t.u"))]
    shown = display.display_object(items, display.compile_rules(spark.createDataFrame(rules, "symbol string, version int, mapping string")))
    got = {r.symbol: r.j for r in shown.select("symbol", F.to_json("display.name").alias("j")).collect()}
    assert got == {"A": "5", "B": "null", "C": None, "D": None}


EVENT = "he_block long, tx_seq int, symbol string, nft_id long, op string, account string, counterparty string, price decimal(38,18), price_symbol string, tx_id string, ts timestamp"


def test_feed_of_events_without_an_actor(spark):
    rows = [(1, 0, "A", 1, "burn", None, "bob", None, None, "t", None), (2, 0, "A", 1, "burn", None, None, None, None, "t", None),
            (3, 0, "A", 1, "burn", "bob", "bob", None, None, "t", None), (4, 0, "A", 1, "burn", "amy", "bob", None, None, "t", None)]
    feeds = views.activity_feeds(spark.createDataFrame(rows, EVENT)).collect()
    assert sorted((r.viewer, r.he_block) for r in feeds) == [("amy", 4), ("bob", 1), ("bob", 3), ("bob", 4)]


def test_repeated_cursors_are_one(spark):
    orders = spark.createDataFrame([("A", k) for k in range(1, 6)], "symbol string, nft_id long")
    cursors = spark.createDataFrame([("A", 1), ("A", 2), ("A", None)], "symbol string, cursor long")
    assert sorted(r.nft_id for r in views.orders_pages(orders, cursors=cursors).collect()) == [3, 4, 5]
    rows = [(k, 0, "A", 1, "burn", "bob", None, None, None, "t", None) for k in range(1, 6)]
    below = spark.createDataFrame([("bob", "4:0"), ("bob", "3:0")], "viewer string, cursor string")
    assert sorted(r.he_block for r in views.activity_feeds(spark.createDataFrame(rows, EVENT), cursors=below).collect()) == [1, 2]
