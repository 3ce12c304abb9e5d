"""Display rules: paths with their JSON types, templates, attributes, versions."""

import json

import pytest

from mintlens.operators import display as D
from mintlens.sources.sinks import to_json_view

ITEM = {"title": "Lantern", "level": 12, "ratio": 1.5, "lit": True, "gone": None, "art": {"full": {"uri": "ar://9"}, "sizes": [1, 2]},
        "empty": {}, "curly": "{symbol}"}


def shown(spark, rule, symbol="LAMP", nft_id=44, item=ITEM, collection=None):
    """The display object as Python sees its JSON; None without a rule."""
    rules = D.compile_rules(spark.createDataFrame([(symbol, 1, json.dumps(rule))] if rule is not None else [],
                                                  "symbol string, version int, mapping string"))
    items = spark.createDataFrame([(symbol, nft_id, json.dumps(item) if isinstance(item, dict) else item, collection)],
                                  "symbol string, nft_id bigint, properties string, collection_name string")
    text = D.display_object(items, rules).select(D.display_json().alias("j")).first().j
    return None if text is None else json.loads(text)


def test_no_rule_no_object(spark):
    assert shown(spark, None) is None


@pytest.mark.parametrize("path,want", [
    ("symbol", "LAMP"), ("nft_id", 44), ("properties", ITEM), ("properties.title", "Lantern"), ("properties.level", 12),
    ("properties.ratio", 1.5), ("properties.lit", True), ("properties.gone", None), ("properties.art.full", {"uri": "ar://9"}),
    ("properties.art.full.uri", "ar://9"), ("properties.art.sizes", [1, 2]), ("properties.empty", {}), ("properties.none", None),
    ("properties.title.x", None), ("properties.art.none.uri", None), ("symbol.x", None), ("elsewhere", None)])
def test_a_path_gives_the_value_itself(spark, path, want):
    assert shown(spark, {"image": {"from": path}}) == {"name": None, "image": want, "collection": "LAMP", "attributes": {}}


@pytest.mark.parametrize("template,want", [
    ("{title} of {symbol}/{nft_id}", "Lantern of LAMP/44"), ("{{{level}}}", "{12}"), ("{lit} {gone} {ratio}", "True None 1.5"),
    ("<{curly}>", "<{symbol}>"), ("plain", "plain"), ("{absent}", None), ("{}", None), ("{3}", None), ("{title", None), ("title}", None)])
def test_templates(spark, template, want):
    assert shown(spark, {"name": {"template": template}})["name"] == want


def test_path_wins_over_template_without_fallback(spark):
    assert shown(spark, {"name": {"from": "properties.none", "template": "{title}"}})["name"] is None


def test_attributes_keep_key_and_type(spark):
    got = shown(spark, {"attributes": ["level", "lit", "gone", "art", "absent", "title"]}, collection="Lamps")
    assert got["attributes"] == {"level": 12, "lit": True, "gone": None, "art": ITEM["art"], "absent": None, "title": "Lantern"}
    assert got["collection"] == "Lamps"


@pytest.mark.parametrize("item", [None, "", "not json", "[1]"])
def test_unusable_properties_count_as_empty(spark, item):
    got = shown(spark, {"name": {"template": "{symbol}"}, "attributes": ["a"]}, item=item)
    assert (got["name"], got["attributes"]) == ("LAMP", {"a": None})


def test_text_columns(spark):
    rules = D.compile_rules(spark.createDataFrame([("LAMP", 1, json.dumps({"name": {"from": "properties.level"}, "image": {"from": "properties.art.full"}}))],
                                                  "symbol string, version int, mapping string"))
    items = spark.createDataFrame([("LAMP", 1, json.dumps(ITEM))], "symbol string, nft_id bigint, properties string")
    r = D.flat_display(D.display_object(items, rules)).first()
    assert (r.display_name, r.display_image) == ("12", '{"uri":"ar://9"}')


def test_highest_version_is_the_latest(spark):
    m = spark.createDataFrame([("A", v, f"rule {v}") for v in (4, 11, 9)] + [("B", 2, "only")], "symbol string, version int, mapping string")
    assert {tuple(r) for r in D.latest_mapping(m).collect()} == {("A", 11, "rule 11"), ("B", 2, "only")}


def test_json_documents_write_nulls(spark):
    df = spark.createDataFrame([("a", None)], "x string, y decimal(10,2)")
    assert json.loads(to_json_view(df).first().json) == {"x": "a", "y": None}
