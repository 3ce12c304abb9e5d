"""Display mapping (F1, G1-G5): versioned rule rows turn heterogeneous
instance properties into one display object {name, image, collection,
attributes}.

Rules are data. The rule table is tiny (one row per symbol and version), so
all rule parsing happens there once: the latest version per symbol
(``max_by``, a partial aggregate), the ``from`` path split into parts, the
``template`` tokenized into literal / placeholder tokens. The instance side
then needs only an equi-join on symbol (whether to broadcast the rules is left to the planner and AQE, by
their size in bytes) and native expressions: map
look-ups, ``transform`` over the few template tokens, ``array_join``. No
Python runs per row.

Template semantics follow Python ``str.format`` over the flat namespace
(properties overlaid with symbol and nft_id): ``{{``/``}}`` escape, a missing
key, a positional field or an unmatched brace makes the whole value NULL;
values render as Python prints them for strings, numbers, booleans
(``True``) and null (``None``); nested objects render as JSON text
(documented divergence from Python's repr).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_map

# Fixed value: template tokenizer -- escaped braces, one placeholder, a literal
# run, or a stray brace (in that order of preference).
TEMPLATE_TOKEN = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"

TOKEN_T = "struct<lit:string,key:string,bad:boolean>"
RULE_T = f"struct<kind:string,path:array<string>,tokens:array<{TOKEN_T}>>"


def latest_mapping(mappings: DataFrame) -> DataFrame:
    """the highest version per symbol."""
    return (mappings.groupBy("symbol")
            .agg(F.max("version").alias("version"), F.max_by("mapping", "version").alias("mapping")))


def _tokens(template: Column) -> Column:
    toks = F.regexp_extract_all(template, F.lit(TEMPLATE_TOKEN), 0)

    def one(t):
        inner = F.substring(t, 2, F.length(t) - 2)
        is_field = t.startswith("{") & t.endswith("}") & (F.length(t) >= 2) & (t != "{{") & (t != "}}")
        bad = (t == "{") | (t == "}") | (is_field & ((inner == "") | inner.rlike(r"^[0-9]+$")))
        lit = F.when(t == "{{", F.lit("{")).when(t == "}}", F.lit("}")).when(~is_field & ~bad, t)
        return F.struct(lit.alias("lit"), F.when(is_field & ~bad, inner).alias("key"), bad.alias("bad"))
    return F.transform(toks, one)


def _rule(spec: Column) -> Column:
    """One field rule ({"from": path} | {"template": text}) -> RULE_T."""
    r = F.from_json(spec, "map<string,string>")
    has_from = F.coalesce(F.map_contains_key(r, F.lit("from")), F.lit(False))
    has_tpl = F.coalesce(F.map_contains_key(r, F.lit("template")), F.lit(False))
    kind = F.when(has_from, F.lit("from")).when(has_tpl, F.lit("template"))
    return F.struct(kind.alias("kind"), F.split(r["from"], r"\.").alias("path"),
                    F.when(kind == "template", _tokens(r["template"])).alias("tokens")).cast(RULE_T)


def compile_rules(mappings: DataFrame) -> DataFrame:
    """Latest rule per symbol, parsed and tokenized once (small table)."""
    m = json_map(F.col("mapping"))
    return latest_mapping(mappings).select(
        "symbol", "version", _rule(m["name"]).alias("name_rule"), _rule(m["image"]).alias("image_rule"),
        F.array_distinct(F.coalesce(F.from_json(m["attributes"], "array<string>"),
                                    F.array().cast("array<string>"))).alias("attributes"))


def _render_variant(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN", F.when(F.variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(t == "STRING", F.variant_get(v, "$", "string"))
            .otherwise(F.to_json(v)))


def variant_text(v: Column) -> Column:
    """A JSON value as plain text: strings as they are, null as NULL, others as JSON text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).when(
        F.schema_of_variant(v) != "VOID", F.to_json(v))


def _apply_rule(rule: Column, symbol: Column, nft_id: Column, props: Column, props_text: Column) -> Column:
    """G2 (from) and G3 (template) for one rule, as a VARIANT: a path gives the value itself, with its type; a
    template gives text. NULL when there is no rule or the path leads nowhere."""
    path = rule["path"]
    p0, n = path[0], F.size(path)
    # one object after the other, by the key itself: a path text would have to quote keys that hold quotes
    deeper = F.reduce(F.slice(path, 3, F.greatest(n - 2, F.lit(1))), props[path[1]],
                      lambda v, k: F.try_variant_get(v, "$", "map<string,variant>")[k])
    walked = (F.when(n == 1, F.when(p0 == "symbol", symbol.cast("variant")).when(p0 == "nft_id", nft_id.cast("variant"))
                     .when(p0 == "properties", F.try_parse_json(props_text)))
              .when(p0 == "properties", F.when(n == 2, props[path[1]]).otherwise(deeper)))
    toks = rule["tokens"]

    def piece(t):
        k = t["key"]
        return (F.when(k.isNull(), t["lit"]).when(k == "symbol", symbol).when(k == "nft_id", nft_id.cast("string"))
                .otherwise(_render_variant(props[k])))
    missing = F.exists(toks, lambda t: t["bad"] | (t["key"].isNotNull() & ~t["key"].isin("symbol", "nft_id")
                                                    & ~F.map_contains_key(props, t["key"])))
    rendered = F.when(~missing, F.array_join(F.transform(toks, piece), ""))
    return F.when(rule["kind"] == "from", walked).when(rule["kind"] == "template", rendered.cast("variant"))


def display_object(items: DataFrame, rules: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """G1: add a ``display`` struct column to instance rows (symbol, nft_id,
    properties JSON text): NULL when the symbol has no rule, else
    {name, image, collection = collection name or symbol, attributes}. Values keep their JSON type
    (VARIANT); an attribute that the item lacks is NULL, its key is kept."""
    df = items.join(rules.select("symbol", "name_rule", "image_rule", "attributes", F.lit(True).alias("_has_rule")),
                    "symbol", "left")
    if collections is not None and "collection_name" not in items.columns:
        df = df.join(collections.select("symbol", F.col("name").alias("collection_name")), "symbol", "left")
    elif "collection_name" not in df.columns:
        df = df.withColumn("collection_name", F.lit(None).cast("string"))
    # one parse of the properties for all rules; the columns below only look values up
    none = F.create_map().cast("map<string,variant>")
    df = df.withColumn("_text", F.coalesce(F.col("properties"), F.lit("{}"))).withColumn(
        "_props", F.map_concat(none, F.coalesce(F.from_json("_text", "map<string,variant>"), none)))
    sym, nid, props, text = F.col("symbol"), F.col("nft_id"), F.col("_props"), F.col("_text")
    attrs = F.map_from_arrays(F.col("attributes"), F.transform("attributes", lambda k: props[k]))
    disp = F.struct(_apply_rule(F.col("name_rule"), sym, nid, props, text).alias("name"),
                    _apply_rule(F.col("image_rule"), sym, nid, props, text).alias("image"),
                    F.coalesce(F.nullif(F.col("collection_name"), F.lit("")), sym).alias("collection"),
                    attrs.alias("attributes"))
    out = df.withColumn("display", F.when(F.col("_has_rule"), disp))
    return out.drop("name_rule", "image_rule", "attributes", "_has_rule", "_text", "_props")


def display_json(display: Column | str = "display") -> Column:
    """The display object as JSON text: every value with its type, every key present."""
    d = F.col(display) if isinstance(display, str) else display
    return F.to_json(d, {"ignoreNullFields": "false"})


def flat_display(df: DataFrame) -> DataFrame:
    """The display struct as flat columns (name and image as text, attributes as typed JSON text)."""
    d = F.col("display")
    return (df.withColumn("has_display", d.isNotNull())
            .withColumn("display_name", variant_text(d["name"])).withColumn("display_image", variant_text(d["image"]))
            .withColumn("display_collection", d["collection"])
            .withColumn("display_attributes", F.to_json(d["attributes"], {"ignoreNullFields": "false"}))
            .drop("display"))


def has_mapping(collections: DataFrame, mappings: DataFrame) -> DataFrame:
    """Flag per collection whether any rule exists for its symbol."""
    m = mappings.select("symbol").distinct().withColumn("_m", F.lit(True))
    return (collections.join(m, "symbol", "left")
            .withColumn("has_display_mapping", F.coalesce(F.col("_m"), F.lit(False))).drop("_m"))


def mapping_coverage(holdings: DataFrame, mappings: DataFrame) -> DataFrame:
    """E5 (D7): held symbols with a rule, out of all held symbols."""
    held = holdings.select("symbol").distinct()
    m = mappings.select("symbol").distinct().withColumn("_m", F.lit(True))
    return (held.join(m, "symbol", "left")
            .agg(F.count_if(F.col("_m").isNotNull()).alias("mapped"), F.count(F.lit(1)).alias("total")))


def rule_audit(rules: DataFrame, holdings: DataFrame) -> DataFrame:
    """Rule keys that never occur in the held items' properties of that
    symbol ('unused_key'), and held symbols without a rule ('unmapped')."""
    def keys_of(rule: Column) -> Column:
        tpl = F.transform(F.filter(F.coalesce(rule["tokens"], F.array().cast(f"array<{TOKEN_T}>")),
                                   lambda t: t["key"].isNotNull() & ~t["key"].isin("symbol", "nft_id")),
                          lambda t: t["key"])
        frm = F.when((rule["kind"] == "from") & (rule["path"][0] == "properties") & (F.size(rule["path"]) >= 2),
                     F.array(rule["path"][1])).otherwise(F.array().cast("array<string>"))
        return F.concat(tpl, frm)
    ref = (rules.select("symbol", F.explode(F.array_distinct(F.concat(
        keys_of(F.col("name_rule")), keys_of(F.col("image_rule")), F.col("attributes")))).alias("key")))
    seen = (holdings.select("symbol", F.explode(F.map_keys(json_map("properties"))).alias("key")).distinct())
    unused = ref.join(seen, ["symbol", "key"], "left_anti").select("symbol", F.lit("unused_key").alias("issue"), "key")
    unmapped = (holdings.select("symbol").distinct().join(rules.select("symbol"), "symbol", "left_anti")
                .select("symbol", F.lit("unmapped").alias("issue"), F.lit(None).cast("string").alias("key")))
    return unused.unionByName(unmapped)
