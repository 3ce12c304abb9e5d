"""Display-rule queries: latest rule (F1), display objects (G1-G4), mapping flag and coverage (D5, E5),
rule audit (G5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import display
from ...sources import fixtures as fx
from .common import register, with_ctes


# -- display rules (F1, G1-G5, D5, E5) -------------------------------------------

LATEST_RULES_SQL = """lm AS (SELECT symbol, MAX(version) AS version, arg_max(mapping, version) AS mapping FROM fx_mappings GROUP BY symbol)"""


@register("latest_mapping", with_ctes(LATEST_RULES_SQL, "fx_mappings", body="SELECT symbol, version, mapping FROM lm"))
def q_latest_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.latest_mapping(fx.fx_mappings(spark, sf_dir))


def rendered_sql(field: str) -> str:
    r = (f"replace(replace(replace(replace(json_extract_string(mapping, '$.{field}.template'), '{{symbol}}', symbol), "
         f"'{{nft_id}}', CAST(nft_id AS VARCHAR)), '{{rarity}}', json_extract_string(properties, '$.rarity')), "
         f"'{{name}}', json_extract_string(properties, '$.name'))")
    walk = f"json_extract_string(properties, '$.' || split_part(json_extract_string(mapping, '$.{field}.from'), '.', 2))"
    return (f"CASE WHEN mapping IS NULL THEN NULL "
            f"WHEN json_extract_string(mapping, '$.{field}.from') IS NOT NULL THEN {walk} "
            f"WHEN json_extract_string(mapping, '$.{field}.template') IS NOT NULL THEN "
            f"CASE WHEN regexp_matches({r}, '[{{}}]') THEN NULL ELSE {r} END END")


_DISPLAY_SQL = f"""{LATEST_RULES_SQL},
d AS (SELECT h.symbol, h.nft_id, h.account, h.properties, c.name AS cname, lm.mapping
      FROM fx_holdings h LEFT JOIN lm ON h.symbol = lm.symbol LEFT JOIN fx_collections c ON h.symbol = c.symbol)"""


@register("display_object", with_ctes(_DISPLAY_SQL, "fx_mappings", "fx_holdings", "fx_collections", body=f"""
SELECT symbol, nft_id, account, mapping IS NOT NULL AS has_display,
       {rendered_sql('name')} AS display_name,
       {rendered_sql('image')} AS display_image,
       CASE WHEN mapping IS NOT NULL THEN COALESCE(NULLIF(cname, ''), symbol) END AS display_collection,
       CASE WHEN mapping IS NOT NULL THEN '{{' || array_to_string(list_transform(
              COALESCE(json_extract_string(mapping, '$.attributes[*]'), []),
              lambda k: '"' || k || '":' || COALESCE('"' || json_extract_string(properties, '$."' || k || '"') || '"', 'null')),
            ',') || '}}' END AS display_attributes
FROM d"""))
def q_display_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = display.compile_rules(fx.fx_mappings(spark, sf_dir))
    h = fx.fx_holdings(spark, sf_dir).select("symbol", "nft_id", "account", "properties")
    out = display.display_object(h, rules, fx.fx_collections(spark, sf_dir))
    return display.flat_display(out).drop("properties", "collection_name")


@register("has_mapping", fx.with_fixtures("""
SELECT symbol, true AS has_display_mapping
FROM (SELECT symbol FROM fx_collections INTERSECT ALL SELECT DISTINCT symbol FROM fx_mappings)
UNION ALL
SELECT symbol, false FROM (SELECT symbol FROM fx_collections EXCEPT ALL SELECT DISTINCT symbol FROM fx_mappings)""",
                                          "fx_collections", "fx_mappings"))
def q_has_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.fx_collections(spark, sf_dir).select("symbol")
    return display.has_mapping(c, fx.fx_mappings(spark, sf_dir))


@register("mapping_coverage", fx.with_fixtures("""
, held AS (SELECT symbol FROM fx_holdings UNION SELECT symbol FROM fx_holdings),
ruled AS (SELECT symbol FROM held INTERSECT SELECT symbol FROM fx_mappings)
SELECT (SELECT count(*) FROM ruled) AS mapped, (SELECT count(*) FROM held) AS total""", "fx_holdings", "fx_mappings"))
def q_mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.mapping_coverage(fx.fx_holdings(spark, sf_dir), fx.fx_mappings(spark, sf_dir))


@register("rule_audit", with_ctes(LATEST_RULES_SQL + """,
refs AS (
  SELECT symbol, unnest(list_distinct(list_concat(
           COALESCE(json_extract_string(mapping, '$.attributes[*]'), []),
           CASE WHEN json_extract_string(mapping, '$.name.from') LIKE 'properties.%'
                THEN [split_part(json_extract_string(mapping, '$.name.from'), '.', 2)] ELSE [] END,
           CASE WHEN json_extract_string(mapping, '$.image.from') LIKE 'properties.%'
                THEN [split_part(json_extract_string(mapping, '$.image.from'), '.', 2)] ELSE [] END,
           list_filter(regexp_extract_all(COALESCE(json_extract_string(mapping, '$.name.template'), ''), '\\{([^{}]*)\\}', 1),
                       lambda k: k NOT IN ('symbol', 'nft_id')),
           list_filter(regexp_extract_all(COALESCE(json_extract_string(mapping, '$.image.template'), ''), '\\{([^{}]*)\\}', 1),
                       lambda k: k NOT IN ('symbol', 'nft_id'))))) AS key
  FROM lm),
seen AS (SELECT DISTINCT symbol, unnest(json_keys(properties)) AS key FROM fx_holdings)""", "fx_mappings", "fx_holdings",
                                body="""
SELECT symbol, 'unused_key' AS issue, key FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.symbol = r.symbol AND s.key = r.key)
UNION ALL
SELECT DISTINCT symbol, 'unmapped', CAST(NULL AS VARCHAR) FROM fx_holdings h
WHERE NOT EXISTS (SELECT 1 FROM lm WHERE lm.symbol = h.symbol)"""))
def q_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = display.compile_rules(fx.fx_mappings(spark, sf_dir))
    return display.rule_audit(rules, fx.fx_holdings(spark, sf_dir))


@register("display_typed", """
SELECT p_partkey AS nft_id,
       '{"name":' || CAST(p_partkey AS VARCHAR) || ',"image":' || CASE WHEN p_partkey % 3 = 0 THEN 'null'
         ELSE '"' || p_brand || '"' END || ',"collection":"T","attributes":{"n":' || CAST(p_partkey AS VARCHAR) ||
       ',"b":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END ||
       ',"o":{"x":"' || p_brand || '"},"z":null,"missing":null}}' AS display
FROM part""")
def q_display_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, booleans, objects and nulls keep their JSON type, and every key is present."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    key, deep = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    props = F.concat(F.lit('{"n":'), key.cast("string"), F.lit(',"b":'), (key % 2 == 0).cast("string"), F.lit(',"o":'),
                     F.to_json(F.struct(F.col("p_brand").alias("x"))), F.lit(',"d":{"e":'),
                     F.coalesce(F.concat(F.lit('"'), deep, F.lit('"')), F.lit("null")), F.lit('},"z":null}'))
    rule = ('{"name":{"from":"properties.n"},"image":{"from":"properties.d.e"},'
            '"attributes":["n","b","o","z","missing"]}')
    rules = display.compile_rules(p.select(F.lit("T").alias("symbol"), F.lit(1).alias("version"), F.lit(rule).alias("mapping")))
    items = p.select(F.lit("T").alias("symbol"), key.alias("nft_id"), props.alias("properties"))
    return display.display_object(items, rules).select("nft_id", display.display_json().alias("display"))
