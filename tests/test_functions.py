"""Scalar helpers."""

from pyspark.sql import functions as F

from mintlens import functions as fn


def one(spark, expr_col, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr_col.alias("r")).first().r


def test_truthy(spark):
    cases = {"true": True, "false": False, "0": False, "1": True, "2.5": True, "0.0": False, "": False,
             None: False, "yes": True, "null": False}
    for v, want in cases.items():
        assert one(spark, fn.truthy("v"), v) is want, v


def test_strict_id(spark):
    for v, want in {"7": 7, " 8 ": 8, "7.0": None, "x": None, None: None, "-3": -3}.items():
        assert one(spark, fn.strict_id("v"), v) == want, v


def test_decimal_text(spark):
    for v, want in {"7": "7", "7.000": "7", "9.90": "9.9", "0.001": "0.001", "10": "10"}.items():
        assert one(spark, fn.decimal_text(F.col("v").cast("decimal(38,18)")), v) == want, v


def test_grouping_key_canonical(spark):
    assert one(spark, fn.grouping_key("v"), '{"b":"2", "a":"1"}') == '{"a":"1","b":"2"}'
    assert one(spark, fn.grouping_key("v"), None) == "{}"
    assert one(spark, fn.grouping_key("v"), "bad") == "{}"


def test_first_present_and_truthy(spark):
    m = fn.json_map("v")
    assert one(spark, fn.first_present(m, "id", "nftId"), '{"id":null,"nftId":"4"}') is None
    assert one(spark, fn.first_present(m, "id", "nftId"), '{"nftId":"4"}') == "4"
    assert one(spark, fn.first_truthy(m["from"], m["account"]), '{"from":"","account":"a"}') == "a"


def test_block_ts(spark):
    fallback = F.lit("2030-01-01 00:00:00").cast("timestamp")
    assert str(one(spark, fn.block_ts("v", fallback), "2020-03-25T14:42:30")) == "2020-03-25 14:42:30"
    assert str(one(spark, fn.block_ts("v", fallback), "")) == "2030-01-01 00:00:00"


def test_burned_null_propagates(spark):
    df = spark.createDataFrame([(10, 4), (10, None)], "supply bigint, circulating_supply bigint")
    assert [r.b for r in df.select(fn.burned().alias("b")).collect()] == [6, None]


def test_partition_sizing():
    from mintlens.session import scale_conf, suggest_shuffle_partitions
    assert suggest_shuffle_partitions(0) == 8
    assert suggest_shuffle_partitions(100 * 1024 ** 4) == 409600  # 100 TB / 256 MB
    assert scale_conf(10 * 1024 ** 3)["spark.sql.shuffle.partitions"] == "40"


def test_scale_conf_applies_to_a_live_session(spark):
    from mintlens.plans.queries import QUERIES
    from mintlens.session import scale_conf
    conf = scale_conf(3 * 1024 ** 3)
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert QUERIES["market_floor"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
