"""Reshaping, star joins, encodings, fills, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import prepare
from .base import r, sql_r, table

_WIDE = "SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS d_1, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS d_2, sum(l_quantity) FILTER (WHERE l_linenumber = 3) AS d_3 FROM lineitem GROUP BY l_suppkey"


@register("unpivot_panel", f"SELECT l_suppkey, d, demand FROM (UNPIVOT ({_WIDE}) ON d_1, d_2, d_3 INTO NAME d VALUE demand)")
def unpivot_panel(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"d_{k}") for k in (1, 2, 3)])
    return prepare.melt(wide, ["l_suppkey"], ["d_1", "d_2", "d_3"], "d", "demand").where("demand IS NOT NULL")


@register(
    "star_panel",
    "SELECT n_name, r_name, o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
def star_panel(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    joined = prepare.star(t("lineitem").select("l_orderkey", "l_quantity"), [(orders, ["l_orderkey"], "inner"), (t("customer").select("c_custkey", "c_nationkey"), ["c_custkey"], "left"), (nation, ["c_nationkey"], "left"), (t("region").select("r_regionkey", "r_name"), ["r_regionkey"], "left")])
    return joined.groupBy("n_name", "r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("demand_panel", "SELECT l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 2) AS demand, " + sql_r('avg(l_extendedprice / l_quantity)', 6) + " AS price FROM lineitem GROUP BY ALL")
def demand_panel(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity"), 2).alias("demand"), r(F.avg(F.try_divide("l_extendedprice", "l_quantity")), 6).alias("price"))


_DAILY = "SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS demand FROM lineitem GROUP BY ALL"


@register("demand_lags", f"WITH d AS ({_DAILY}) SELECT l_returnflag, day, round(lag(demand, 7) OVER w, 2) AS lag_7, round(lag(demand, 28) OVER w, 2) AS lag_28, {', '.join(f'{sql_r(f'CASE WHEN count(demand) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg(demand) OVER (PARTITION BY l_returnflag ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END')} AS mean_{n}' for n in (7, 28))} FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY day)")
def demand_lags(spark, sf_dir):
    from ..functions.windows import past_mean

    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("demand"))
    w = Window.partitionBy("l_returnflag").orderBy("day")
    return d.select("l_returnflag", "day", *[F.round(F.lag("demand", n).over(w), 2).alias(f"lag_{n}") for n in (7, 28)], *[r(past_mean(F.col("demand"), w, n)).alias(f"mean_{n}") for n in (7, 28)])


@register("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def date_parts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *prepare.date_parts("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))


@register("state_case", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_nationkey WHEN 'MACHINERY' THEN c_custkey ELSE 0 END AS snap FROM customer")
def state_case(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("long"))
    return c.select("c_custkey", prepare.by_state("c_mktsegment", {"BUILDING": "nation", "MACHINERY": "c_custkey"}).cast("long").alias("snap"))


@register("target_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice - 100000 > 0")
def target_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 100000).alias("y"))
    return prepare.positive_target(o, "y").select("o_orderkey")


_ENC = "WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 10 AND p_brand <> 'Brand#7'))"


def _codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part, prepare.vocabulary(part.where("p_size <= 10 AND p_brand <> 'Brand#7'"), "p_brand")


@register("ordinal_encode", f"{_ENC} SELECT p_partkey, code AS p_brand_code FROM part LEFT JOIN v USING (p_brand)")
def ordinal_encode(spark, sf_dir):
    part, codes = _codes(spark, sf_dir)
    return prepare.encoded(part, "p_brand", codes).select("p_partkey", "p_brand_code")


@register("unseen_values", f"{_ENC} SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM v) GROUP BY p_brand")
def unseen_values(spark, sf_dir):
    part, codes = _codes(spark, sf_dir)
    return prepare.unseen(part, "p_brand", codes)


@register("prune_columns", "SELECT unnest(['constant', 'mostly_null']) AS name")
def prune_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(1).alias("constant"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).alias("mostly_null"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("some_null"))
    return spark.createDataFrame([(c,) for c in prepare.pruned_columns(part)], "name string")


@register("median_impute", "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS v FROM part) SELECT p_partkey, " + sql_r('coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x))') + " AS v FROM x")
def median_impute(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("v"))
    return prepare.fill_median(part, ["v"]).select("p_partkey", r("v").alias("v"))


@register("fill_unknown", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'unknown' ELSE p_type END AS p_type FROM part")
def fill_unknown(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, None).when(F.col("p_partkey") % 4 == 1, "  ").otherwise(F.col("p_type")).alias("p_type"))
    return part.select("p_partkey", prepare.fill_unknown("p_type"))


@register("numeric_coerce", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS v FROM part")
def numeric_coerce(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("v"))
    return prepare.coerced(part, ["v"])


@register("decimal_comma", "SELECT p_partkey, p_retailprice AS v FROM part")
def decimal_comma(spark, sf_dir):
    text = F.regexp_replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), r"\.", ",")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("v")).select("p_partkey", prepare.decimal_comma("v"))


@register("drop_incomplete", "SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def drop_incomplete(spark, sf_dir):
    """Null and infinite features alike drop their rows."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") * 1.0).alias("a"), F.when(F.col("p_partkey") % 11 != 0, F.lit(1.0)).otherwise(F.lit(float("inf"))).alias("b"))
    return prepare.complete_rows(part, ["a", "b"]).select("p_partkey")


@register("drop_by_threshold", "SELECT p_partkey FROM part WHERE (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT >= 2")
def drop_by_threshold(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *[F.when(F.col("p_partkey") % k == 0, F.lit(1)).alias(f"f{k}") for k in (2, 3, 5)])
    return prepare.complete_rows(part, ["f2", "f3", "f5"], 2).select("p_partkey")


@register("time_slice", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def time_slice(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return prepare.in_window(table(spark, sf_dir, "events"), "ts", at("2024-01-10"), at("2024-01-12")).select("event_id")


@register("session_close_utc", "SELECT event_id, date_trunc('day', ts) + INTERVAL 21 HOUR AS close_utc FROM events")
def session_close_utc(spark, sf_dir):
    """16:00 in New York in January is 21:00 UTC."""
    local = F.date_trunc("day", "ts") + F.expr("INTERVAL 16 HOURS")
    return table(spark, sf_dir, "events").select("event_id", prepare.utc(local).cast("timestamp_ntz").alias("close_utc"))


def _nations(spark, sf_dir, name: str, prefix: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(f"{prefix}_nationkey").cast("long").alias("nationkey"))


@register("setop_union", "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def setop_union(spark, sf_dir):
    return reduce(DataFrame.unionByName, [_nations(spark, sf_dir, "customer", "c"), _nations(spark, sf_dir, "supplier", "s")])


@register("setop_intersect", "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def setop_intersect(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c").intersect(_nations(spark, sf_dir, "supplier", "s"))


@register("setop_except", "SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer EXCEPT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_nationkey < 20")
def setop_except(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c").subtract(_nations(spark, sf_dir, "supplier", "s").where("nationkey < 20"))


@register("distinct_keys", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer")
def distinct_keys(spark, sf_dir):
    return _nations(spark, sf_dir, "customer", "c").distinct()


@register("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01')")
def semi_join(spark, sf_dir):
    early = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1995-02-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(early, "c_custkey", "left_semi").select("c_custkey")


@register("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@register("common_rows", "SELECT c_custkey AS k, 'customer' AS side, c_name AS name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)")
def common_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("side"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("side"), F.col("s_name").alias("name"))
    left, right = prepare.common_rows(c, s, ["k"])
    return left.unionByName(right)
