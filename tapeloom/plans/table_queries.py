"""Queries for sources, cleaning, joins, set operations, scalar and user functions (S*, P*, J*, T*, C*, U*)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import bars as B
from tapeloom.operators import book, clean, crosssection, runs, selection, spans, udf
from tapeloom.operators import calendar as C
from tapeloom.plans.bar_queries import day, rnd
from tapeloom.plans.frames import FACTORS, with_frames
from tapeloom.plans.registry import query
from tapeloom.plans.score_queries import advised, graded, rank_ic, REPORT, fl, L
from tapeloom.scale import row_numbers
from tapeloom.session import fresh_path
from tapeloom.sources import readers, sinks, style_factors
from tapeloom.sources.stored import StoredTable
from tapeloom.streaming import bars_stream

D = "CAST(dt AS VARCHAR) AS dt"


# --- S: sources and sinks ------------------------------------------------------------
DAILY_SCHEMA = "inst long, dt date, close double, volume double"


def daily_csv(t) -> str:
    path = fresh_path(t.spark, "daily-csv")
    t.daily().select("inst", "dt", "close", "volume").write.csv(path, header=True)
    return path


@query("s01_csv_scan", with_frames(f"SELECT inst, {D}, close, volume FROM daily", "daily"))
def _(t):
    return readers.read_csv(t.spark, daily_csv(t), DAILY_SCHEMA).select("inst", day(), "close", "volume")


@query("s02_projected_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49")
def _(t):
    return t.read("lineitem").where(F.col("l_quantity") >= 49).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s03_span_file", with_frames("SELECT CAST(inst AS VARCHAR) AS instrument, CAST(min(dt) AS VARCHAR) AS start_date, CAST(max(dt) AS VARCHAR) AS end_date FROM ticks GROUP BY inst", "ticks"))
def _(t):
    path = fresh_path(t.spark, "spans")
    spans.min_max_spans(t.ticks(), ["inst"]).write.csv(path, sep="\t")
    return readers.read_spans(t.spark, path).select("instrument", day("start_date"), day("end_date"))


@query("s04_text_fields", """SELECT p[1] AS a, p[2] AS b, p[3] AS c FROM (SELECT string_split_regex(trim(p_name || ' ' || p_type || ' ' || p_brand), '\\s+') AS p FROM part) WHERE len(p) >= 3""")
def _(t):
    lines = t.read("part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("value"))
    return readers.fields_of_lines(lines, ["a", "b", "c"])


@query("s05_prediction_files", with_frames(
    "SELECT CAST(dt AS VARCHAR) AS datetime, CAST(inst AS VARCHAR) AS instrument, round(score, 8) AS score, seed, CASE WHEN seed = 2 THEN -1 ELSE 0 END AS step FROM scores", "scores"))
def _(t):
    path = fresh_path(t.spark, "pred")
    step = F.when(F.col("seed") != 2, F.lit(0))
    rows = t.scores().select(F.col("dt").alias("datetime"), F.col("inst").alias("instrument"), "score", "seed", step.alias("step"), (F.col("seed") % 2).alias("universe"))
    sinks.write_prediction_files(rows, path, "model_predictions_backday_8_uni", ["universe"])
    return readers.read_predictions(t.spark, path).select("datetime", "instrument", F.round("score", 8).alias("score"), "seed", "step")


@query("s06_file_name_fields", """SELECT c_name, 'b' || c_nationkey AS backday, lower(c_mktsegment) AS universe, CAST(c_custkey AS VARCHAR) AS seed,
 CASE WHEN c_custkey % 2 = 0 THEN '7' END AS step FROM customer""")
def _(t):
    name = F.concat_ws("_", F.lit("model_predictions_backday"), F.concat(F.lit("b"), F.col("c_nationkey")), F.lower("c_mktsegment"),
                       F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "7"))
    return t.read("customer").select("c_name", F.concat(name, F.lit(".csv")).alias("n")).select(
        "c_name", *[c.alias(k) for k, c in readers.name_fields(F.col("n")).items()])


@query("s07_parquet_sink", with_frames(f"SELECT inst, {D}, close FROM daily", "daily"))
def _(t):
    path = fresh_path(t.spark, "sink")
    sinks.write_parquet(t.daily().select("inst", "dt", "close", F.year("dt").alias("year")), path, partition_by=["year"])
    return t.spark.read.parquet(path).select("inst", day(), "close")


@query("s08_csv_sink", with_frames(f"SELECT CAST(inst AS VARCHAR) AS inst, {D}, CAST(round(volume, 3) AS DOUBLE) AS volume FROM daily", "daily"))
def _(t):
    path = fresh_path(t.spark, "csv")
    sinks.write_csv(t.daily().select("inst", "dt", "volume"), path, dates=["dt"])
    return t.spark.read.csv(path, header=True).select("inst", "dt", F.col("volume").cast("double"))


@query("s09_json_report", fl("SELECT final_advice, count(*) AS n, string_agg(factor, ',' ORDER BY factor) AS factors FROM ad GROUP BY final_advice", **REPORT))
def _(t):
    path = fresh_path(t.spark, "json")
    sinks.write_advice_json(advised(t), path)
    back = t.spark.read.schema("final_advice string, n long, factors array<string>").json(path)
    return back.select("final_advice", "n", F.array_join("factors", ",").alias("factors"))


@query("s10_csv_report")
def _(t):
    path = fresh_path(t.spark, "report")
    rep = graded(t)
    sinks.write_report_csv(rep, path, loadings=rep.select("factor", F.col("entropy").alias("PC1")))
    return t.spark.read.csv(f"{path}/report", header=True).select("factor", "eligibility", "quality")


@query("s11_json_maps", """SELECT o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, max(o_totalprice) AS factor_mom,
 max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS pb FROM orders GROUP BY 1, 2""")
def _(t):
    o = t.read("orders").select(F.col("o_custkey").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_totalprice", "o_orderstatus")
    per_day = o.groupBy("c", "d").agg(F.max("o_totalprice").alias("m"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("p"))
    # one answer per customer and year, so that an answer stays short whatever the customer's size
    def entry(c):
        return F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("d", c))))

    maps = per_day.groupBy("c", F.substring("d", 1, 4).alias("y")).agg(entry("m").alias("factor_mom"), entry("p").alias("pb"))
    body = maps.select("c", F.to_json(F.struct(F.lit(1).alias("status"), F.struct("factor_mom", "pb").alias("data"))).alias("body"))
    return readers.date_maps_to_rows(body, "body", ["factor_mom", "pb"], ["c"]).select("c", day("date"), "factor_mom", "pb")


def monthly(t):
    """A fresh stored table in partitions of months."""
    return StoredTable(t.spark, fresh_path(t.spark, "stored"), part=lambda d: F.date_format(d, "yyyy-MM"))


@query("s12_append_new_days", with_frames(f"SELECT inst, {D}, round(close * 2, 6) AS twice FROM daily", "daily"))
def _(t):
    source = t.daily().select("inst", "dt", "close")
    compute = lambda df: df.select("inst", "dt", (F.col("close") * 2).alias("twice"))
    table = monthly(t)
    table.load(source.where(F.col("dt") <= F.lit("1997-06-15").cast("date")), compute, ["twice"])
    table.load(source, compute, ["twice"])
    return table.read().select("inst", day(), rnd("twice"))


@query("s13_schema_drift_rebuild", with_frames(f"SELECT inst, {D}, round(close * 2, 6) AS twice, volume FROM daily", "daily"))
def _(t):
    source = t.daily().select("inst", "dt", "close", "volume")
    table = monthly(t)
    table.load(source, lambda df: df.select("inst", "dt", (F.col("close") * 2).alias("twice")), ["twice"])
    table.load(source, lambda df: df.select("inst", "dt", (F.col("close") * 2).alias("twice"), "volume"), ["twice", "volume"])
    return table.read().select("inst", day(), rnd("twice"), "volume")


@query("s14_write_modes", with_frames("SELECT count(*) AS kept, 0 AS replaced FROM calendar", "calendar"))
def _(t):
    path = fresh_path(t.spark, "mode")
    sinks.write_parquet(t.calendar(), path)
    sinks.write_parquet(t.calendar().limit(0), path)
    kept = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept")).first()[0]
    sinks.write_parquet(t.calendar().limit(0), path, overwrite=True)
    return t.spark.read.parquet(path).agg(F.lit(kept).alias("kept"), F.count(F.lit(1)).alias("replaced"))


@query("s15_truncate_after_day", with_frames(f"SELECT inst, {D}, close FROM daily WHERE dt <= DATE '1999-06-30'", "daily"))
def _(t):
    path = fresh_path(t.spark, "full")
    t.daily().select("inst", "dt", "close").write.parquet(path)
    return sinks.truncate_after(t.spark, path, "1999-06-30", fresh_path(t.spark, "cut")).select("inst", day(), "close")


_LOG_WANT = "SELECT epoch, CAST(round(ic, 6) AS DOUBLE) AS ic, CAST(round(rankicir, 6) AS DOUBLE) AS rankicir FROM epochs"


@query("s16_training_log", with_frames(_LOG_WANT, "epochs"))
def _(t):
    line = F.format_string("Seed %d, Epoch %d, train_loss 0.5, valid ic %.6f, icir %.6f, rankic %.6f, rankicir %.6f.", "seed", "epoch", "ic", "icir", "rankic", "rankicir")
    path = fresh_path(t.spark, "log")
    t.epochs().select(line.alias("value")).write.text(path)
    return readers.read_training_log(t.spark, path).select("epoch", "ic", "rankicir")


@query("s17_latest_day", with_frames(f"SELECT inst, {D}, close FROM daily WHERE dt = (SELECT max(dt) FROM daily)", "daily"))
def _(t):
    # the newest day is found on the raw rows, so only that day is aggregated
    return B.daily_bars(sinks.latest_day(t.ticks()), ["inst", "dt"], ["l_orderkey", "l_partkey", "l_linenumber"], price="p", volume="q", amount="a").select(
        "inst", day(), "close")


# --- P: projection, filter, cleaning -------------------------------------------------
@query("p01_select_rename", "SELECT l_orderkey, l_extendedprice AS amount FROM lineitem")
def _(t):
    return clean.rename(t.read("lineitem").select("l_orderkey", "l_extendedprice"), {"l_extendedprice": "amount"})


@query("p02_safe_double", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) AS v FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return t.read("part").select("p_partkey", clean.safe_double(text).alias("v"))


@query("p03_safe_date", "SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS VARCHAR) AS d FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.read("orders").select("o_orderkey", clean.safe_date(text).alias("d")).select("o_orderkey", day("d"))


@query("p04_drop_null_keys", with_frames(f"SELECT inst, {D}, f_mom, f_gap FROM factors WHERE f_mom IS NOT NULL AND f_gap IS NOT NULL", "factors"))
def _(t):
    return clean.drop_null_keys(t.factors(), ["f_mom", "f_gap"]).select("inst", day(), "f_mom", "f_gap")


@query("p05_default_date", "SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, DATE '1990-01-01') AS VARCHAR) AS d FROM orders")
def _(t):
    d = F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))
    return t.read("orders").select("o_orderkey", clean.default_date(d).alias("d")).select("o_orderkey", day("d"))


@query("p06_inequality_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    return t.read("orders").where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderstatus")


@query("p07_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')")
def _(t):
    return t.read("customer").where(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).select("c_custkey", "c_mktsegment")


@query("p08_positional_slice", "SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn > 100 AND rn <= 250")
def _(t):
    rows = row_numbers(t.read("customer").select("c_custkey", "c_acctbal"), [], "c_acctbal", "c_custkey", "rn", t.big("customer"))
    return rows.where((F.col("rn") > 100) & (F.col("rn") <= 250)).drop("rn")


@query("p09_column_whitelist", with_frames("SELECT inst, f_range, f_ma5, label FROM factors", "factors"))
def _(t):
    return clean.whitelist(t.factors(), ["f_ma5", "f_range", "inst", "unknown"])


@query("p10_advice_columns", fl("""SELECT factor, 0 AS part FROM ad WHERE final_advice = 'KEEP_CORE' UNION ALL
 SELECT g, 1 FROM (SELECT DISTINCT factor AS g FROM factor_long) WHERE g NOT IN (SELECT factor FROM ad WHERE final_advice = 'KEEP_CORE')""", **REPORT))
def _(t):
    gates = t.spark.createDataFrame([(f,) for f in [*FACTORS, FACTORS[0]]], "factor string")
    return clean.advice_columns(advised(t), gates)


@query("p11_non_positive_to_null", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", clean.positive_or_null(F.col("c_acctbal")).alias("v"))


@query("p12_inf_to_null", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(l_discount / l_tax, 6) END AS v FROM lineitem")
def _(t):
    d, x = F.col("l_discount"), F.col("l_tax")
    v = F.when((d == 0) & (x == 0), F.lit(float("nan"))).when(x == 0, F.lit(float("inf"))).otherwise(d / F.nullif(x, F.lit(0.0)))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(clean.positive_or_null(clean.finite(v)), 6).alias("v"))


@query("p13_traded_days", with_frames(f"SELECT inst, {D}, v FROM (SELECT *, CASE WHEN num_trades = 1 THEN 0.0::DOUBLE ELSE volume END AS v, CASE WHEN num_trades = 1 AND inst % 2 = 0 THEN 0.0::DOUBLE ELSE amount END AS m FROM daily) WHERE NOT (v = 0 AND m = 0)", "daily"))
def _(t):
    one = F.col("num_trades") == 1
    rows = t.daily().select("inst", "dt", F.when(one, 0.0).otherwise(F.col("volume")).alias("v"), F.when(one & (F.col("inst") % 2 == 0), 0.0).otherwise(F.col("amount")).alias("m"))
    return clean.traded_only(rows, "v", "m").select("inst", day(), "v")


@query("p14_continuous_contract", """SELECT p_partkey, s, CASE WHEN regexp_matches(s, '[^0-9]88$') THEN 1 ELSE 0 END AS is_continuous
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type || '88' ELSE p_type || p_size END AS s FROM part)""")
def _(t):
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("88"))).otherwise(F.concat(F.col("p_type"), F.col("p_size").cast("string")))
    return t.read("part").select("p_partkey", s.alias("s")).withColumn("is_continuous", clean.is_continuous(F.col("s")).cast("int"))


@query("p15_case_folded_filter", "SELECT p_partkey FROM part WHERE upper(p_name) IN ('SMALL RING', 'RED WIDGET')")
def _(t):
    return t.read("part").where(F.upper("p_name").isin("SMALL RING", "RED WIDGET")).select("p_partkey")


_DEDUP = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn FROM orders) WHERE rn = 1"


@query("p16_dedup_keep_last", _DEDUP.format("DESC"))
def _(t):
    o = t.read("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return clean.dedup(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("p16_dedup_keep_first", _DEDUP.format("ASC"))
def _(t):
    o = t.read("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return clean.dedup(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], keep="first").select("o_custkey", "o_orderkey", "o_totalprice")


@query("p17_full_row_dedup", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def _(t):
    return t.read("lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


SEGS = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}


@query("p18_segments", with_frames("SELECT CASE WHEN dt <= DATE '1998-12-31' THEN 'train' WHEN dt <= DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS segment, count(*) AS n FROM daily GROUP BY 1", "daily"))
def _(t):
    rows = t.ticks().select("inst", "dt").distinct()
    parts = [df.groupBy().agg(F.lit(n).alias("segment"), F.count(F.lit(1)).alias("n")) for n, df in clean.split_segments(rows, SEGS).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p19_full_history", with_frames(f"SELECT inst, {D} FROM keys WHERE inst IN (SELECT inst FROM keys GROUP BY inst HAVING min(dt) <= (SELECT min(dt) FROM keys))", "keys"))
def _(t):
    return clean.full_history(t.ticks().select("inst", "dt").distinct()).select("inst", day())


_SPANS = "SELECT inst, min(dt) AS start_date, max(dt) AS end_date FROM daily GROUP BY inst"


@query("p20_long_members", with_frames("SELECT inst, CAST(start_date AS VARCHAR) AS start_date FROM sp WHERE start_date <= DATE '1995-02-01' AND end_date = (SELECT max(end_date) FROM sp)", "daily", sp=_SPANS))
def _(t):
    return clean.long_members(spans.min_max_spans(t.ticks(), ["inst"]), "1995-02-01").select("inst", day("start_date"))


@query("p21_prediction_cleaning", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS datetime, CAST(o_custkey AS VARCHAR) AS instrument, o_totalprice AS score FROM orders WHERE o_orderkey % 5 <> 0")
def _(t):
    raw = t.read("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("datetime"), F.col("o_custkey").alias("instrument"),
        F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.col("o_totalprice").cast("string")).alias("score"))
    return clean.clean_predictions(raw).select(day("datetime"), "instrument", "score")


@query("p22_required_columns", "SELECT 'missing columns: nothing, there' AS message, count(*) AS n FROM supplier")
def _(t):
    s = t.read("supplier")
    try:
        clean.require_columns(s, ["s_suppkey", "nothing", "there"])
        message = ""
    except ValueError as e:
        message = str(e)
    return clean.require_columns(s, ["s_suppkey"]).agg(F.lit(message).alias("message"), F.count(F.lit(1)).alias("n"))


@query("p23_score_variants", with_frames(f"SELECT inst, {D}, f_mom AS score_plain, CASE WHEN f_gap > 0 THEN f_mom END AS score_gated FROM factors WHERE f_mom IS NOT NULL", "factors"))
def _(t):
    return clean.score_variants(t.factors(), "f_mom", "f_gap").select("inst", day(), "score_plain", "score_gated")


_LIMIT = "CASE WHEN {0} < 300000 THEN 0.095::DOUBLE WHEN {0} < 400000 THEN 0.195 WHEN {0} < 680000 THEN 0.095 WHEN {0} < 800000 THEN 0.195 ELSE 0.295 END"


@query("p24_limit_class", f"SELECT c_custkey, {_LIMIT.format('c_custkey * 977 % 1000000')} AS max_change FROM customer")
def _(t):
    symbol = F.concat(F.lit("SH"), F.lpad((F.col("c_custkey") * 977 % 1000000).cast("string"), 6, "0"))
    return t.read("customer").select("c_custkey", clean.limit_class(F.substring(symbol, 3, 6).cast("int")).alias("max_change"))


@query("p25_code_dictionary", "SELECT s_suppkey, CASE CAST(s_nationkey % 7 * 10 + s_suppkey % 10 AS VARCHAR) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.INDUSTRY_INDEX.items()) + " END AS index_code FROM supplier")
def _(t):
    code = (F.col("s_nationkey") % 7 * 10 + F.col("s_suppkey") % 10).cast("string")
    return t.read("supplier").select("s_suppkey", clean.lookup(code, clean.INDUSTRY_INDEX).alias("index_code"))


@query("p26_drop_column", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return t.read("nation").withColumn("helper", F.lit(1)).drop("helper", "n_regionkey")


@query("p27_flatten_names", with_frames(f"SELECT inst, {D}, f_range, f_vol, label FROM factors", "factors"))
def _(t):
    two = t.factors().select("inst", "dt", F.struct("f_range", "f_vol").alias("feature"), F.struct("label").alias("target"))
    flat = clean.flatten(two)
    return flat.select("inst", day(), "f_range", "f_vol", "label")


# --- J: joins ------------------------------------------------------------------------
@query("j01_left_join", with_frames(f"SELECT seed, s.inst, CAST(s.dt AS VARCHAR) AS dt, round(score, 8) AS score, close FROM scores s LEFT JOIN (SELECT * FROM daily WHERE num_trades > 1) d ON s.inst = d.inst AND s.dt = d.dt", "scores", "daily"))
def _(t):
    prices = t.daily().where(F.col("num_trades") > 1).select("inst", "dt", "close")
    return t.scores().join(prices, ["inst", "dt"], "left").select("seed", "inst", day(), rnd("score", 8), "close")


@query("j02_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j03_symbol_suffix_product", "SELECT n_name || x AS id FROM nation, (SELECT unnest(['88', '888', '99']) AS x)")
def _(t):
    # the suffix list is a literal: an explode per row, not a cross join
    return t.read("nation").select(F.explode(F.array(F.lit("88"), F.lit("888"), F.lit("99"))).alias("x"), "n_name").select(F.concat("n_name", "x").alias("id"))


@query("j04_full_outer_chain", """SELECT coalesce(a.d, b.d, c.d) AS dt, o, f, p FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a
 FULL JOIN (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.d = b.d
 FULL JOIN (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, count(*) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c ON coalesce(a.d, b.d) = c.d""")
def _(t):
    o = t.read("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"), "o_orderstatus")

    def per(status, name):
        return o.where(F.col("o_orderstatus") == status).groupBy("dt").agg(F.count(F.lit(1)).alias(name))

    return per("O", "o").join(per("F", "f"), "dt", "full").join(per("P", "p"), "dt", "full")


@query("j05_right_join", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey")
def _(t):
    big = t.read("orders").where(F.col("o_totalprice") > 300000)
    return big.join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("j06_small_side_join", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    # nation has a fixed 25 rows; supplier grows, so the planner decides on it by size
    s = t.read("supplier").join(F.broadcast(t.read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.read("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_name")


@query("j07_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    held = t.read("orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return t.read("customer").select("c_custkey").join(held, "c_custkey", "left_anti")


@query("j08_left_join_is_null", with_frames(f"SELECT a.inst, CAST(a.dt AS VARCHAR) AS dt FROM daily a LEFT JOIN (SELECT * FROM daily WHERE num_trades > 1) b ON a.inst = b.inst AND a.dt = b.dt WHERE b.inst IS NULL", "daily"))
def _(t):
    d = t.daily().select("inst", "dt", "num_trades")
    return d.join(d.where(F.col("num_trades") > 1).select("inst", "dt"), ["inst", "dt"], "left_anti").select("inst", day())


@query("j09_semi_filter", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag IN ('A', 'R'))")
def _(t):
    sold = t.read("lineitem").where((F.col("l_quantity") == 50) & F.col("l_returnflag").isin("A", "R")).select(F.col("l_suppkey").alias("s_suppkey"))
    return t.read("supplier").select("s_suppkey").join(sold, "s_suppkey", "left_semi")


@query("j11_market_on_every_row", with_frames(f"SELECT d.inst, CAST(d.dt AS VARCHAR) AS dt, round(d.close / i.close, 6) AS rel FROM daily d JOIN index_bars i USING (dt)", "daily", "index_bars"))
def _(t):
    # one row per trade day: broadcast
    market = t.index().select("dt", F.col("close").alias("m"))
    return t.daily().join(F.broadcast(market), "dt").select("inst", day(), F.round(F.col("close") / F.col("m"), 6).alias("rel"))


@query("j12_interval_overlap", with_frames("SELECT inst FROM sp WHERE start_date <= DATE '1995-01-10' AND end_date >= DATE '1995-01-02'", "daily", sp=_SPANS))
def _(t):
    return spans.overlapping(spans.min_max_spans(t.ticks(), ["inst"]), "1995-01-02", "1995-01-10").select("inst")


_WEEKSPANS = """SELECT inst, min(dt) AS start_date, max(dt) AS end_date FROM (SELECT *, idx - row_number() OVER (PARTITION BY inst ORDER BY dt) AS island FROM weeks JOIN
 (SELECT dt, row_number() OVER (ORDER BY dt) AS idx FROM (SELECT DISTINCT dt FROM weeks)) USING (dt)) GROUP BY inst, island"""


@query("j13_universe_membership", with_frames(
    f"SELECT inst, {D} FROM keys k WHERE EXISTS (SELECT 1 FROM sp WHERE sp.inst = k.inst AND k.dt BETWEEN sp.start_date AND sp.end_date)",
    "keys", weeks="SELECT DISTINCT inst, CAST(date_trunc('week', dt) AS DATE) AS dt FROM keys", sp=_WEEKSPANS))
def _(t):
    keys = t.ticks().select("inst", "dt").distinct()
    weeks = keys.select("inst", F.to_date(F.date_trunc("week", "dt")).alias("dt"))
    return spans.inside_spans(keys, spans.unbroken_spans(weeks, ["inst"])).select("inst", day())


@query("j15_next_trade_day", with_frames(f"SELECT {D}, CAST(lead(dt) OVER (ORDER BY dt) AS VARCHAR) AS next_dt FROM calendar", "calendar"))
def _(t):
    return C.next_trade_day(t.calendar()).select(day(), day("next_dt"))


@query("j16_concat_by_key", """SELECT l_suppkey, round(avg(l_quantity), 6) AS q_all, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS q_a, round(avg(l_discount) FILTER (l_tax > 0.04), 6) AS d_tax FROM lineitem GROUP BY l_suppkey""")
def _(t):
    q = F.col("l_quantity")
    return t.read("lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg(q), 6).alias("q_all"), F.round(F.avg(F.when(F.col("l_returnflag") == "A", q)), 6).alias("q_a"),
        F.round(F.avg(F.when(F.col("l_tax") > 0.04, F.col("l_discount"))), 6).alias("d_tax"))


@query("j17_nearest_trade_day", with_frames(
    """SELECT CAST(d AS VARCHAR) AS d, CAST((SELECT min(dt) FROM c2 WHERE dt >= d) AS VARCHAR) AS start_dt, CAST((SELECT max(dt) FROM c2 WHERE dt <= d) AS VARCHAR) AS end_dt
 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""", "calendar", c2="SELECT dt FROM calendar WHERE idx % 7 < 5"))
def _(t):
    cal = t.calendar().where(F.col("idx") % 7 < 5)
    return C.nearest_trade_days(t.read("orders").select(F.to_date("o_orderdate").alias("d")), cal, "d").select(day("d"), day("start_dt"), day("end_dt"))


# --- T: sort, limit, set operations --------------------------------------------------
@query("t01_multi_key_sort", fl("SELECT factor, final_advice, quality, row_number() OVER (ORDER BY final_advice, quality, rankic_ir DESC, factor) AS pos FROM ad", **REPORT))
def _(t):
    # the report has one row per factor
    rep = selection.sorted_report(advised(t))
    w = Window.partitionBy(F.lit(1)).orderBy("final_advice", "quality", F.desc("rankic_ir"), "factor")
    return rep.select("factor", "final_advice", "quality", F.row_number().over(w).cast("long").alias("pos"))


@query("t02_top_n_per_day", with_frames(f"SELECT seed, inst, {D}, rn FROM (SELECT *, row_number() OVER (PARTITION BY seed, dt ORDER BY score DESC, inst) AS rn FROM scores) WHERE rn <= 5", "scores"))
def _(t):
    return book.top_n(t.scores(), 5, ["seed", "dt"]).select("seed", "inst", day(), "rn")


@query("t03_largest_per_group", with_frames('SELECT "Seed", "Step", annual_return FROM (SELECT *, row_number() OVER (PARTITION BY "Seed", "D_model" ORDER BY annual_return DESC, "Step") AS rn FROM runs) WHERE rn <= 2', "runs"))
def _(t):
    return runs.largest_per_group(t.runs(), ["Seed", "D_model"], "annual_return", 2).select("Seed", "Step", "annual_return")


@query("t04_top_slice", with_frames('SELECT "Step", annual_return FROM runs ORDER BY annual_return DESC, "Step" LIMIT 30', "runs"))
def _(t):
    return runs.top_runs(t.runs(), "annual_return", 30).select("Step", "annual_return")


@query("t05_union_all", "SELECT s_name AS name, s_acctbal AS bal, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    s = t.read("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = t.read("customer").select(F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("t06_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def _(t):
    return t.read("supplier").select(F.col("s_nationkey").alias("k")).union(
        t.read("customer").where(F.col("c_acctbal") < 0).select("c_nationkey")).distinct()


_INTER = """SELECT dt, inst, max(score) FILTER (seed = 0) AS seed1_score, max(score) FILTER (seed = 1) AS seed2_score, max(score) FILTER (seed = 2) AS seed3_score, avg(score) AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY seed, dt ORDER BY score DESC, inst) AS rn FROM scores) WHERE rn <= 8 GROUP BY dt, inst HAVING count(*) = 3"""


@query("t07_seed_intersection", with_frames(f"SELECT inst, {D}, round(seed1_score, 8) AS seed1_score, round(seed2_score, 8) AS seed2_score, round(seed3_score, 8) AS seed3_score, round(score, 6) AS score FROM x", "scores", x=_INTER))
def _(t):
    out = book.intersection(t.scores(), [0, 1, 2], 8)
    return out.select("inst", day(), *[rnd(f"seed{i}_score", 8) for i in (1, 2, 3)], rnd("score"))


@query("a60_intersection_stats", with_frames(
    """SELECT count(*) AS total_days, CAST(sum(n) AS BIGINT) AS total_intersections, round(avg(n), 6) AS avg_size, min(n) AS min_size, max(n) AS max_size,
 CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_days FROM (SELECT c.dt, count(inst) AS n FROM calendar c LEFT JOIN x ON x.dt = c.dt GROUP BY c.dt)""", "scores", x=_INTER))
def _(t):
    out = book.intersection_stats(t.calendar(), book.intersection(t.scores(), [0, 1, 2], 8))
    return out.withColumn("avg_size", F.round("avg_size", 6))


@query("t08_split_overlap_removal", with_frames(f"SELECT inst, {D}, CASE WHEN dt <= DATE '1999-03-31' THEN 'train' ELSE 'valid' END AS part FROM keys WHERE dt <= DATE '2000-12-31'", "keys"))
def _(t):
    rows = t.ticks().select("inst", "dt").distinct()
    train = rows.where(F.col("dt") <= F.lit("1999-03-31").cast("date"))
    valid = rows.where(F.col("dt").between(F.lit("1999-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    last = train.agg(F.max("dt")).scalar()
    return train.withColumn("part", F.lit("train")).unionByName(valid.where(F.col("dt") > last).withColumn("part", F.lit("valid"))).select("inst", day(), "part")


@query("t09_difference", "SELECT p_brand AS k FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def _(t):
    p = t.read("part")
    return p.select(F.col("p_brand").alias("k")).distinct().join(p.where(F.col("p_size") > 48).select(F.col("p_brand").alias("k")), "k", "left_anti")


@query("t10_pivot", with_frames(
    "SELECT CAST(dt AS VARCHAR) AS dt, " + ", ".join(f'max(close) FILTER (sector = {i}) AS "Close_{i}", sum(volume) FILTER (sector = {i}) AS "Volume_{i}"' for i in range(5))
    + " FROM daily JOIN industry USING (inst) GROUP BY dt", "daily", "industry"))
def _(t):
    rows = t.daily().join(t.industry(), "inst")
    wide = rows.groupBy("dt").pivot("sector", list(range(5))).agg(F.max("close").alias("Close"), F.sum("volume").alias("Volume"))
    names = [f"{f}_{i}" for f in ("Close", "Volume") for i in range(5)]
    return wide.select(day(), *[F.col(f"{n.split('_')[1]}_{n.split('_')[0]}").alias(n) for n in names])


@query("t11_wide_rank_ic", fl("SELECT CAST(dt AS VARCHAR) AS dt, " + ", ".join(f"round(max(rank_ic) FILTER (factor = '{f}'), 6) AS {f}" for f in FACTORS) + " FROM ic GROUP BY dt", **L))
def _(t):
    return selection.wide_series(rank_ic(t), FACTORS).select(day(), *[rnd(f) for f in FACTORS])


# --- C: scalar functions -------------------------------------------------------------
@query("c01_math", """SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 6) AS a, round(sqrt(abs(c_acctbal)), 6) AS b, sign(c_acctbal) AS c, floor(c_acctbal / 100) AS d,
 round(c_acctbal, 1) AS e, greatest(-100.0, least(100.0, c_acctbal)) AS f, round(pow(c_acctbal / 1000, 2), 6) AS g FROM customer""")
def _(t):
    x = F.col("c_acctbal")
    return t.read("customer").select(
        "c_custkey", F.round(F.ln(F.abs(x) + 1), 6).alias("a"), F.round(F.sqrt(F.abs(x)), 6).alias("b"), F.signum(x).alias("c"), F.floor(x / 100).alias("d"),
        F.round(x, 1).alias("e"), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), x)).alias("f"), F.round(F.pow(x / 1000, F.lit(2)), 6).alias("g"))


@query("c02_guarded_division", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount / (l_tax + 1e-2), 6) AS v, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS w FROM lineitem")
def _(t):
    d, x = F.col("l_discount"), F.col("l_tax")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(d / (x + 1e-2), 6).alias("v"), F.round(F.try_divide(d, x), 6).alias("w"))


@query("c03_strings", """SELECT p_partkey, substr(p_name, 3) AS a, CASE WHEN p_name LIKE '%ring' THEN 1 ELSE 0 END AS b, split_part(p_name, ' ', 1) AS c, upper(p_name) AS d, concat_ws('-', p_brand, p_type) AS e FROM part""")
def _(t):
    n = F.col("p_name")
    return t.read("part").select("p_partkey", n.substr(F.lit(3), F.length(n)).alias("a"), F.endswith(n, F.lit("ring")).cast("int").alias("b"),
                                 F.split(n, " ")[0].alias("c"), F.upper(n).alias("d"), F.concat_ws("-", "p_brand", "p_type").alias("e"))


@query("c04_time_parts", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(CAST(ts AS DATE) + 1 AS VARCHAR) AS next_d, strftime(ts, '%Y%m%d') AS f FROM events""")
def _(t):
    d = F.to_date("ts")
    return t.read("events").select("event_id", F.date_format(d, "yyyy-MM-dd").alias("d"), F.hour("ts").cast("long").alias("h"),
                                   F.date_format(F.date_add(d, 1), "yyyy-MM-dd").alias("next_d"), F.date_format("ts", "yyyyMMdd").alias("f"))


@query("c05_conditional", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS v FROM part")
def _(t):
    s = F.col("p_size")
    return t.read("part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "mid").otherwise("large").alias("v"))


@query("c06_null_default", with_frames(f"SELECT inst, {D}, CASE WHEN f_gap IS NULL THEN 1 ELSE 0 END AS missing, coalesce(f_gap, f_mom, 0) AS v FROM factors", "factors"))
def _(t):
    return t.factors().select("inst", day(), F.col("f_gap").isNull().cast("int").alias("missing"), F.coalesce("f_gap", "f_mom", F.lit(0.0)).alias("v"))


@query("c07_arrays_maps_json", """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS ks,
 count(DISTINCT CASE WHEN user_id < 50 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS low FROM events GROUP BY 1, 2""")
def _(t):
    # k has a hundred values, so the sets are bounded; they merge map-side
    k = F.element_at(F.from_json("props", T.MapType(T.StringType(), T.LongType())), "k")
    sets = t.read("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.collect_set(k).alias("all"), F.collect_set(F.when(F.col("user_id") < 50, k)).alias("some"))
    return sets.select("event_type", day("d"), F.size("all").cast("long").alias("ks"), F.size(F.array_intersect("all", "some")).cast("long").alias("low"))


# --- U: user functions and streaming -------------------------------------------------
@query("u01_grouped_map", with_frames("SELECT CAST(day AS VARCHAR) AS day, inst, round(sqrt(sum(amount * amount)), 4) AS v, count(*) AS n FROM bars GROUP BY day, inst", "bars"))
def _(t):
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"day": [pdf["day"].iloc[0]], "inst": [pdf["inst"].iloc[0]], "s": [float((pdf["amount"] ** 2).sum())], "n": [len(pdf)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"day": [pdf["day"].iloc[0]], "inst": [pdf["inst"].iloc[0]], "v": [float(pdf["s"].sum() ** 0.5)], "n": [int(pdf["n"].sum())]})

    rows = t.bars().select("day", "inst", "datetime", "amount")
    minutes = t.bar_chunk_minutes()
    chunk = B.chunk_of("datetime", minutes) if minutes else None
    out = udf.grouped_map(rows, ["day", "inst"], partial, "day date, inst string, s double, n long", merge, "day date, inst string, v double, n long", chunk)
    return out.select(day("day"), "inst", rnd("v", 4), "n")


@query("u02_batch_scoring", with_frames(
    f"SELECT inst, {D}, round(0.6 * z1 - 0.4 * z2, 6) AS score FROM (SELECT inst, dt, coalesce((f_range - avg(f_range) OVER d) / nullif(stddev_samp(f_range) OVER d, 0), 0) AS z1, coalesce((f_vol - avg(f_vol) OVER d) / nullif(stddev_samp(f_vol) OVER d, 0), 0) AS z2 FROM factors WINDOW d AS (PARTITION BY dt))", "factors"))
def _(t):
    # what depends on the day is done by Spark; the caller's function then works row by row
    rows = crosssection.day_zscore(t.factors(), ["f_range", "f_vol"]).fillna(0.0, ["f_range", "f_vol"])
    return udf.score_rows(rows, lambda x: 0.6 * x["f_range"] - 0.4 * x["f_vol"], ["f_range", "f_vol"]).select("inst", day(), rnd("score"))


@query("u03_row_function", fl("SELECT factor, eligibility, quality, final_advice FROM ad", **REPORT))
def _(t):
    return advised(t).select("factor", "eligibility", "quality", "final_advice")


@query("u04_bars_stream", with_frames(
    """SELECT inst, CAST(day AS VARCHAR) AS day, max(close) FILTER (datetime = t1) AS close, max(high) AS high, sum(volume) AS volume, count(*) AS bars, round(sum((high + low + close) / 3 * volume) / (sum(volume) + 1e-12), 6) AS vwap
 FROM (SELECT *, max(datetime) OVER (PARTITION BY inst, day) AS t1 FROM bars) WHERE day + INTERVAL 1 DAY <= (SELECT max(datetime) - INTERVAL 1 HOUR FROM bars) GROUP BY inst, day""", "bars"))
def _(t):
    raw = bars_stream.stream_files(t.spark, t.sf_dir, t.read("events").schema, "events.parquet")
    bars = raw.select(
        F.col("event_type").alias("inst"), bars_stream.utc_instant(F.col("ts")).alias("datetime"), F.col("value").alias("open"), (F.col("value") + 1).alias("high"),
        F.greatest(F.col("value") - 1, F.lit(0.0)).alias("low"), F.col("value").alias("close"), (F.col("user_id") + 1).cast("double").alias("volume"),
        (F.col("value") * (F.col("user_id") + 1)).alias("amount"))
    out = fresh_path(t.spark, "stream")
    bars_stream.run_to_days(bars_stream.daily_from_stream(bars), out, fresh_path(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).select("inst", day("day"), "close", "high", "volume", "bars", rnd("vwap"))


_SERIES_SQL = {
    "factor_mom": "round(ln(avg(close)), 8)", "factor_std": "round(ln(1 + stddev_pop(close)), 6)", "pb": "min(close)", "turnover": "round(sum(volume), 3)", "crowd": "max(close)"}


@query("f21_style_factor_series", with_frames(
    "SELECT type, code, name, CAST(dt AS VARCHAR) AS dt, " + ", ".join(f"{e} AS {n}" for n, e in _SERIES_SQL.items()) + " FROM (SELECT * FROM daily JOIN industry USING (inst)) x RIGHT JOIN codes ON pos = industry GROUP BY type, code, name, dt",
    "daily", "industry", codes="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{c}', '{n}')" for i, (k, c, n) in enumerate(style_factors.FACTORS)) + ") v(pos, type, code, name)"))
def _(t):
    table = style_factors.factor_table(t.spark)
    made = {"factor_mom": F.round(F.ln(F.avg("close")), 8), "factor_std": F.round(F.ln(1 + F.stddev_pop("close")), 6), "pb": F.min("close"), "turnover": F.round(F.sum("volume"), 3), "crowd": F.max("close")}
    series = t.daily().join(t.industry(), "inst").groupBy("industry", "dt").agg(*[made[n].alias(n) for n in style_factors.SERIES])
    codes = table.select(F.col("pos").alias("industry"), "code")
    return style_factors.with_series(table, series.join(F.broadcast(codes), "industry").drop("industry")).select("type", "code", "name", day(), *style_factors.SERIES)
