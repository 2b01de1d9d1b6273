"""Recoding, scalar expressions, filters and exclusion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as fn
from ..operators import ordering, recode, sample, shape
from . import views as v
from .registry import query, r6, rounded


# -- names, selection, casts -----------------------------------------------------------------


@query("p1_clean_names", """
SELECT event_id AS event_id, user_id AS user_id, event_type AS event_type_2, value AS x1st_value, ts AS event_type
FROM events""")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "events").select(
        F.col("event_id").alias("EventId"), F.col("user_id").alias("User ID"), F.col("ts").alias("Event Type"),
        F.col("event_type").alias("event.type"), F.col("value").alias("1st value"))
    return recode.clean_names(df)


@query("p2_select_columns", """
SELECT o_orderpriority AS priority, o_orderkey, o_totalprice, o_orderdate FROM orders""")
def select_columns(spark: SparkSession, sf: str) -> DataFrame:
    return recode.select_cols(v.table(spark, sf, "orders"), "priority=o_orderpriority", "*key",
                              "o_orderstatus:o_orderdate", "~^o_total", "-o_custkey", "-o_orderstatus")


@query("p3_rename_regex", "SELECT l_orderkey AS id, l_linenumber AS item, l_quantity AS amount_1, l_tax AS amount_2 FROM lineitem")
def rename_regex(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"),
        F.col("l_quantity").alias("raw_1"), F.col("l_tax").alias("raw_2"))
    return recode.rename_re(df, "^raw", "amount")


@query("p4_across", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(TRUNC(l_quantity) AS INTEGER) AS int_l_quantity,
       CAST(TRUNC(l_extendedprice) AS INTEGER) AS int_l_extendedprice
FROM lineitem""")
def across(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    out = recode.across(df, ["l_quantity", "l_extendedprice"], fn.to_int, "int_{col}")
    return recode.select_cols(out, "-l_quantity", "-l_extendedprice")


_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN o_orderpriority
  WHEN 2 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' ' WHEN 3 THEN '' ELSE 'NA' END"""


@query("p5_lenient_casts", f"""
SELECT o_orderkey, CAST(TRUNC(TRY_CAST(TRIM({_TEXT}) AS DOUBLE)) AS INTEGER) AS as_int,
       CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS as_bool,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_ts
FROM orders""")
def lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (F.when(key % 5 == 0, F.col("o_totalprice").cast("string")).when(key % 5 == 1, F.col("o_orderpriority"))
            .when(key % 5 == 2, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).when(key % 5 == 3, "").otherwise("NA"))
    flag = F.when(F.col("o_orderstatus") == "O", "TRUE").when(F.col("o_orderstatus") == "F", "F").otherwise("1")
    when = F.when(key % 2 == 0, F.col("o_orderdate").cast("string")).otherwise("yesterday")
    return v.table(spark, sf, "orders").select(
        "o_orderkey", fn.to_int(text).alias("as_int"), fn.to_bool(flag).alias("as_bool"), fn.to_ts(when).alias("as_ts"))


@query("p6_null_sentinels", """
SELECT event_id, value, NULLIF(NULLIF(event_type, 'error'), 'view') AS event_type, props FROM events""")
def null_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "events").select("event_id", "value", "event_type", "props")
    return recode.null_sentinels(df, ["error", "view"])


# -- recoding --------------------------------------------------------------------------------


@query("p7_case_when", """
SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'strong' WHEN event_type = 'click' THEN 'weak'
                      WHEN NULLIF(value, 0) < 10 THEN 'low' ELSE 'other' END AS kind
FROM events""")
def case_when(spark: SparkSession, sf: str) -> DataFrame:
    click, value = F.col("event_type") == "click", F.col("value")
    kind = fn.case_when((click & (value > 50), "strong"), (click, "weak"), (F.nullif(value, F.lit(0.0)) < 10, "low"),
                        default="other")
    return v.table(spark, sf, "events").select("event_id", kind.alias("kind"))


@query("p8_if_else_na", """
SELECT event_id, CASE WHEN NULLIF(event_type, 'error') IS NULL THEN NULL WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked
FROM events""")
def if_else_na(spark: SparkSession, sf: str) -> DataFrame:
    known = F.nullif(F.col("event_type"), F.lit("error"))
    return v.table(spark, sf, "events").select("event_id", fn.if_else_na(known == "click", 1, 0).alias("clicked"))


@query("p9_fallback", "SELECT event_id, COALESCE(NULLIF(event_type, 'error'), props) AS answer FROM events")
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select(
        "event_id", F.coalesce(F.nullif(F.col("event_type"), F.lit("error")), "props").alias("answer"))


_WORDS = [("building", "construction"), ("Machinery ", "industry"), ("AUTOMOBILE", "industry"), ("building", "construction")]


@query("p10_recode_dictionary", """
WITH m(key, value) AS (VALUES ('building', 'construction'), ('machinery', 'industry'), ('automobile', 'industry')),
noisy AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' || LOWER(c_mktsegment) ELSE c_mktsegment END AS raw FROM customer)
SELECT c_custkey, COALESCE(value, raw) AS kept,
       CASE WHEN raw = 'HOUSEHOLD' THEN 'home' ELSE value END AS nulled
FROM noisy LEFT JOIN m ON LOWER(TRIM(raw)) = key""")
def recode_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    words = shape.literal_table(spark, ["key", "value"], _WORDS)
    seg = F.col("c_mktsegment")
    df = v.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower(seg))).otherwise(seg).alias("raw"))
    kept = recode.recode_dict(df, "raw", words, keep_unmatched=True, out="kept")
    return recode.recode_dict(kept, "raw", words, keep_unmatched=False, out="nulled",
                              overrides=[(F.col("raw") == "HOUSEHOLD", "home")]).drop("raw")


@query("p11_recode_factor", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' END AS level,
       CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS level_ord
FROM orders""")
def recode_factor(spark: SparkSession, sf: str) -> DataFrame:
    levels = {"5-LOW": "Low", "2-HIGH": "High", "1-URGENT": "Urgent"}
    df = recode.recode_factor(v.table(spark, sf, "orders"), "o_orderpriority", levels, "level")
    return df.select("o_orderkey", "level", "level_ord")


@query("p12_replace_values", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN 'seen' ELSE event_type END AS target FROM events""")
def replace_values(spark: SparkSession, sf: str) -> DataFrame:
    return recode.replace_values(v.table(spark, sf, "events"), "event_type", {"click": "pressed", "view": "seen"},
                                 "target").select("event_id", "target")


@query("p13_reverse_score", "WITH" + v.SQL_RATINGS + """
SELECT id, item, y, disruptive, 6 - y AS reversed, CASE WHEN id % 2 = 0 THEN y ELSE 6 - y END AS support FROM ratings""")
def reverse_score(spark: SparkSession, sf: str) -> DataFrame:
    mirrored = fn.reverse_score("y", 1, 5)
    return v.ratings(spark, sf).select("id", "item", "y", "disruptive", mirrored.alias("reversed"),
                                       F.when(F.col("id") % 2 == 0, F.col("y")).otherwise(mirrored).alias("support"))


@query("p14_dummy_code", "WITH" + v.SQL_RESPONSES + """
SELECT id, action, CAST(protesters = 'B' AS INTEGER) AS second, CAST(cause = 'against' AND protesters = 'B' AS INTEGER) AS second_against,
       CAST(participant <> protesters OR cause = 'against' AS INTEGER) AS mixed
FROM dl""")
def dummy_code(spark: SparkSession, sf: str) -> DataFrame:
    second, against = F.col("protesters") == "B", F.col("cause") == "against"
    df = recode.dummy_code(v.long_responses(spark, sf), {
        "second": second, "second_against": against & second, "mixed": (F.col("participant") != F.col("protesters")) | against})
    return df.select("id", "action", "second", "second_against", "mixed")


@query("p15_cell_index", "WITH" + v.SQL_RESPONSES + """
SELECT kk, CAST(DENSE_RANK() OVER (ORDER BY cause DESC, kk DESC) AS INTEGER) AS place, COUNT(*) AS n FROM cells GROUP BY kk, cause""")
def cell_index(spark: SparkSession, sf: str) -> DataFrame:
    cause = v.DESIGN.index("cause")
    shown = sorted(reversed(v.CELLS), key=lambda cell: cell[cause], reverse=True)
    df = recode.cell_index(v.indexed(spark, sf), v.DESIGN, shown, "place")
    return df.groupBy("kk", "place").agg(F.count(F.lit(1)).alias("n"))


@query("p16_dense_index", """
SELECT o_orderkey, DENSE_RANK() OVER (ORDER BY o_custkey) AS jj FROM orders WHERE o_orderstatus <> 'P'""")
def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    return ordering.dense_index(df, "o_custkey", "jj").select("o_orderkey", "jj")


@query("p17_z_score", "WITH" + v.SQL_RATINGS + """
SELECT id, item, disruptive, ROUND((acceptable - AVG(acceptable) OVER ()) / STDDEV_SAMP(acceptable) OVER (), 6) + 0.0 AS z_acceptable,
       ROUND((violent - AVG(violent) OVER ()) / STDDEV_SAMP(violent) OVER (), 6) + 0.0 AS z_violent,
       CASE WHEN COUNT(violent) OVER () = COUNT(*) OVER () THEN violent END AS strict_violent
FROM ratings""")
def z_score(spark: SparkSession, sf: str) -> DataFrame:
    df = recode.z_score(v.ratings(spark, sf), ["acceptable", "violent"], names="z_{col}")
    df = recode.z_score(df, ["violent"], na_rm=False, names="strict_{col}")
    return rounded(df, "z_acceptable", "z_violent").select(
        "id", "item", "disruptive", "z_acceptable", "z_violent", "strict_violent")


@query("p18_pick_by", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN l_tax WHEN 'A' THEN l_discount END AS ide FROM lineitem""")
def pick_by(spark: SparkSession, sf: str) -> DataFrame:
    df = recode.pick_by(v.table(spark, sf, "lineitem"), "l_returnflag", {"R": "l_tax", "A": "l_discount"}, "ide")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "ide")


# -- numbers and text ------------------------------------------------------------------------


@query("p19_inv_logit", """
SELECT event_id, ROUND(1 / (1 + EXP(-(value - 50) / 5)), 6) AS p FROM events""")
def inv_logit(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select("event_id", r6(fn.inv_logit((F.col("value") - 50) / 5)).alias("p"))


@query("p20_fill_null", "WITH" + v.SQL_RATINGS + "SELECT id, item, disruptive, COALESCE(violent, 0) AS violent FROM ratings")
def fill_null(spark: SparkSession, sf: str) -> DataFrame:
    return v.ratings(spark, sf).select("id", "item", "disruptive", "violent").fillna(0, subset=["violent"])


@query("p21_regex", """
SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN REGEXP_EXTRACT(p_name, ' (.*)$', 1) END AS noun,
       REGEXP_REPLACE(p_name, '[aeiou]', '*', 'g') AS masked, REGEXP_MATCHES(p_name, '^(red|blue)') AS primary_colour,
       CASE WHEN REGEXP_MATCHES(p_brand, '#1') THEN REGEXP_EXTRACT(p_brand, '#(1\\d*)', 1) END AS brand_1
FROM part""")
def regex(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").select(
        "p_partkey", fn.extract_na("p_name", "(?<= ).*").alias("noun"),
        F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"), F.col("p_name").rlike("^(red|blue)").alias("primary_colour"),
        fn.extract_na("p_brand", r"#(1\d*)", 1).alias("brand_1"))


@query("p22_letter_case", """
SELECT o_orderkey, UPPER(o_orderpriority[1]) || LOWER(o_orderpriority[2:]) AS sentence,
       LIST_AGGREGATE(LIST_TRANSFORM(STR_SPLIT(LOWER(c_mktsegment || ' ' || o_orderstatus || '-' || SUBSTR(o_orderpriority, 3)), ' '),
         LAMBDA w: LIST_AGGREGATE(LIST_TRANSFORM(STR_SPLIT(w, '-'), LAMBDA u: UPPER(u[1]) || u[2:]), 'string_agg', '-')), 'string_agg', ' ') AS title
FROM orders JOIN customer ON o_custkey = c_custkey""")
def letter_case(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("c_mktsegment", F.lit(" "), "o_orderstatus", F.lit("-"), F.substring("o_orderpriority", 3, 99))
    df = v.table(spark, sf, "orders").join(v.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.select("o_orderkey", fn.sentence_case("o_orderpriority").alias("sentence"), fn.title_case(text).alias("title"))


@query("p23_wrap_text", """
WITH RECURSIVE words AS (
  SELECT conv_id, turn, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '\\s+'), LAMBDA w: w <> '') AS w FROM conversations),
fill AS (
  SELECT conv_id, turn, w, 1 AS i, COALESCE(w[1], '') AS line, '' AS done FROM words
  UNION ALL
  SELECT conv_id, turn, w, i + 1,
         CASE WHEN line = '' THEN w[i + 1] WHEN LENGTH(line) + 1 + LENGTH(w[i + 1]) <= 40 THEN line || ' ' || w[i + 1] ELSE w[i + 1] END,
         CASE WHEN line = '' OR LENGTH(line) + 1 + LENGTH(w[i + 1]) <= 40 THEN done ELSE done || line || CHR(10) END
  FROM fill WHERE i < LEN(w))
SELECT conv_id, turn, MD5(done || line) AS wrapped, LENGTH(done || line) AS n_chars
FROM fill WHERE i = GREATEST(LEN(w), 1)""")
def wrap_text(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = fn.wrap_text("text", 40)
    df = v.table(spark, sf, "conversations").select("conv_id", "turn", wrapped.alias("_w"))
    return df.select("conv_id", "turn", F.md5("_w").alias("wrapped"), F.length("_w").cast("bigint").alias("n_chars"))


@query("p24_format", """
WITH s AS (SELECT o_orderpriority AS level, AVG(o_totalprice) / 100000 AS m, STDDEV_SAMP(o_totalprice) / 1000000 AS s,
                  AVG(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS share, -AVG(o_totalprice) / 1e9 AS tiny
           FROM orders GROUP BY 1)
SELECT level, PRINTF('%.2f', m) AS plain, REPLACE(PRINTF('%.2f', s), '0.', '.') AS bare, PRINTF('%.0f', share * 100) || '%' AS percent,
       '-0.00' AS signed_zero, 'd = ' || PRINTF('%.2f', m) || ', [' || PRINTF('%.2f', m - s) || ', ' || PRINTF('%.2f', m + s) || ']' AS estimate
FROM s""")
def format_text(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    s = v.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("level")).agg(
        (F.avg(price) / 100000).alias("m"), (F.stddev_samp(price) / 1000000).alias("s"),
        F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"), (-F.avg(price) / 1e9).alias("tiny"))
    return s.select("level", fn.fmt_num("m").alias("plain"), fn.fmt_num("s", 2, leading_zero=False).alias("bare"),
                    fn.fmt_pct("share").alias("percent"), fn.fmt_num("tiny").alias("signed_zero"),
                    fn.fmt_estimate(F.col("m"), F.col("m") - F.col("s"), F.col("m") + F.col("s")).alias("estimate"))


@query("p25_round_even", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN (l_quantity / 2) % 1 = 0.5 THEN 2 * ROUND(l_quantity / 4) ELSE ROUND(l_quantity / 2) END + 0.0 AS half
FROM lineitem""")
def round_even(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 2).alias("half"))
    return recode.across(df, ["half"], lambda c: fn.round_even(c, 0))


@query("p26_j6_crossing_grid", """
WITH g AS (SELECT ROUND(CAST(-2.5 + i * 0.1 AS DOUBLE), 6) + 0.0 AS x FROM range(0, 51) t(i))
SELECT c_mktsegment, x, w FROM (SELECT DISTINCT c_mktsegment FROM customer), g, (VALUES (0), (1)) v(w)""")
def crossing_grid(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "customer").select("c_mktsegment")
    return rounded(shape.crossing(df, x=shape.seq(-2.5, 2.5, 0.1), w=[0, 1, 1, 0]), "x")


@query("p27_row_id", """
SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS run, o_orderkey, o_orderdate FROM orders""")
def row_id(spark: SparkSession, sf: str) -> DataFrame:
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordering.row_id(df, ["o_orderdate", "o_orderkey"], "run")


@query("p28_normal_breaks", """
WITH z AS (SELECT (c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_SAMP(c_acctbal) OVER () AS z FROM customer)
SELECT b.p, b.q, COUNT(*) FILTER (z <= b.q) AS n
FROM z, (VALUES (0.005::DOUBLE, -2.575829::DOUBLE), (0.1, -1.281552), (0.5, 0.0), (0.9, 1.281552), (0.995, 2.575829)) b(p, q)
GROUP BY 1, 2""")
def normal_breaks(spark: SparkSession, sf: str) -> DataFrame:
    z = recode.z_score(v.table(spark, sf, "customer").select("c_acctbal"), ["c_acctbal"])
    breaks = [(p, round(q, 6) + 0.0) for p, q in fn.normal_breaks()]
    cells = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.count_if(F.col("c_acctbal") <= q).alias("n")) for p, q in breaks]
    return z.agg(F.array(*cells).alias("a")).select(F.inline("a"))


# -- filters and sample rules ----------------------------------------------------------------


@query("f1_f2_f3_filters", "WITH" + v.SQL_RATINGS + """
SELECT id, item, y, violent, disruptive FROM ratings WHERE violent > 0.02 AND y IN (1, 3, 5) AND violent IS NOT NULL""")
def filters(spark: SparkSession, sf: str) -> DataFrame:
    df = v.ratings(spark, sf).filter(F.col("y").isin(1, 3, 5) & (F.col("violent") > 0.02))
    return shape.drop_missing(df.select("id", "item", "y", "violent", "disruptive"))


@query("f3_drop_missing_named", "WITH" + v.SQL_RESPONSES + "," + v.SQL_WIDE + """
SELECT id, q12_1, q12_2, q12_3 FROM wide WHERE q12_1 IS NOT NULL AND q12_2 IS NOT NULL""")
def drop_missing_named(spark: SparkSession, sf: str) -> DataFrame:
    return shape.drop_missing(v.wide(spark, sf).select("id", "q12_1", "q12_2", "q12_3"), ["q12_1", "q12_2"])


@query("f4_j9_keep_ids", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def keep_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sample.keep_ids(v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ids, ["l_orderkey"])


@query("f5_keep_unique", "WITH" + v.SQL_SUBMISSIONS + """
, hourly AS (SELECT *, COUNT(*) OVER (PARTITION BY id, recorded_date) AS n FROM submissions)
SELECT event_id, id, recorded_date, event_type FROM hourly WHERE n = 1""")
def keep_unique(spark: SparkSession, sf: str) -> DataFrame:
    df = v.submissions(spark, sf).drop("exclude")
    return sample.keep_unique(df, ["id", "recorded_date"])


@query("f6_w4_first_submission", "WITH" + v.SQL_SUBMISSIONS + """
, r AS (SELECT *, RANK() OVER (PARTITION BY id ORDER BY recorded_date NULLS LAST) AS r FROM submissions)
SELECT event_id, id, recorded_date FROM r WHERE r = 1""")
def first_submission(spark: SparkSession, sf: str) -> DataFrame:
    df = v.submissions(spark, sf).select("event_id", "id", "recorded_date")
    return sample.first_by(df, ["id"], ["recorded_date"])


@query("f6_first_included_submission", "WITH" + v.SQL_SUBMISSIONS + """
, r AS (SELECT *, RANK() OVER (PARTITION BY id ORDER BY exclude, recorded_date NULLS LAST) AS r FROM submissions)
SELECT event_id, id, exclude, recorded_date FROM r WHERE r = 1""")
def first_included_submission(spark: SparkSession, sf: str) -> DataFrame:
    df = v.submissions(spark, sf).select("event_id", "id", "exclude", "recorded_date")
    return sample.first_by(df, ["id"], ["exclude", "recorded_date"])


@query("f7_screening", """
SELECT c_custkey, NOT COALESCE(
         COALESCE(c_acctbal >= 1000 AND NULLIF(c_mktsegment, 'FURNITURE') <> 'HOUSEHOLD', FALSE)
         AND ((c_nationkey < 12 AND c_mktsegment = 'BUILDING') OR (c_nationkey >= 12 AND c_mktsegment <> 'BUILDING')), FALSE) AS exclude
FROM customer""")
def screening(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE"))
    general = (F.col("c_acctbal") >= 1000) & (seg != "HOUSEHOLD")
    low = F.col("c_nationkey") < 12
    df = sample.screen(v.table(spark, sf, "customer"), [(general, low & (seg == "BUILDING")), (general, ~low & (seg != "BUILDING"))])
    return df.select("c_custkey", "exclude")


_WRONG = [("even", "error"), ("even", "view"), ("odd", "view"), ("odd", "view"), ("odd", "click "), ("even", "Purchase")]


@query("f8_exclude_by_answer", """
WITH r(condition, answer) AS (SELECT DISTINCT * FROM (VALUES ('even', 'error'), ('even', 'view'), ('odd', 'view'), ('odd', 'click '), ('even', 'Purchase'))),
a AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS condition,
             CASE WHEN value < 5 THEN NULL WHEN value < 8 THEN '' ELSE event_type END AS answer FROM events)
SELECT event_id, a.answer IS NULL OR a.answer = '' OR r.answer IS NOT NULL AS exclude,
       a.answer IS NULL OR a.answer = '' OR (a.condition = 'even' AND a.answer IN ('error', 'view')) OR (a.condition = 'odd' AND a.answer IN ('view', 'click')) AS exclude_trimmed
FROM a LEFT JOIN r ON a.condition = r.condition AND a.answer = r.answer""")
def exclude_by_answer(spark: SparkSession, sf: str) -> DataFrame:
    rules = shape.literal_table(spark, ["condition", "answer"], _WRONG)
    value = F.col("value")
    df = v.table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("cond"),
        F.when(value < 5, None).when(value < 8, "").otherwise(F.col("event_type")).alias("said"))
    df = sample.exclude_by_answer(df, rules, "cond", "said")
    df = sample.exclude_by_answer(df, rules, "cond", "said", "exclude_trimmed", trim=True)
    return df.select("event_id", "exclude", "exclude_trimmed")


@query("f8_exclude_by_checks", """
SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(NOT (l_quantity > 5) OR NOT (NULLIF(l_tax, 0) < 0.07)
       OR NOT ((l_returnflag = 'R' AND l_discount > 0.01) OR (l_returnflag <> 'R' AND l_discount > 0.02)), TRUE) AS exclude
FROM lineitem""")
def exclude_by_checks(spark: SparkSession, sf: str) -> DataFrame:
    r, d = F.col("l_returnflag") == "R", F.col("l_discount")
    checks = [F.col("l_quantity") > 5, F.nullif(F.col("l_tax"), F.lit(0.0)) < 0.07, (r & (d > 0.01)) | (~r & (d > 0.02))]
    df = sample.exclude_by_checks(v.table(spark, sf, "lineitem"), checks)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "exclude")


@query("f9_f10_exclusions", "WITH" + v.SQL_RESPONSES + """
SELECT 'included' AS sample, action, COUNT(*) AS n, CAST(SUM(response) AS BIGINT) AS endorsed FROM dl WHERE NOT exclude GROUP BY 2
UNION ALL SELECT 'everybody', action, COUNT(*), CAST(SUM(response) AS BIGINT) FROM dl GROUP BY 2""")
def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    flagged = sample.attach_flag(v.responses(spark, sf), v.people(spark, sf))
    parts = {name: sample.apply_exclusions(flagged, on).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response").alias("endorsed"))
        for name, on in (("included", True), ("everybody", False))}
    return shape.bind_rows(parts, "sample")
