"""Queries for profiles, joins, splits, evaluation and conformal intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import conformal, evaluate, profile, relate, rules, splits
from kerbside.operators.quantiles import with_quantiles
from kerbside.plans.bindings import JUDGED, LISTINGS, RAW, listings, query, raw_listings, reason_rules, rounded, scored, table
from kerbside.staging import written

L = f"WITH {LISTINGS}"
QUANT = "round(quantile_cont(price, 0.01), 4) AS p01, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95, round(quantile_cont(price, 0.99), 4) AS p99"
METRICS = "count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)) END, 6) AS r2"


def tidy(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "mae", "rmse"), "r2", digits=6)


D_NAMES, D_VALUES = "['n', 'min', 'p01', 'p25', 'p50', 'p75', 'p95', 'p99', 'max']", "[count(price)::DOUBLE, min(price), quantile_cont(price, 0.01), quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.75), quantile_cont(price, 0.95), quantile_cont(price, 0.99), max(price)]"


@query("prf_1_source_profile", f"""{L}, a AS (SELECT *, CASE WHEN mileage > 49000 THEN 'mileage_high' ELSE 'accepted' END AS reason FROM listings), d AS (SELECT source, 'distribution' AS part, unnest({D_NAMES}) AS name, unnest({D_VALUES}) AS value FROM a GROUP BY source),
v AS (SELECT source, 'make' AS c, make AS v, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT source, 'status', status, count(*) FROM a GROUP BY ALL),
r AS (SELECT source, 'accounting' AS part, 'read' AS name, count(*)::DOUBLE AS value FROM a GROUP BY source UNION ALL SELECT source, 'accounting', reason, count(*) FROM a GROUP BY ALL UNION ALL SELECT source, 'mapping', 'make', 100.0::DOUBLE * count(make) / count(*) FROM a GROUP BY source
  UNION ALL SELECT source, 'mapping', 'miles', 100.0::DOUBLE * count(mileage) / count(*) FROM a GROUP BY source UNION ALL SELECT source, 'mapping', 'vin', 0 FROM a GROUP BY source UNION ALL SELECT * FROM d UNION ALL SELECT source, 'distinct', c, count(*) FROM v GROUP BY source, c
  UNION ALL SELECT source, 'top', c || '=' || v, n FROM v QUALIFY row_number() OVER (PARTITION BY source, c ORDER BY n DESC, v) <= 3) SELECT source, part, name, round(value, 4) AS value FROM r""")
def _(spark, sf):
    reason = F.when(F.col("mileage") > 49000, "mileage_high")
    return rounded(profile.source_profile(listings(spark, sf), "source", {"make": "make", "miles": "mileage", "vin": None}, "price", ["make", "status"], reason, 3), "value")


@query("prf_2_distribution", f"{L} SELECT status, count(price) AS n, min(price) AS min, {QUANT}, max(price) AS max FROM listings GROUP BY status")
def _(spark, sf):
    return rounded(profile.distribution(listings(spark, sf), "price", ["status"]), "p01", "p25", "p50", "p75", "p95", "p99")


@query("prf_3_categorical_coverage", f"""{L}, l AS (SELECT 'make' AS dimension, make AS label FROM listings UNION ALL SELECT 'status', status FROM listings), c AS (SELECT dimension, label, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) AS INTEGER) AS rank, CAST(sum(n) OVER (PARTITION BY dimension) AS BIGINT) AS present, count(*) OVER (PARTITION BY dimension) AS distinct_values FROM c) SELECT * FROM r WHERE rank <= 15""")
def _(spark, sf):
    return profile.categorical_coverage(listings(spark, sf), ["make", "status"])


@query("prf_4_numeric_audit", f"""WITH {RAW} SELECT 'year' AS "column", count(*) AS present, count(*) FILTER (k <> 3) AS numeric, count(*) FILTER (k = 3) AS not_numeric, 0 AS missing FROM raw
UNION ALL SELECT 'mileage', count(*) FILTER (mileage <> ''), count(*) FILTER (mileage <> ''), 0, count(*) FILTER (mileage = '') FROM raw""")
def _(spark, sf):
    return profile.numeric_audit(raw_listings(spark, sf), ["year", "mileage"])


@query("prf_5_threshold_flags", f"{L} SELECT count(*) FILTER (price < 2000) AS below_2000, count(*) FILTER (price > 75000) AS above_75k, count(*) FILTER (mileage > 45000) AS high_mileage FROM listings")
def _(spark, sf):
    return profile.threshold_flags(listings(spark, sf), {"below_2000": F.col("price") < 2000, "above_75k": F.col("price") > 75000, "high_mileage": F.col("mileage") > 45000})


@query("prf_5_top_values", f"{L} SELECT mileage, count(*) AS n FROM listings WHERE mileage IS NOT NULL GROUP BY mileage ORDER BY n DESC, mileage LIMIT 15")
def _(spark, sf):
    return profile.top_values(listings(spark, sf), "mileage", 15)


@query("prf_6_year_coverage", f"{L} SELECT count(DISTINCT year) AS years, count(*) FILTER (year < 1996) AS too_early FROM listings")
def _(spark, sf):
    rows = listings(spark, sf)
    return profile.threshold_flags(rows, {"too_early": F.col("year") < 1996}).join(F.broadcast(rows.agg(F.count_distinct("year").alias("years"))))


@query("prf_7_field_support", f"""{L} SELECT 'make' AS field, 'make' AS source_column, true AS supported, count(make) AS present, 100.0::DOUBLE AS percent_present FROM listings
UNION ALL SELECT 'miles', 'mileage', true, count(mileage), round(100.0::DOUBLE * count(mileage) / count(*), 6) FROM listings UNION ALL SELECT 'vin', NULL, false, 0, 0.0 FROM listings GROUP BY ()""")
def _(spark, sf):
    return profile.field_support(listings(spark, sf), {"make": "make", "miles": "mileage", "vin": None})


@query("prf_8_iqr_outliers", f"""{L}, f AS (SELECT make, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM listings GROUP BY make)
SELECT l.make, count(*) FILTER (price < a - 0.5 * (b - a)) AS below, count(*) FILTER (price > b + 0.5 * (b - a)) AS above FROM listings l JOIN f USING (make) GROUP BY l.make""")
def _(spark, sf):
    return profile.iqr_outliers(listings(spark, sf), "price", "make", 0.5)


@query("prf_9_valid_by_category", f"{L} SELECT make, count(*) AS n, count(*) FILTER (mileage > 0) AS valid, round(100.0::DOUBLE * count(*) FILTER (mileage > 0) / count(*), 6) AS percent_valid FROM listings GROUP BY make")
def _(spark, sf):
    return profile.valid_by(listings(spark, sf), F.coalesce(F.col("mileage") > 0, F.lit(False)), "make")


@query("prf_10_scope_audit", f"""WITH {RAW}, r AS (SELECT CASE WHEN k = 8 THEN ' ' ELSE state END AS state, CASE WHEN k = 9 THEN '1234' WHEN k <> 10 THEN '90210' END AS zip FROM raw)
SELECT count(*) FILTER (trim(state) = '') AS missing, count(*) FILTER (state IN ('CA', 'TX')) AS in_scope, count(*) FILTER (regexp_full_match(state, '[A-Z]{{2}}') AND state NOT IN ('CA', 'TX')) AS out_of_scope, count(*) FILTER (trim(state) <> '' AND NOT regexp_full_match(state, '[A-Z]{{2}}')) AS malformed,
count(DISTINCT state) FILTER (trim(state) <> '') AS regions, count(*) FILTER (zip = '1234') AS zip_malformed, count(*) FILTER (zip IS NULL) AS zip_missing FROM r""")
def _(spark, sf):
    k = F.col("k")
    rows = raw_listings(spark, sf).select(F.when(k == 8, " ").otherwise(F.col("state")).alias("state"), F.when(k == 9, "1234").when(k != 10, "90210").alias("zip"))
    return profile.scope_audit(rows, "state", ["CA", "TX"], "zip")


@query("prf_11_time_audit", f"""{L}, s AS (SELECT year, sold_on AS day, CAST(sold_on + CAST(seller % 4 - 2 AS INTEGER) AS DATE) AS first, CASE WHEN seller % 9 > 0 THEN CAST(sold_on - CAST(seller % 2 AS INTEGER) AS DATE) END AS last FROM listings)
SELECT CAST(min(last) AS VARCHAR) AS first_day, CAST(max(last) AS VARCHAR) AS last_day, count(*) FILTER (last IS NULL) AS invalid, count(*) FILTER (last = day) AS on_file_date, count(*) FILTER (last <> day) AS off_file_date, count(*) FILTER (first > last) AS first_after_last, count(*) FILTER (year(last) < year) AS before_model_year FROM s""")
def _(spark, sf):
    c = F.col
    rows = listings(spark, sf).select(c("year"), c("sold_on").alias("day"), F.date_add("sold_on", (c("seller") % 4 - 2).cast("int")).alias("first"), F.when(c("seller") % 9 > 0, F.date_sub("sold_on", (c("seller") % 2).cast("int"))).alias("last"))
    return profile.time_audit(rows, "first", "last", "day", "year")


@query("prf_12_repeated_composites", f"{L}, e AS (SELECT count(*) AS n FROM listings WHERE mileage IS NOT NULL GROUP BY make, body, mileage, year) SELECT count(*) AS composite_keys, count(*) FILTER (n > 1) AS repeated_composites, CAST(sum(n - 1) AS BIGINT) AS composite_rows_beyond_first FROM e")
def _(spark, sf):
    return profile.repeated_composites(listings(spark, sf), ["make", "body", "mileage", "year"])


@query("prf_12_identity_repetition", f"""{L}, e AS (SELECT private_key, count(*) AS n, count(DISTINCT year(sold_on)) AS s, count(DISTINCT coalesce(CAST(mileage AS VARCHAR), 'none')) AS v FROM listings GROUP BY 1)
SELECT count(*) AS unique_ids, count(*) FILTER (n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS beyond_first, max(n) AS most_rows, count(*) FILTER (s > 1) AS in_several_snapshots, count(*) FILTER (v > 1) AS changed_ids FROM e""")
def _(spark, sf):
    return profile.repetition_audit(listings(spark, sf).withColumn("snapshot", F.year("sold_on")), "private_key", "snapshot", ["mileage"])


@query("prf_13_feature_coverage", f"""{L} SELECT 'mileage' AS feature, count(mileage) AS present, count(DISTINCT mileage) AS distinct_values, min(mileage)::DOUBLE AS min, median(mileage)::DOUBLE AS median, max(mileage)::DOUBLE AS max FROM listings
UNION ALL SELECT 'make', count(make), count(DISTINCT make), NULL, NULL, NULL FROM listings""")
def _(spark, sf):
    return profile.feature_coverage(listings(spark, sf), ["mileage"], ["make"])


@query("prf_13_status_counts", f"{L} SELECT status, count(*) AS n, count(mileage) AS present_mileage, count(make) AS present_make FROM listings GROUP BY status")
def _(spark, sf):
    return profile.status_counts(listings(spark, sf), "status", ["mileage", "make"])


@query("prf_14_compare_sources", f"""{L}, s AS (SELECT source, count(*) AS n, median(price) AS m, round(100.0::DOUBLE * count(mileage) / count(*), 6) AS coverage_mileage FROM listings GROUP BY source), b AS (SELECT m AS bm, coverage_mileage AS bc FROM s WHERE source = 'F')
SELECT source, n, round(m, 4) AS median, coverage_mileage, round(100 * (m - bm) / bm, 6) AS median_shift, round(coverage_mileage - bc, 6) AS points_mileage FROM s, b""")
def _(spark, sf):
    return rounded(rounded(profile.compare_sources(listings(spark, sf), "source", "price", ["mileage"], "F"), "median"), "median_shift", digits=6)


@query("prf_15_composition", f"{L} SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM listings GROUP BY source")
def _(spark, sf):
    return profile.composition(listings(spark, sf), "source")


@query("prf_16_share_drift", f"""{L}, a AS (SELECT make AS label, count(*)::DOUBLE / (SELECT count(*) FROM listings) AS s FROM listings GROUP BY 1), b AS (SELECT make AS label, count(*)::DOUBLE / (SELECT count(*) FROM listings WHERE fold = 0) AS s FROM listings WHERE fold = 0 GROUP BY 1)
SELECT 'make' AS dimension, round(100 * max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS max_points FROM a FULL JOIN b USING (label)""")
def _(spark, sf):
    rows = listings(spark, sf)
    return profile.share_drift(rows, rows.where("fold = 0"), ["make"])


@query("prf_16_median_drift", f"""{L}, m AS (SELECT 'mileage' AS feature, median(mileage)::DOUBLE AS full_median, median(mileage) FILTER (fold = 0)::DOUBLE AS sample_median FROM listings UNION ALL SELECT 'price', median(price)::DOUBLE, median(price) FILTER (fold = 0)::DOUBLE FROM listings)
SELECT *, round(100 * (sample_median - full_median) / full_median, 6) AS percent FROM m""")
def _(spark, sf):
    rows = listings(spark, sf)
    return profile.median_drift(rows, rows.where("fold = 0"), ["mileage", "price"])


@query("prf_17_quarantine_summary", f"WITH {JUDGED} SELECT reason_code, count(*) AS n FROM judged WHERE reason_code IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rules.with_reason(raw_listings(spark, sf), reason_rules()).where("reason_code is not null").groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("jon_1_align_rows", "SELECT o_orderkey AS k, o_totalprice AS price, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    matched, _ = relate.align(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), table(spark, sf, "orders"), "o_custkey")
    return matched.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("c_name").alias("name"))


@query("jon_2_assignment_differences", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE 'different' END AS problem FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lit("train").alias("split"))
    found = o.where("o_orderkey % 10 <> 0").withColumn("split", F.when(F.col("o_orderkey") % 15 == 1, "test").otherwise("train"))
    return relate.assignment_differences(o, found, "o_orderkey", "split")


@query("jon_3_null_safe_collisions", f"{L} SELECT row_id FROM listings a WHERE source = 'O' AND NOT EXISTS (SELECT 1 FROM listings b WHERE b.source = 'F' AND a.year = b.year AND a.make = b.make AND a.mileage IS NOT DISTINCT FROM b.mileage AND a.body = b.body)")
def _(spark, sf):
    rows = listings(spark, sf)
    return relate.anti_collisions(rows.where("source = 'O'"), rows.where("source = 'F'"), ["year", "make", "mileage", "body"]).select("row_id")


@query("jon_4_collision_report", f"""{L}, k AS (SELECT year, make, mileage, bool_or(source = 'F') AS f, bool_or(source = 'O') AS o FROM listings WHERE mileage IS NOT NULL GROUP BY ALL)
SELECT count(*) FILTER (f) AS left_keys, count(*) FILTER (o) AS right_keys, count(*) FILTER (f AND o) AS shared_keys FROM k""")
def _(spark, sf):
    rows = listings(spark, sf)
    return relate.collision_report(rows.where("source = 'F'"), rows.where("source = 'O'"), ["year", "make", "mileage"])


@query("jon_5_coverage_difference", f"""{L}, k AS (SELECT 'model' AS "column", model AS v, bool_or(status = 'New') AS a, bool_or(status = 'Used') AS b FROM listings GROUP BY ALL)
SELECT "column", count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right, count(*) FILTER (a AND b) AS both FROM k WHERE a OR b GROUP BY 1""")
def _(spark, sf):
    rows = listings(spark, sf)
    return relate.coverage_difference(rows.where("status = 'New'"), rows.where("status = 'Used'"), ["model"])


@query("jon_6_overlap_risk", """WITH o AS (SELECT 'p' || p_partkey AS id, unnest(['a' || p_partkey // 4, 'b' || (p_partkey + 2) // 4]) AS f FROM part WHERE p_partkey % 6 <> 0)
SELECT DISTINCT a.id AS left_id, b.id AS right_id, 'confirmed' AS risk FROM o a JOIN o b ON a.f = b.f AND a.id < b.id UNION ALL SELECT 'p' || p_partkey, NULL, 'indeterminate' FROM part WHERE p_partkey % 6 = 0""")
def _(spark, sf):
    k = F.col("p_partkey")
    family = lambda name, x: F.concat(F.lit(name), F.floor(x / 4).cast("long").cast("string"))
    return relate.overlap_risk(table(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("source_id"), F.when(k % 6 != 0, F.array(family("a", k), family("b", k + 2))).alias("families")))


@query("jon_6_overlap_families", """WITH o AS (SELECT 'n' || n_nationkey AS id, r_name AS f FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0 UNION SELECT 's' || s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT 's' || s_suppkey, 'only ' || s_suppkey FROM supplier),
z AS (SELECT f, min(id) AS r, count(*) AS c FROM o GROUP BY 1) SELECT o.id AS source_id, o.f AS family, z.r AS representative, z.c AS members, CASE WHEN z.c > 1 THEN 'confirmed' ELSE 'none' END AS risk FROM o JOIN z USING (f) UNION ALL SELECT 'n' || n_nationkey, NULL, NULL, NULL, 'indeterminate' FROM nation WHERE n_nationkey % 7 = 0""")
def _(spark, sf):
    """Nations and suppliers by region, five families with a fifth of all suppliers each; a supplier is also its own family, and some nations are of unknown provenance."""
    c = F.col
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    nations = places.select(F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.when(c("n_nationkey") % 7 != 0, F.array("r_name")).alias("families"))
    suppliers = table(spark, sf, "supplier").join(places, c("s_nationkey") == c("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.array(c("r_name"), F.concat(F.lit("only "), "s_suppkey")).alias("families"))
    return relate.overlap_families(nations.unionByName(suppliers))


@query("jon_7_combine_sources", f"""{L}, d AS (SELECT DISTINCT year, make, mileage FROM listings WHERE source = 'O'), k AS (SELECT * FROM d WHERE year >= 1996), c AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM listings f WHERE f.source = 'F' AND f.year = k.year AND f.make = k.make AND f.mileage IS NOT DISTINCT FROM k.mileage)),
n AS (SELECT (SELECT count(*) FROM listings WHERE source = 'O') AS a, (SELECT count(*) FROM d) AS b, (SELECT count(*) FROM k) AS c, (SELECT count(*) FROM c) AS d)
SELECT 0 AS step, 'read' AS name, a AS n, 0 AS removed FROM n UNION ALL SELECT 1, 'distinct', b, a - b FROM n UNION ALL SELECT 2, 'filtered', c, b - c FROM n UNION ALL SELECT 3, 'clear', d, c - d FROM n""")
def _(spark, sf):
    rows = listings(spark, sf).select("year", "make", "mileage", "source")
    _, steps = relate.combine_sources(rows.where("source = 'F'"), rows.where("source = 'O'"), ["year", "make", "mileage"], ["year", "make", "mileage"], F.col("year") >= 1996)
    return steps


@query("jon_7_combined_rows", f"""{L}, d AS (SELECT DISTINCT year, make, mileage FROM listings WHERE source = 'O' AND year >= 1996), c AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM listings f WHERE f.source = 'F' AND f.year = d.year AND f.make = d.make AND f.mileage IS NOT DISTINCT FROM d.mileage))
SELECT year, make, mileage, count(*) AS n FROM (SELECT year, make, mileage FROM listings WHERE source = 'F' UNION ALL SELECT * FROM c) GROUP BY ALL""")
def _(spark, sf):
    rows = listings(spark, sf).select("year", "make", "mileage", "source")
    union, _ = relate.combine_sources(rows.where("source = 'F'"), rows.where("source = 'O'"), ["year", "make", "mileage"], ["year", "make", "mileage"], F.col("year") >= 1996)
    return union.groupBy("year", "make", "mileage").agg(F.count(F.lit(1)).alias("n"))


@query("jon_8_group_isolation", f"{L} SELECT private_key FROM listings GROUP BY 1 HAVING min(source) <> max(source)")
def _(spark, sf):
    return relate.mixed_groups(listings(spark, sf), "private_key", "source")


@query("jon_9_fallback_lookup", f"""{L}, t AS (SELECT make, status, count(*) AS n, median(price) AS m FROM listings GROUP BY ALL), s AS (SELECT status, count(*) AS n, median(price) AS m FROM listings GROUP BY ALL)
SELECT row_id, round(CASE WHEN t.n >= 40 THEN t.m ELSE s.m END, 4) AS value, CASE WHEN t.n >= 40 THEN t.n ELSE s.n END AS support, CASE WHEN t.n >= 40 THEN 'make_status' ELSE 'status' END AS method FROM listings l JOIN t USING (make, status) JOIN s USING (status)""")
def _(spark, sf):
    rows = listings(spark, sf)
    keyed = rows.select("price", F.explode(F.array(F.struct(F.lit("make_status").alias("level"), F.concat_ws("|", "make", "status").alias("key")), F.struct(F.lit("status").alias("level"), F.col("status").alias("key")))).alias("x")).select("x.*", "price")
    medians = with_quantiles(keyed.groupBy("level", "key").agg(F.count(F.lit(1)).alias("support")), keyed, {"value": (F.col("price"), 0.5)}, ["level", "key"])
    found = relate.lookup_with_fallback(rows, medians.where("level = 'status' or support >= 40"), [("make_status", ["make", "status"]), ("status", ["status"])], "value", "support")
    return rounded(found.select("row_id", "value", "support", "method"), "value")


def slices(spark, sf, where):
    return tidy(evaluate.slice_diagnostics(scored(spark, sf).where(where), ["make"], 1))


@query("jon_10_slice_changes", f"""{L}, a AS (SELECT make, round(avg(abs(p - y)), 4) AS mae FROM listings WHERE source = 'F' GROUP BY 1), b AS (SELECT make, round(avg(abs(p - y)), 4) AS mae FROM listings WHERE source = 'O' GROUP BY 1)
SELECT 'make' AS dimension, a.make AS label, a.mae AS base, b.mae AS challenger, round((b.mae - a.mae) / a.mae, 6) AS change FROM a JOIN b USING (make) ORDER BY abs(round((b.mae - a.mae) / a.mae, 6)) DESC, a.make LIMIT 10""")
def _(spark, sf):
    return relate.slice_changes(slices(spark, sf, "source = 'F'"), slices(spark, sf, "source = 'O'"), "mae")


@query("jon_11_subset_check", f"{L} SELECT row_id FROM listings WHERE fold IN (0, 1) AND row_id NOT IN (SELECT row_id FROM listings WHERE fold = 0)")
def _(spark, sf):
    rows = listings(spark, sf)
    return relate.not_in(rows.where("fold in (0, 1)"), rows.where("fold = 0"), "row_id")


@query("spl_1_closest_prefix_holdout", f"""{L}, g AS (SELECT status, make, model, count(*) AS n, sha256(concat_ws('|', 'holdout', status, make, model)) AS d FROM listings GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY status ORDER BY d) AS running, row_number() OVER (PARTITION BY status ORDER BY d) AS rank, sum(n) OVER (PARTITION BY status) AS total FROM g),
c AS (SELECT status, abs(running * 5 - total) AS off, rank FROM r UNION ALL SELECT status, max(total), 0 FROM r GROUP BY status), b AS (SELECT status, arg_min(rank, (off, rank)) AS cut FROM c GROUP BY status)
SELECT l.row_id, r.rank <= b.cut AS selected FROM listings l JOIN r USING (status, make, model) JOIN b USING (status)""")
def _(spark, sf):
    return splits.closest_prefix_split(listings(spark, sf), ["make", "model"], "status", 1, 5, "holdout").select("row_id", "selected")


def prefix_sql(seed, num, den):
    return f"""{L}, g AS (SELECT status, make, count(*) AS n, sha256(concat_ws('|', '{seed}', status, make)) AS d FROM listings GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY status ORDER BY d) AS running, row_number() OVER (PARTITION BY status ORDER BY d) AS rank, sum(n) OVER (PARTITION BY status) AS total FROM g),
c AS (SELECT status, abs(running * {den} - total * {num}) AS off, rank FROM r UNION ALL SELECT status, max(total) * {num}, 0 FROM r GROUP BY status), b AS (SELECT status, arg_min(rank, (off, rank)) AS cut FROM c GROUP BY status)
SELECT r.status, r.make, r.n, r.rank <= b.cut AS selected FROM r JOIN b USING (status)"""


@query("spl_2_calibration_reserve", prefix_sql("calibration", 1, 10))
def _(spark, sf):
    return splits.closest_prefix_groups(listings(spark, sf), ["make"], "status", 1, 10, "calibration")


@query("spl_3_screening_sample", prefix_sql("screening", 3, 10))
def _(spark, sf):
    return splits.screening_sample(listings(spark, sf), ["make"], "status", 3, 10, "screening")


@query("spl_4_ranked_row_sample", """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(concat_ws('|', 'rows', o_orderstatus, CAST(o_orderkey AS VARCHAR)))) AS rank, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders)
SELECT o_orderstatus, o_orderkey, rank <= ceil((2 * total - 4) / 8.0) AS selected FROM r""")
def _(spark, sf):
    return splits.ranked_sample(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 1, 4, "rows")


@query("spl_4_null_bucket", L + """, r AS (SELECT mileage, row_id, row_number() OVER (PARTITION BY mileage ORDER BY sha256(concat_ws('|', 'rows', coalesce(CAST(mileage AS VARCHAR), chr(0)), row_id))) AS rank, count(*) OVER (PARTITION BY mileage) AS total FROM listings)
SELECT mileage, row_id, rank <= ceil((2 * total - 4) / 8.0) AS selected FROM r""")
def _(spark, sf):
    """New listings have no mileage: they are a bucket of their own."""
    return splits.ranked_sample(listings(spark, sf), "mileage", "row_id", 1, 4, "rows")


CHRONO = f"""{L}, g AS (SELECT private_key, max(sold_on) AS last_day FROM listings GROUP BY 1),
s AS (SELECT l.*, g.last_day, CASE WHEN g.last_day >= DATE '2000-06-01' THEN 'test' ELSE 'train' END AS split, g.last_day >= DATE '2000-06-01' AND l.sold_on < DATE '2000-06-01' AS promoted FROM listings l JOIN g USING (private_key))"""
BUCKETS = [("1990-01-01", "warmup"), ("1997-01-01", "b1"), ("1998-01-01", "b2"), ("1999-01-01", "b3")]


def chrono(spark, sf):
    return splits.chrono_group_split(listings(spark, sf), "private_key", "sold_on", "2000-06-01")


@query("spl_5_chronological_promotion", CHRONO + " SELECT row_id, split, promoted FROM s")
def _(spark, sf):
    return chrono(spark, sf).select("row_id", "split", "promoted")


def bucketed(spark, sf):
    from kerbside.functions.scalars import date_bucket

    return chrono(spark, sf).withColumn("bucket", F.when(F.col("split") == "train", date_bucket(F.col("last_day"), BUCKETS)))


BUCKETED = CHRONO + ", k AS (SELECT *, CASE WHEN split = 'test' THEN NULL WHEN last_day >= DATE '1999-01-01' THEN 'b3' WHEN last_day >= DATE '1998-01-01' THEN 'b2' WHEN last_day >= DATE '1997-01-01' THEN 'b1' ELSE 'warmup' END AS bucket FROM s)"


@query("spl_6_latest_date_buckets", BUCKETED + " SELECT row_id, bucket FROM k")
def _(spark, sf):
    return bucketed(spark, sf).select("row_id", "bucket")


PARTS = "SELECT {by}, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(sum(p) AS BIGINT) AS promoted_rows, count(*) FILTER (p > 0) AS promoted_groups, CAST(sum(l) AS BIGINT) AS rows_after_cutoff FROM (SELECT {by}, private_key, count(*) AS n, count(*) FILTER (promoted) AS p, count(*) FILTER (sold_on >= DATE '2000-06-01') AS l FROM {t} GROUP BY ALL) GROUP BY {by}"


@query("spl_7_split_metrics", f"{CHRONO} {PARTS.format(by='split', t='s')}")
def _(spark, sf):
    return splits.split_metrics(chrono(spark, sf), "private_key", "sold_on", "2000-06-01")


@query("spl_7_bucket_metrics", f"{BUCKETED} {PARTS.format(by='bucket', t='k')}")
def _(spark, sf):
    return splits.split_metrics(bucketed(spark, sf), "private_key", "sold_on", "2000-06-01", "bucket")


@query("spl_8_fixed_bucket_calibration", BUCKETED + " SELECT bucket, CASE WHEN bucket = 'b3' THEN 'calibration' WHEN bucket IS NOT NULL THEN 'development' END AS part, count(*) AS n FROM k GROUP BY ALL")
def _(spark, sf):
    return splits.bucket_partition(bucketed(spark, sf), "bucket", [b for _, b in BUCKETS]).groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))


@query("spl_9_predictor_group_key", f"{L} SELECT row_id, sha256(concat_ws(chr(31), CAST(year AS VARCHAR), make, coalesce(CAST(mileage AS VARCHAR), chr(0)))) AS key FROM listings")
def _(spark, sf):
    from kerbside.functions.scalars import content_hash

    return listings(spark, sf).select("row_id", content_hash(F.col("year"), F.col("make"), F.col("mileage")).alias("key"))


@query("spl_10_group_kfold", """WITH RECURSIVE g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sha256('kfold|' || CAST(l_orderkey AS VARCHAR))) AS rank FROM g),
sizes AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n DESC) AS i FROM g GROUP BY 1),
steps AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS counts
  UNION ALL SELECT i, n, list_transform(range(1, 6), lambda f: loads[f] + n * counts[f]), counts FROM (SELECT i, n, loads, list_transform(range(1, 6), lambda f: len(list_filter(taken, lambda t: t[2] = f))) AS counts
    FROM (SELECT s.i, s.n, t.loads, list_sort(flatten(list_transform(range(1, 6), lambda f: list_transform(range(s.c), lambda j: [t.loads[f] + j * s.n, f]))))[:s.c] AS taken FROM steps t JOIN sizes s ON s.i = t.i + 1)))
SELECT l_orderkey, r.n, CAST(len(list_filter(range(1, 6), lambda f: list_sum(counts[:f]) < rank)) AS INTEGER) AS fold FROM r JOIN steps USING (n)""")
def _(spark, sf):
    return splits.group_kfold(table(spark, sf, "lineitem"), "l_orderkey", 5)


@query("spl_11_forward_chaining", BUCKETED + """, p AS (SELECT row_id, CASE bucket WHEN 'warmup' THEN 0 WHEN 'b1' THEN 1 WHEN 'b2' THEN 2 WHEN 'b3' THEN 3 END AS pos FROM k WHERE bucket IS NOT NULL)
SELECT fold, role, count(*) AS n FROM (SELECT row_id, CAST(f.f AS INTEGER) AS fold, CASE WHEN pos = f.f THEN 'validate' ELSE 'train' END AS role FROM p JOIN (SELECT unnest(range(1, 4)) AS f) f ON pos <= f.f) GROUP BY ALL""")
def _(spark, sf):
    return splits.forward_folds(bucketed(spark, sf), "bucket", [b for _, b in BUCKETS]).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("spl_12_fold_validity", "SELECT count(*) FILTER (o_orderkey % 10 NOT IN (0, 1)) AS once, count(*) FILTER (o_orderkey % 10 = 0) AS never, count(*) FILTER (o_orderkey % 10 = 1) AS often, count(*) FILTER (o_orderkey % 10 = 2) AS two_roles FROM orders")
def _(spark, sf):
    """Four folds with mistakes: of ten keys one is never validated, one twice, and one trains where it validates."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(4)).alias("own"), F.pmod(k, F.lit(10)).alias("kind"))
    folds = o.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3))))
    mine = (F.col("fold") == F.col("own")) & (F.col("kind") != 0) | (F.col("fold") == F.pmod(F.col("own") + 1, F.lit(4))) & (F.col("kind") == 1)
    roles = F.when(mine & (F.col("kind") == 2), F.array(F.lit("validate"), F.lit("train"))).when(mine, F.array(F.lit("validate"))).otherwise(F.array(F.lit("train")))
    return splits.fold_check(folds.withColumn("role", F.explode(roles)), "o_orderkey")


def quota_sql(strata, n):
    """Quotas by largest remainder of ``strata`` (``key, n``) as a table ``q{n}``."""
    return f"""f{n} AS (SELECT *, (SELECT sum(n) FROM {strata})::BIGINT AS total FROM {strata}), g{n} AS (SELECT key, n, n * {n} // total AS base, n * {n} % total AS rest FROM f{n}),
q{n} AS (SELECT key, n, rest, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= {n} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g{n})"""


def nested_sql(small, large):
    """Quotas ``nested`` of ``large`` rows that are at least those of ``small``: in rounds, as the rule says."""
    return f"""r AS (SELECT 0 AS i, a.key, a.n, b.quota AS minimum, greatest(a.quota, b.quota) AS quota, a.rest FROM q{large} a JOIN q{small} b USING (key)
  UNION ALL SELECT i + 1, key, n, minimum, CASE WHEN quota > minimum AND row_number() OVER (ORDER BY quota > minimum DESC, rest, key) <= sum(quota) OVER () - {large} THEN quota - 1 ELSE quota END, rest FROM r QUALIFY sum(quota) OVER () > {large}),
nested AS (SELECT key, n, minimum, quota FROM r WHERE i = (SELECT max(i) FROM r))"""


STRATA = "s AS (SELECT make AS key, count(*) AS n FROM listings GROUP BY 1)"
RL = L.replace("WITH ", "WITH RECURSIVE ", 1)


def strata(spark, sf):
    return listings(spark, sf).groupBy("make").agg(F.count(F.lit(1)).alias("n"))


@query("spl_13_proportional_quotas", f"{L}, {STRATA}, {quota_sql('s', 997)} SELECT key AS make, n, quota FROM q997")
def _(spark, sf):
    return splits.proportional_quotas(strata(spark, sf), "make", 997)


@query("spl_14_nested_quotas", f"{RL}, {STRATA}, m AS (SELECT key, n, CASE WHEN key < 'Brand#3' THEN least(n, 50) ELSE 0 END AS quota FROM s), q1 AS (SELECT key, n, quota FROM m), {quota_sql('s', 1000)}, {nested_sql(1, 1000)} SELECT key AS make, n, minimum, quota FROM nested")
def _(spark, sf):
    """Makes below Brand#3 keep 50 rows at least, more than their share of 1,000; the others give."""
    held = strata(spark, sf).withColumn("minimum", F.when(F.col("make") < "Brand#3", F.least("n", F.lit(50))).otherwise(0).cast("long"))
    return splits.nested_quotas(held, "make", 1000, "minimum")


CELLS = """e AS (SELECT quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM listings), c AS (SELECT row_id, concat_ws('|', make, year, CAST(1 + len(list_filter(e.e, lambda x: x < price)) AS INTEGER)) AS key FROM listings, e),
s AS (SELECT key, count(*) AS n FROM c GROUP BY 1)"""


def nested_sql_of(cells):
    return f"""{RL}, {cells}, {quota_sql('s', 400)}, {quota_sql('s', 997)}, {nested_sql(400, 997)}, k AS (SELECT row_id, key, row_number() OVER (PARTITION BY key ORDER BY sha256(concat_ws('|', 'nested', row_id))) AS k FROM c)
SELECT row_id, key AS cell, k <= minimum AS small FROM k JOIN nested USING (key) WHERE k <= quota"""


def nested_samples(rows):
    """Of ``row_id`` and ``cell`` the sample of 997, and which of its rows are in the one of 400."""
    rows = written(rows, "cells")
    counts = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-counts")
    small = written(splits.proportional_quotas(counts, "cell", 400), "small-quotas")
    large = splits.nested_quotas(small.withColumnRenamed("quota", "minimum"), "cell", 997, "minimum")
    few = splits.stratified_sample(rows, "row_id", "cell", small, "nested").select(F.col("row_id").alias("__id"))
    many = splits.stratified_sample(rows, "row_id", "cell", large.select("cell", "quota"), "nested")
    return many.join(few, F.col("row_id") == F.col("__id"), "full_outer").select("row_id", "cell", F.col("__id").isNotNull().alias("small"))


@query("spl_15_nested_stratified_sample", nested_sql_of(CELLS))
def _(spark, sf):
    """Strata of make, year and price decile; the sample of 400 lies within that of 997."""
    return nested_samples(splits.value_decile(written(listings(spark, sf).select("row_id", "make", "year", "price"), "decile-rows"), "price").select("row_id", F.concat_ws("|", "make", "year", "decile").alias("cell")))


MILEAGE_CELLS = """q AS (SELECT quantile_cont(mileage, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM listings), e AS (SELECT list_filter(list_distinct(q), lambda x: x > q[1] AND x < q[11]) AS e FROM q),
c AS (SELECT row_id, concat_ws('|', make, year, CASE WHEN mileage IS NULL THEN 'missing' ELSE CAST(1 + len(list_filter(e.e, lambda x: x <= mileage)) AS VARCHAR) END) AS key FROM listings, e), s AS (SELECT key, count(*) AS n FROM c GROUP BY 1)"""


@query("spl_15_mileage_decile_sample", nested_sql_of(MILEAGE_CELLS))
def _(spark, sf):
    """Strata of make, year and mileage decile, a mileage on an edge in the upper one; listings without mileage are strata of their own."""
    placed = splits.value_decile(written(listings(spark, sf).select("row_id", "make", "year", "mileage"), "decile-rows"), "mileage", upper=True)
    return nested_samples(placed.select("row_id", F.concat_ws("|", "make", "year", F.coalesce(F.col("decile").cast("string"), F.lit("missing"))).alias("cell")))


@query("spl_15_null_stratum", L + """, k AS (SELECT row_id, mileage, row_number() OVER (PARTITION BY mileage ORDER BY sha256(concat_ws('|', 'nulls', row_id))) AS k FROM listings)
SELECT row_id, mileage FROM k WHERE k <= CASE WHEN mileage IS NULL THEN 50 ELSE 3 END""")
def _(spark, sf):
    """Three listings of each mileage and fifty without one."""
    rows = written(listings(spark, sf).select("row_id", "mileage"), "stratum-rows")
    quotas = rows.select("mileage").distinct().withColumn("quota", F.when(F.col("mileage").isNull(), 50).otherwise(3))
    return splits.stratified_sample(rows, "row_id", "mileage", quotas, "nulls")


@query("evl_1_regression_metrics", f"{L} SELECT {METRICS} FROM listings")
def _(spark, sf):
    return tidy(evaluate.regression_metrics(scored(spark, sf)))


@query("evl_2_slice_metrics", f"{L} SELECT status AS label, CAST(grouping(status) AS INTEGER) AS overall, {METRICS} FROM listings GROUP BY GROUPING SETS ((), (status))")
def _(spark, sf):
    return tidy(evaluate.slice_metrics(scored(spark, sf), "status"))


@query("evl_3_point_metrics", f"""{L} SELECT status, count(*) AS n, round(median(abs(p - y)), 4) AS median_ae, round(quantile_cont(abs(p - y), 0.75), 4) AS p75_ae, round(quantile_cont(abs(p - y), 0.9), 4) AS p90_ae, round(quantile_cont(abs(p - y), 0.95), 4) AS p95_ae, round(avg(p - y), 4) AS mean_error,
round(median(p - y), 4) AS median_error, count(*) FILTER (p < y) AS under, count(*) FILTER (p > y) AS over, count(*) FILTER (p = y) AS exact, (count(*) FILTER (p < y))::DOUBLE / count(*) AS under_rate, (count(*) FILTER (p > y))::DOUBLE / count(*) AS over_rate, (count(*) FILTER (p = y))::DOUBLE / count(*) AS exact_rate FROM listings GROUP BY status""")
def _(spark, sf):
    return rounded(evaluate.point_metrics(scored(spark, sf), ["status"]), "median_ae", "p75_ae", "p90_ae", "p95_ae", "mean_error", "median_error")


@query("evl_4_slice_diagnostics", f"{L} SELECT 'make' AS dimension, make AS label, {METRICS} FROM listings GROUP BY make HAVING count(*) >= 20 UNION ALL SELECT 'year', CAST(year AS VARCHAR), {METRICS} FROM listings GROUP BY year HAVING count(*) >= 20")
def _(spark, sf):
    return tidy(evaluate.slice_diagnostics(scored(spark, sf), ["make", "year"], 20))


@query("evl_5_arm_fold_source", f"{L} SELECT status, source, fold, CAST(grouping_id(status, source, fold) AS INTEGER) AS level, {METRICS} FROM listings GROUP BY GROUPING SETS ((status), (status, fold), (status, source))")
def _(spark, sf):
    return tidy(evaluate.arm_metrics(scored(spark, sf), "status", "source", "fold"))


@query("evl_6_quantile_slices", f"""{L}, e AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS e FROM listings) SELECT CAST(1 + len(list_filter(e.e, lambda x: x < price)) AS INTEGER) AS quartile, count(*) AS n FROM listings, e GROUP BY 1""")
def _(spark, sf):
    return evaluate.quantile_labels(listings(spark, sf), "price").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"))


@query("evl_7_merge_fold_metrics", f"{L} SELECT {METRICS} FROM listings")
def _(spark, sf):
    rows = scored(spark, sf)
    folds = evaluate.regression_metrics(rows, by=["fold"]).join(F.broadcast(rows.agg(F.var_pop("y").alias("v"))))
    return tidy(evaluate.combine_metrics(folds, F.col("v")))


@query("evl_8_fold_stability", f"{L}, f AS (SELECT avg(abs(p - y)) AS m FROM listings GROUP BY fold) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, round(min(m), 4) AS min, round(max(m), 4) AS max, round(stddev_pop(m) / avg(m), 4) AS cv FROM f")
def _(spark, sf):
    return rounded(evaluate.fold_stability(evaluate.regression_metrics(scored(spark, sf), by=["fold"]), "mae"), "mean", "std", "min", "max", "cv")


@query("evl_9_residual_stats", f"""{L}, s AS (SELECT 'make' AS dimension, make AS label, count(*) AS n, round(avg(score), 4) AS mean, round(var_pop(score), 0) AS variance, round(quantile_cont(score, 0.5), 4) AS q50, round(quantile_cont(score, 0.8), 4) AS q80, round(quantile_cont(score, 0.9), 4) AS q90,
round(quantile_cont(score, 0.95), 4) AS q95, round(avg(score / y), 6) AS mean_ratio, round(quantile_cont(score / y, 0.5), 6) AS median_ratio, round(quantile_cont(score / y, 0.9), 6) AS p90_ratio FROM listings GROUP BY make HAVING count(*) >= 20) SELECT * FROM s QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 20""")
def _(spark, sf):
    found = evaluate.residual_stats(scored(spark, sf), ["make"], 20, 20)
    return rounded(rounded(rounded(found, "mean", "q50", "q80", "q90", "q95"), "variance", digits=0), "mean_ratio", "median_ratio", "p90_ratio", digits=6)


@query("evl_10_error_relationship", f"""{L}, r AS (SELECT y AS v, score AS e, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rv, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS re FROM listings)
SELECT count(*) AS n, round(corr(ln(1 + v), ln(1 + e)), 6) AS pearson_log, round(corr(rv, re), 6) AS spearman FROM r""")
def _(spark, sf):
    return rounded(evaluate.error_relationship(scored(spark, sf)), "pearson_log", "spearman", digits=6)


@query("evl_10_quartile_errors", f"""{L}, e AS (SELECT quantile_cont(y, [0.25, 0.5, 0.75]) AS e FROM listings), m AS (SELECT CAST(1 + len(list_filter(e.e, lambda x: x < y)) AS INTEGER) AS quartile, count(*) AS n, avg(score) AS m FROM listings, e GROUP BY 1)
SELECT quartile, n, round(m, 4) AS mean_error, round((SELECT max(m) / min(m) FROM m), 6) AS highest_to_lowest FROM m""")
def _(spark, sf):
    return rounded(rounded(evaluate.quartile_errors(scored(spark, sf)), "mean_error"), "highest_to_lowest", digits=6)


@query("evl_11_strict_quartiles", f"{L} SELECT round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.5), 4) AS q2, round(quantile_cont(price, 0.75), 4) AS q3 FROM listings")
def _(spark, sf):
    rows = listings(spark, sf)
    cuts = evaluate.strict_quartiles(rows, "price")
    return rows.limit(1).select(*[F.round(F.lit(c), 4).alias(n) for n, c in zip(("q1", "q2", "q3"), cuts)])


@query("evl_12_best_worst_segments", f"""{L}, s AS (SELECT make AS label, round(avg(abs(p - y)), 4) AS mae FROM listings GROUP BY 1), r AS (SELECT 'make' AS dimension, label, mae, CAST(row_number() OVER (ORDER BY mae, label) AS INTEGER) AS best, CAST(row_number() OVER (ORDER BY mae DESC, label) AS INTEGER) AS worst FROM s)
SELECT * FROM r WHERE best <= 5 OR worst <= 5""")
def _(spark, sf):
    return evaluate.rank_segments(slices(spark, sf, "true"), "mae")


def long_report(spark, sf, where):
    return evaluate.report_long(slices(spark, sf, where), ["dimension", "label"], ["mae", "rmse"])


@query("evl_13_report_comparison", f"""{L}, r AS (SELECT status, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings GROUP BY status), i AS (SELECT l.*, greatest(0, p - radius) AS lower, p + radius AS upper FROM listings l JOIN r USING (status)),
m AS (SELECT source, make, round(avg(abs(p - y)), 4) AS mae, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(upper - lower), 4) AS mean_width FROM i GROUP BY ALL),
u AS (SELECT source, make, unnest(['mae', 'coverage', 'mean_width']) AS metric, unnest([mae, coverage, mean_width]) AS v FROM m)
SELECT 'make' AS dimension, a.make AS label, a.metric, a.v AS now, b.v AS prior, round(a.v - b.v, 4) AS difference, round(a.v / b.v, 6) AS ratio FROM u a JOIN u b ON a.make = b.make AND a.metric = b.metric WHERE a.source = 'O' AND b.source = 'F'""")
def _(spark, sf):
    """Errors, coverages and widths by make, of one source after the other."""
    rows = written(intervals(spark, sf).select("source", "make", "y", "p", "lower", "upper", "fallback"), "evaluated")

    def report(source):
        own = rows.where(F.col("source") == source)
        widths = tidy_intervals(conformal.slices_of(own, ["make"], 0.9, 1))
        return evaluate.report_long(tidy(evaluate.slice_diagnostics(own, ["make"], 1)), ["dimension", "label"], ["mae"]).unionByName(evaluate.report_long(widths, ["dimension", "label"], ["coverage", "mean_width"]))

    return rounded(rounded(evaluate.compare_reports(report("O"), report("F")), "difference"), "ratio", digits=6)


CONFIDENCE = "CASE WHEN status = 'Certified' THEN 'high' WHEN status = 'Used' THEN 'moderate' ELSE 'low' END"


@query("evl_14_confidence_ordering", f"""{L}, m AS (SELECT {CONFIDENCE} AS label, count(*) AS n, avg(score) AS e FROM listings GROUP BY 1), p AS (SELECT *, CASE label WHEN 'high' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS place FROM m)
SELECT label, n, round(e, 4) AS mean_error, place, coalesce(e >= lag(e) OVER (ORDER BY place), true) AS ordered FROM p""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("label", F.expr(CONFIDENCE))
    return rounded(evaluate.confidence_diagnostics(rows, "label", ["high", "moderate", "low"], F.col("score")), "mean_error")


GATES = [("mae", "mae", "<=", 30000.0), ("rmse", "rmse", "<=", 100.0), ("support", "n", ">=", 100.0)]


@query("evl_15_gates", f"""{L}, m AS (SELECT count(*)::DOUBLE AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse FROM listings)
SELECT 'mae' AS gate, mae AS observed, '<=' AS operator, 30000.0::DOUBLE AS threshold, mae <= 30000 AS passed FROM m UNION ALL SELECT 'rmse', rmse, '<=', 100.0, rmse <= 100 FROM m UNION ALL SELECT 'support', n, '>=', 100.0, n >= 100 FROM m""")
def _(spark, sf):
    m = tidy(evaluate.regression_metrics(scored(spark, sf)))
    return rules.evaluate_gates(evaluate.report_long(m, [], ["n", "mae", "rmse"]), GATES)


@query("evl_15_classification", f"{L}, m AS (SELECT avg(abs(p - y)) <= 30000 AS a, sqrt(avg((p - y) * (p - y))) <= 100 AS b FROM listings) SELECT CASE WHEN a AND b THEN 'strong' WHEN a THEN 'portfolio' ELSE 'rejected' END AS classification FROM m")
def _(spark, sf):
    m = tidy(evaluate.regression_metrics(scored(spark, sf)))
    return rules.classify(rules.evaluate_gates(evaluate.report_long(m, [], ["n", "mae", "rmse"]), GATES), ["mae", "rmse", "support"], ["mae"])


@query("evl_16_minimum_slice", f"{L}, s AS (SELECT avg(CASE WHEN score <= 20000 THEN 1.0 ELSE 0.0 END) AS c FROM listings GROUP BY make HAVING count(*) >= 20) SELECT 'make' AS dimension, round(min(c), 6) AS min_coverage, count(*) AS slices FROM s")
def _(spark, sf):
    rows = scored(spark, sf).groupBy(F.lit("make").alias("dimension"), F.col("make").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") <= 20000).cast("double")).alias("coverage"))
    return rounded(evaluate.min_slice(rows, "coverage", 20), "min_coverage", digits=6)


@query("evl_17_reproduction_check", f"{L}, m AS (SELECT make, round(avg(abs(p - y)), 4) AS v FROM listings GROUP BY 1) SELECT 'make' AS dimension, make AS label, 'mae' AS metric, v AS left, round(v * 1.01, 4) AS right, round(abs(v - v * 1.01), 2) AS delta FROM m WHERE make LIKE '%1'")
def _(spark, sf):
    a = long_report(spark, sf, "true").where("metric = 'mae'")
    b = a.withColumn("value", F.when(F.col("label").endswith("1"), F.col("value") * 1.01).otherwise(F.col("value")))
    return rounded(rounded(evaluate.reproduction(a, b, 1e-6, 1e-9), "right"), "delta", digits=2)


ORDER_STAT = """SELECT {by}, c.coverage, count(*) AS support, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * c.coverage) AS BIGINT)] AS radius"""
COVERS = "(SELECT unnest([0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS coverage) c"


@query("cnf_1_order_statistic", f"{L} {ORDER_STAT.format(by='status')} FROM listings, {COVERS} GROUP BY status, c.coverage")
def _(spark, sf):
    return conformal.order_stats(scored(spark, sf), "score", ["status"])


@query("cnf_2_status_radii", f"{L} {ORDER_STAT.format(by=chr(39) + 'status' + chr(39) + ' AS level, status AS key')} FROM listings, {COVERS} GROUP BY status, c.coverage UNION ALL {ORDER_STAT.format(by=chr(39) + 'global' + chr(39) + ', ' + chr(39) * 2)} FROM listings, {COVERS} GROUP BY c.coverage")
def _(spark, sf):
    return conformal.fit_radii(scored(spark, sf), "status", "score")


LEVELS = {"status_make": ["status", "make"], "status": ["status"], "global": []}
HIER = """{w} SELECT 'status_make' AS level, status || '|' || make AS key, c.coverage, count(*) AS support, CASE WHEN count(*) >= 100 THEN list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * c.coverage) AS BIGINT)] END AS radius FROM listings, {c} GROUP BY status, make, c.coverage
UNION ALL SELECT 'status', status, c.coverage, count(*), CASE WHEN count(*) >= 100 THEN list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * c.coverage) AS BIGINT)] END FROM listings, {c} GROUP BY status, c.coverage
UNION ALL SELECT 'global', '', c.coverage, count(*), CASE WHEN count(*) >= 100 THEN list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * c.coverage) AS BIGINT)] END FROM listings, {c} GROUP BY c.coverage"""


@query("cnf_3_radius_hierarchy", HIER.format(w=L, c=COVERS))
def _(spark, sf):
    return conformal.fit_hierarchy(scored(spark, sf), LEVELS, "score", 100)


INTERVALS = L + """, r AS (SELECT status, count(*) AS support, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings GROUP BY status),
i AS (SELECT l.*, r.radius, r.support, greatest(0, p - r.radius) AS lower, p + r.radius AS upper, false AS fallback FROM listings l JOIN r USING (status))"""


def intervals(spark, sf, clip=False):
    rows = scored(spark, sf)
    return conformal.apply_intervals(rows, conformal.fit_radii(rows, "status", "score"), [("status", ["status"]), ("global", [])], 0.9, clip_upper=clip)


@query("cnf_4_apply_radii", INTERVALS + " SELECT row_id, round(lower, 4) AS lower, round(upper, 4) AS upper, support, 'status' AS method FROM i")
def _(spark, sf):
    return rounded(intervals(spark, sf).select("row_id", "lower", "upper", "support", "method"), "lower", "upper")


@query("cnf_5_calibrated_valuation", INTERVALS + """ SELECT row_id, round(p, 2) AS value, round(lower, 2) AS lower, round(upper, 2) AS upper, CASE WHEN (upper - lower) / greatest(p, 1) <= 0.5 AND support >= 1000 THEN 'high' WHEN (upper - lower) / greatest(p, 1) <= 1.5 THEN 'moderate' ELSE 'low' END AS confidence,
CASE WHEN mileage IS NULL THEN 'missing_mileage' ELSE '' END AS warnings FROM i""")
def _(spark, sf):
    from kerbside.functions import scalars as S

    i = intervals(spark, sf)
    relative = (F.col("upper") - F.col("lower")) / F.greatest(F.col("p"), F.lit(1.0))
    return rounded(i.select("row_id", F.col("p").alias("value"), "lower", "upper", S.confidence_label(relative, F.col("support"), 0.5, 1.5).alias("confidence"), F.array_join(S.quality_warnings(F.col("mileage"), F.lit(False)), ",").alias("warnings")), "value", "lower", "upper", digits=2)


I_METRICS = """count(*) AS n, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) - 0.9, 6) AS gap, round(avg(CASE WHEN y < lower THEN 1.0 ELSE 0.0 END), 6) AS under,
round(avg(CASE WHEN y > upper THEN 1.0 ELSE 0.0 END), 6) AS over, round(avg(upper - lower), 4) AS mean_width, round(quantile_cont(upper - lower, 0.1), 4) AS p10_width, round(median(upper - lower), 4) AS median_width, round(quantile_cont(upper - lower, 0.9), 4) AS p90_width, round(avg((upper - lower) / greatest(p, 1)), 6) AS relative_width,
count(*) FILTER (lower = 0) AS clipped, count(*) FILTER (fallback) AS fallbacks, 0 AS reversed, 0 AS invalid, round(avg(CASE WHEN y BETWEEN p - radius AND p + radius THEN 1.0 ELSE 0.0 END), 6) AS unclipped_coverage, 0 AS clip_changes"""


def tidy_intervals(df):
    return rounded(rounded(df, "coverage", "gap", "under", "over", "relative_width", "unclipped_coverage", digits=6), "mean_width", "p10_width", "median_width", "p90_width")


@query("cnf_6_interval_metrics", INTERVALS + f" SELECT source, {I_METRICS} FROM i GROUP BY source")
def _(spark, sf):
    return tidy_intervals(conformal.interval_metrics(intervals(spark, sf), 0.9, ["source"]))


@query("cnf_7_crossfit", L + f""", r AS (SELECT f.f AS fold, status, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings l, (SELECT unnest(range(0, 5)) AS f) f WHERE l.fold <> f.f GROUP BY ALL),
i AS (SELECT l.*, radius, greatest(0, p - radius) AS lower, p + radius AS upper, false AS fallback FROM listings l JOIN r USING (fold, status)), j AS (SELECT *, NULL AS label FROM i UNION ALL SELECT *, status FROM i),
d AS (SELECT label, stddev_pop(c) AS d FROM (SELECT label, fold, avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS c FROM j GROUP BY ALL) GROUP BY label)
SELECT j.label, {I_METRICS}, round(any_value(d.d), 9) AS fold_std FROM j JOIN d ON j.label IS NOT DISTINCT FROM d.label GROUP BY j.label""")
def _(spark, sf):
    rows = scored(spark, sf).select("fold", "status", "y", "p", "score")
    i = conformal.crossfit_intervals(rows, "fold", 5, {"status": ["status"], "global": []}, "score", 0.9, 0)
    return rounded(tidy_intervals(conformal.crossfit_report(written(i, "crossfit"), 0.9, "fold", "status")), "fold_std", digits=9)


def method_metrics(spark, sf):
    """What the gates look at for two methods: one radius for all, and one for each status."""
    rows = written(scored(spark, sf).select("make", "status", "y", "p", "score"), "methods")
    radii = conformal.fit_radii(rows, "status", "score", coverages=(0.9,), stored=True)
    one = conformal.apply_intervals(rows, radii, [("global", [])], 0.9).withColumn("method", F.lit("global"))
    two = conformal.apply_intervals(rows, radii, [("status", ["status"]), ("global", [])], 0.9).withColumn("method", F.lit("status"))
    m = conformal.gate_metrics(one.unionByName(two), 0.9, ["make", "status"], "y", 60_000.0, 100)
    return written(rounded(rounded(m, "coverage_gap", "slice_gap", "high_price_gap", "balance", "fallback_rate", digits=6), "mean_width", "median_width"), "method-metrics")


METHOD_SQL = L + """, g AS (SELECT list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings), s AS (SELECT status, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings GROUP BY 1),
i AS (SELECT 'global' AS method, make, status, y, greatest(0, p - radius) AS lower, p + radius AS upper FROM listings, g UNION ALL SELECT 'status', make, status, y, greatest(0, p - radius), p + radius FROM listings JOIN s USING (status)),
h AS (SELECT *, CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END AS hit FROM i), k AS (SELECT method, max(abs(c - 0.9)) AS slice_gap FROM (SELECT method, 'make' AS d, make AS l, avg(hit) AS c, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT method, 'status', status, avg(hit), count(*) FROM h GROUP BY ALL) WHERE n >= 100 GROUP BY method),
m AS (SELECT h.method, round(avg(hit) - 0.9, 6) AS coverage_gap, round(any_value(k.slice_gap), 6) AS slice_gap, round(0.9 - avg(hit) FILTER (y >= 60000), 6) AS high_price_gap, round(abs(avg(CASE WHEN y < lower THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y > upper THEN 1.0 ELSE 0.0 END)), 6) AS balance,
  round(avg(upper - lower), 4) AS mean_width, round(median(upper - lower), 4) AS median_width FROM h LEFT JOIN k ON h.method = k.method GROUP BY h.method),
t AS (SELECT m.method, unnest(['overall_gap', 'slice_gap', 'high_price_gap', 'balance', 'fallback_rate', 'reversed', 'width_ratio', 'median_width_ratio']) AS gate,
  unnest([abs(coverage_gap), slice_gap, high_price_gap, balance, 0, 0, mean_width / b.w, median_width / b.d]) AS observed, unnest([0.01::DOUBLE, 0.05, 0.1, 0.08, 0.1, 0, 1.05, 1.1]) AS threshold FROM m, (SELECT mean_width AS w, median_width AS d FROM m WHERE method = 'global') b)"""
LIMITS = {"overall_gap": 0.01, "slice_gap": 0.05, "high_price_gap": 0.1, "balance": 0.08, "fallback_rate": 0.1, "reversed": 0.0, "width_ratio": 1.05, "median_width_ratio": 1.1}


@query("cnf_8_11_sharpness_gates", METHOD_SQL + " SELECT method, gate, round(observed, 6) AS observed, threshold, coalesce(observed <= threshold, true) AS passed FROM t")
def _(spark, sf):
    return rounded(conformal.sharpness_gates(method_metrics(spark, sf), "global", LIMITS), "observed", digits=6)


@query("cnf_12_method_choice", METHOD_SQL + """, ok AS (SELECT method FROM t GROUP BY 1 HAVING bool_and(coalesce(observed <= threshold, true))), r AS (SELECT method, mean_width, CASE method WHEN 'global' THEN 1 ELSE 2 END AS place FROM m WHERE method IN (SELECT method FROM ok))
SELECT arg_min(method, (mean_width, place)) AS method FROM r WHERE place = (SELECT min(place) FROM r) OR mean_width <= (SELECT arg_min(mean_width, place) FROM r) * 0.97""")
def _(spark, sf):
    m = method_metrics(spark, sf)
    return conformal.choose_method(conformal.sharpness_gates(m, "global", LIMITS), ["global", "status"], m.select("method", "mean_width"))


FOCUS = {"used": ("status", "Used"), "high_price": ("band", "high")}
REGRESSIONS = {"worst_fold_regression": 0.02, "fold_sd_increase": 0.01, "fallback_increase": 0.05, "focus_used_regression": 0.02, "focus_high_price_regression": 0.02}


def three_methods(spark, sf):
    """Every listing with the intervals of three methods: one radius for all, one for each status, and one for each status times a scale that grows with the price."""
    from kerbside.functions.scalars import smooth_scale

    rows = written(scored(spark, sf).select("make", "status", "fold", "y", "p", "score", F.when(F.col("price") >= 60_000, "high").otherwise("low").alias("band"), smooth_scale(F.col("prediction")).alias("scale")), "three-methods")
    radii = conformal.fit_radii(rows, "status", "score", coverages=(0.9,), stored=True)
    one = conformal.apply_intervals(rows, radii, [("global", [])], 0.9).withColumn("method", F.lit("global"))
    two = conformal.apply_intervals(rows, radii, [("status", ["status"]), ("global", [])], 0.9).withColumn("method", F.lit("status"))
    three = conformal.scaled_intervals(rows, "scale", "status", 0.9, stored=True).withColumn("method", F.lit("scaled"))
    columns = ["method", "make", "status", "band", "fold", "y", "lower", "upper", "fallback"]
    return written(one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns)), "method-intervals")


def all_gates(spark, sf):
    """The gates of CNF-8 and those against the base for the three methods, and their mean widths."""
    rows = three_methods(spark, sf)
    m = conformal.gate_metrics(rows, 0.9, ["make", "status"], "y", 60_000.0, 100, stored=True)
    m = written(rounded(rounded(m, "coverage_gap", "slice_gap", "high_price_gap", "balance", "fallback_rate", digits=6), "mean_width", "median_width"), "method-metrics")
    gates = conformal.sharpness_gates(m, "global", LIMITS).unionByName(conformal.regression_gates(rows, "global", "fold", FOCUS, REGRESSIONS))
    return written(gates.withColumn("observed", F.round("observed", 6)), "gates"), m.select("method", "mean_width")


THREE_SQL = L + """, g AS (SELECT list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings), s AS (SELECT status, list_sort(list(score))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings GROUP BY 1),
v AS (SELECT status, list_sort(list(abs(y - p) / (1 + ln(1 + p / 10000))))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM listings GROUP BY 1),
i AS (SELECT 'global' AS method, make, status, fold, y, greatest(0, p - radius) AS lower, p + radius AS upper FROM listings, g UNION ALL SELECT 'status', make, status, fold, y, greatest(0, p - radius), p + radius FROM listings JOIN s USING (status)
  UNION ALL SELECT 'scaled', make, status, fold, y, greatest(0, p - radius * (1 + ln(1 + p / 10000))), p + radius * (1 + ln(1 + p / 10000)) FROM listings JOIN v USING (status)),
h AS (SELECT *, CASE WHEN y BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM i), k AS (SELECT method, max(abs(c - 0.9)) AS slice_gap FROM (SELECT method, 'make' AS d, make AS l, avg(hit) AS c, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT method, 'status', status, avg(hit), count(*) FROM h GROUP BY ALL) WHERE n >= 100 GROUP BY method),
m AS (SELECT h.method, round(avg(hit) - 0.9, 6) AS coverage_gap, round(any_value(k.slice_gap), 6) AS slice_gap, round(0.9 - avg(hit) FILTER (y >= 60000), 6) AS high_price_gap, round(abs(avg(CASE WHEN y < lower THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y > upper THEN 1.0 ELSE 0.0 END)), 6) AS balance,
  round(avg(upper - lower), 4) AS mean_width, round(median(upper - lower), 4) AS median_width FROM h LEFT JOIN k ON h.method = k.method GROUP BY h.method),
f AS (SELECT method, fold, avg(hit) AS c FROM h GROUP BY ALL), r AS (SELECT f.method, max(b.c - f.c) AS fold_worst, stddev_pop(f.c) - stddev_pop(b.c) AS sd FROM f JOIN f b ON b.method = 'global' AND b.fold = f.fold GROUP BY f.method),
u AS (SELECT method, avg(hit) FILTER (status = 'Used') AS used, avg(hit) FILTER (y >= 60000) AS high FROM h GROUP BY method),
o AS (SELECT m.method, unnest([{'gate': 'overall_gap', 'observed': abs(coverage_gap), 'threshold': 0.01::DOUBLE}, {'gate': 'slice_gap', 'observed': slice_gap, 'threshold': 0.05}, {'gate': 'high_price_gap', 'observed': high_price_gap, 'threshold': 0.1}, {'gate': 'balance', 'observed': balance, 'threshold': 0.08},
  {'gate': 'fallback_rate', 'observed': 0, 'threshold': 0.1}, {'gate': 'reversed', 'observed': 0, 'threshold': 0}, {'gate': 'width_ratio', 'observed': mean_width / b.w, 'threshold': 1.05}, {'gate': 'median_width_ratio', 'observed': median_width / b.d, 'threshold': 1.1},
  {'gate': 'worst_fold_regression', 'observed': fold_worst, 'threshold': 0.02}, {'gate': 'fold_sd_increase', 'observed': sd, 'threshold': 0.01}, {'gate': 'fallback_increase', 'observed': 0, 'threshold': 0.05},
  {'gate': 'focus_used_regression', 'observed': z.used - u.used, 'threshold': 0.02}, {'gate': 'focus_high_price_regression', 'observed': z.high - u.high, 'threshold': 0.02}]) AS x
  FROM m JOIN r USING (method) JOIN u USING (method), (SELECT mean_width AS w, median_width AS d FROM m WHERE method = 'global') b, (SELECT used, high FROM u WHERE method = 'global') z),
t AS (SELECT method, x.gate AS gate, round(x.observed, 6) AS observed, x.threshold AS threshold, x.observed <= x.threshold AS passed FROM o)"""


@query("cnf_11_fold_and_focus_gates", THREE_SQL + " SELECT method, gate, observed, threshold, passed FROM t")
def _(spark, sf):
    return all_gates(spark, sf)[0]


@query("cnf_12_no_worse_gate", THREE_SQL + """, ok AS (SELECT method FROM t WHERE method <> 'global' GROUP BY 1 HAVING bool_and(passed)), cuts AS (SELECT method, 1 - mean_width / (SELECT mean_width FROM m WHERE method = 'global') AS cut FROM m),
good AS (SELECT method, cut, CASE method WHEN 'status' THEN 1 ELSE 2 END AS place FROM ok JOIN cuts USING (method)), simple AS (SELECT * FROM good ORDER BY place LIMIT 1),
better AS (SELECT p.method, p.cut FROM good p, simple s WHERE p.place > s.place AND p.cut - s.cut >= 0.005 AND NOT EXISTS (SELECT 1 FROM t x JOIN t z ON x.gate = z.gate AND z.method = s.method WHERE x.method = p.method AND x.observed > z.observed + 1e-12))
SELECT coalesce((SELECT method FROM better ORDER BY cut DESC LIMIT 1), (SELECT method FROM simple), 'global') AS method""")
def _(spark, sf):
    gates, widths = all_gates(spark, sf)
    return conformal.choose_sharper(gates, widths, "global", ["status", "scaled"], 0.005)


@query("cnf_9_scaled_conformal", L + """, s AS (SELECT *, 1 + ln(1 + p / 10000) AS scale FROM listings), r AS (SELECT status, list_sort(list(abs(y - p) / scale))[CAST(ceil((count(*) + 1)::DOUBLE * 0.9::DOUBLE) AS BIGINT)] AS radius FROM s GROUP BY 1)
SELECT row_id, round(greatest(0, p - radius * scale), 3) AS lower, round(p + radius * scale, 3) AS upper FROM s JOIN r USING (status)""")
def _(spark, sf):
    from kerbside.functions.scalars import smooth_scale

    rows = scored(spark, sf).withColumn("scale", smooth_scale(F.col("p")))
    return rounded(conformal.scaled_intervals(rows, "scale", "status", 0.9).select("row_id", "lower", "upper"), "lower", "upper", digits=3)


POISSON = ", ".join(f"{x!r}::DOUBLE" for x in conformal._POISSON)


@query("cnf_10_cluster_bootstrap", L + f""", g AS (SELECT seller, sum(score) AS a, sum(y) AS b, count(*) AS n FROM listings GROUP BY 1), d AS (SELECT a, b, n, r.r, len(list_filter([{POISSON}], lambda c: c <= CAST('0x' || substr(md5(concat_ws(':', 'bootstrap', CAST(seller AS VARCHAR), CAST(r.r AS VARCHAR))), 1, 12) AS BIGINT)::DOUBLE / 281474976710656)) AS w FROM g, (SELECT unnest(range(1, 2001)) AS r) r),
e AS (SELECT r, sum(a * w) / sum(b * w) AS ratio, (sum(a * w) - sum(b * w)) / sum(n * w) AS delta FROM d GROUP BY r) SELECT round((SELECT sum(score) / sum(y) FROM listings), 6) AS ratio, round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high,
round((SELECT avg(score - y) FROM listings), 3) AS delta, round(quantile_cont(delta, 0.025), 3) AS delta_low, round(quantile_cont(delta, 0.975), 3) AS delta_high, count(*) AS replicates FROM e""")
def _(spark, sf):
    return rounded(rounded(conformal.cluster_bootstrap(scored(spark, sf), "seller", "score", "y"), "ratio", "low", "high", digits=6), "delta", "delta_low", "delta_high", digits=3)
