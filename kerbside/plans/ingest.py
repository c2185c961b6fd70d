"""Queries for sources, sinks, rules, scalars and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import scalars as S
from kerbside.operators import dedupe, integrity, rules
from kerbside.operators.evaluate import regression_metrics, report_long
from kerbside.plans.bindings import JUDGED, LISTINGS, RAW, listings, query, raw_listings, reason_rules, scored, table
from kerbside.schema import FeatureContract
from kerbside.sources import cards, publish, readers
from kerbside.staging import fresh_dir

CONTRACT = FeatureContract(("make", "model", "year", "status"), ("mileage",), ("year", "mileage"))


@query("src_1_strict_csv", f"WITH {RAW} SELECT status, CASE WHEN k IN (8, 9) THEN 'row_width_invalid' END AS reason_code, count(*) AS n FROM raw GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Several files, each with its header; rows of kinds 8 and 9 have a field too few and one too many."""
    path, names = fresh_dir(spark, "csv"), ["brand", "model", "year", "status", "mileage", "price"]
    line = F.when(F.col("k") == 8, F.concat_ws(",", *names[:-1])).when(F.col("k") == 9, F.concat_ws(",", *names, F.lit("more"))).otherwise(F.concat_ws(",", *names))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition, so of its file
    raw_listings(spark, sf).select(line.alias("line")).repartition(8).select(F.explode(F.when(first, F.array(F.lit(",".join(names)), "line")).otherwise(F.array("line"))).alias("value")).write.text(path)
    return readers.read_strict_csv(spark, path, names).groupBy("status", "reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("src_2_jsonl", """SELECT CASE WHEN event_id % 13 = 0 THEN 'blank_line' WHEN event_id % 11 = 0 THEN 'json_invalid' WHEN event_id % 7 = 0 THEN 'columns_invalid' END AS reason_code, CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 7 <> 0 THEN event_type END AS event_type,
count(*) AS n, sum(CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 7 <> 0 THEN user_id END)::BIGINT AS users FROM events GROUP BY ALL""")
def _(spark, sf):
    path = fresh_dir(spark, "jsonl")
    i = F.col("event_id")
    line = F.to_json(F.struct("event_id", "event_type", F.struct("user_id", "value").alias("detail")))
    repeated = F.replace(line, F.lit('"event_type":'), F.lit('"event_type":"x","event_type":'))
    table(spark, sf, "events").select(F.when(i % 13 == 0, " ").when(i % 11 == 0, F.replace(line, F.lit('"event_id":'), F.lit('"event_id":"x",'))).when(i % 7 == 0, repeated).otherwise(line).alias("value")).write.text(path)
    rows = readers.read_jsonl(spark, path, T.StructType.fromDDL("event_id long, event_type string, detail struct<user_id: long, value: double>"))
    ok = F.col("reason_code").isNull()
    return rows.groupBy("reason_code", F.when(ok, F.col("event_type")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, F.col("detail.user_id"))).alias("users"))


@query("src_3_snapshots", "SELECT l_returnflag AS snapshot, count(*) AS n, count(*) AS expected, true AS ok FROM lineitem GROUP BY ALL")
def _(spark, sf):
    base = fresh_dir(spark, "snapshots")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    for flag in ("A", "N", "R"):
        rows.where(F.col("l_returnflag") == flag).write.parquet(f"{base}/{flag}.parquet")
    found = readers.read_snapshots(spark, [f"{base}/{flag}.parquet" for flag in ("A", "N", "R")], rows.schema)
    return readers.snapshot_counts(found, rows.groupBy(F.col("l_returnflag").alias("snapshot")).agg(F.count(F.lit(1)).alias("expected")))


@query("src_4_pruned_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")


@query("src_5_html_cards")
def _(spark, sf):
    return cards.extract_cards(table(spark, sf, "pages"))


#: What a vehicle card holds.
VEHICLE = cards.Selection((
    ("year", cards.data_field("year", pattern="[0-9]{4}")), ("make", cards.data_field("make")), ("trim", cards.data_field("trim", required=False)),
    ("currency", cards.data_field("price", "data-currency", pattern="[A-Z]{3}")), ("price", cards.data_field("price", pattern=r"[$][0-9,]+([.][0-9]{2})?")),
))


@query("src_5_vehicle_cards", """WITH k AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS site, unnest(CASE WHEN page_id % 13 = 12 THEN [0] WHEN page_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS position FROM pages),
c AS (SELECT *, (page_id + position) % 13 AS kind, page_id % 13 = 12 AS bare FROM k)
SELECT page_id, CAST(position AS INTEGER) AS position, CASE WHEN NOT bare AND kind <> 1 THEN 'L' || page_id || '-' || position END AS listing_id, CASE WHEN bare OR kind = 3 OR kind = 4 THEN NULL WHEN kind = 5 THEN '19x9' ELSE CAST(1990 + page_id % 30 AS VARCHAR) END AS year,
  CASE WHEN NOT bare THEN 'Brand & ' || page_id % 7 || ' fi' END AS make, CASE WHEN NOT bare AND kind % 2 = 0 THEN 'trim ' || kind END AS trim, CASE WHEN bare OR kind = 6 THEN NULL WHEN kind = 7 THEN 'usd' ELSE 'USD' END AS currency,
  CASE WHEN bare THEN NULL WHEN kind = 8 THEN 'call us' ELSE '$' || page_id || '.50' END AS price, CASE WHEN NOT bare AND kind <> 2 THEN site || '/v/' || page_id || '?p=' || position END AS url, CASE WHEN page_id % 3 = 0 THEN site || '/next/' || page_id END AS next_url,
  CASE WHEN bare THEN 'card_missing' WHEN kind = 1 THEN 'id_missing' WHEN kind = 2 THEN 'link_missing' WHEN kind = 3 THEN 'year_missing' WHEN kind = 4 THEN 'year_empty' WHEN kind = 5 THEN 'year_invalid' WHEN kind = 6 THEN 'currency_empty' WHEN kind = 7 THEN 'currency_invalid' WHEN kind = 8 THEN 'price_invalid' END AS reason_code FROM c""")
def _(spark, sf):
    """Every page with one or two vehicle cards after its own text, of which most kinds have a fault of their own; one page in thirteen has none."""
    pages = table(spark, sf, "pages")
    number, c = F.col("page_id").cast("string"), F.concat

    def planted(position: int):
        kind = F.pmod(F.col("page_id") + position, F.lit(13))
        unless = lambda k, text: F.when(kind == k, "").otherwise(text)
        year = F.when(kind == 3, "").when(kind == 4, "<b data-field=year> </b>").when(kind == 5, "<b data-field=year>19x9</b>").otherwise(c(F.lit("<b data-field=year>"), (F.pmod("page_id", F.lit(30)) + 1990).cast("string"), F.lit("</b>")))
        trim = F.when(kind % 2 == 0, c(F.lit("<i data-field='trim'>trim <u>"), kind.cast("string"), F.lit("</u></i>"))).otherwise("")
        price = c(F.lit("<span data-field=price "), unless(6, c(F.lit('data-currency="'), F.when(kind == 7, "usd").otherwise("USD"), F.lit('"'))), F.lit(">"), F.when(kind == 8, "call us").otherwise(c(F.lit("$"), number, F.lit(".50"))), F.lit("</span>"))
        link = unless(2, c(F.lit('<a class="big vehicle-card__link" href=" /v/'), number, F.lit(f'?p={position} ">see<br>it</a>')))
        return c(F.lit("<article class='card vehicle-card' "), unless(1, c(F.lit('data-listing-id=" L'), number, F.lit(f'-{position}"'))), F.lit(">"), year, F.lit("<h2 data-field=make>Brand &amp; <em>"), F.pmod("page_id", F.lit(7)).cast("string"), F.lit("</em>\n\ufb01</h2>"), trim, price, link, F.lit("</article>"))

    two = F.when(F.col("page_id") % 2 == 0, c(planted(0), planted(1))).otherwise(planted(0))
    following = F.when(F.col("page_id") % 3 == 0, c(F.lit("<a rel='nofollow next' href='/next/"), number, F.lit("'>more</a>"))).otherwise("<a rel=nextish href=/no>no</a>")
    html = c(F.coalesce("html", F.lit("")), F.when(F.pmod("page_id", F.lit(13)) == 12, "").otherwise(two), following)
    return cards.select_cards(pages.withColumn("html", html), VEHICLE)


@query("src_6_listing_conflicts", f"""WITH {LISTINGS}, f AS (SELECT *, first_value(row_id) OVER w AS r1, first_value(year) OVER w AS y1 FROM listings WINDOW w AS (PARTITION BY make, seller ORDER BY row_id))
SELECT CASE WHEN row_id = r1 THEN 'accepted' WHEN year = y1 THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def _(spark, sf):
    return dedupe.resolve_keyed(listings(spark, sf), ["make", "seller"], "year", F.col("row_id")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("snk_1_2_publish_and_verify", f"WITH {JUDGED} SELECT 'accepted' AS part, count(*) FILTER (reason_code IS NULL) AS n, true AS ok FROM judged UNION ALL SELECT 'rejected', count(*) FILTER (reason_code IS NOT NULL), true FROM judged")
def _(spark, sf):
    path = fresh_dir(spark, "published")
    judged = rules.with_reason(raw_listings(spark, sf), reason_rules())
    publish.publish(judged.where("reason_code is null"), judged.where("reason_code is not null").select("row_id", "reason_code"), path)
    return publish.verify_published(spark, path)


@query("snk_3_table_fingerprint", """WITH h AS (SELECT CAST('0x' || substr(sha256(concat_ws(chr(31), CAST(l_linenumber AS VARCHAR), CAST(l_orderkey AS VARCHAR), l_returnflag)), 1, 15) AS BIGINT) AS h FROM lineitem)
SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum, bit_xor(h) AS xor FROM h""")
def _(spark, sf):
    return integrity.table_fingerprint(table(spark, sf, "lineitem"), ["l_linenumber", "l_orderkey", "l_returnflag"])


@query("snk_4_long_report", f"""WITH {LISTINGS}, m AS (SELECT status AS label, count(*)::DOUBLE AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse FROM listings GROUP BY status)
SELECT label, metric, round(value, 4) AS value FROM m UNPIVOT (value FOR metric IN (n, mae, rmse))""")
def _(spark, sf):
    m = regression_metrics(scored(spark, sf), by=["status"]).withColumnRenamed("status", "label")
    return report_long(m, ["label"], ["n", "mae", "rmse"]).select("label", "metric", F.round("value", 4).alias("value"))


@query("snk_5_training_rows", f"WITH {LISTINGS} SELECT row_id, make, year, price FROM listings WHERE fold <> 0")
def _(spark, sf):
    rows = listings(spark, sf)
    assignment = rows.select("row_id", F.when(F.col("fold") == 0, "test").otherwise("train").alias("split")).distinct()
    return integrity.training_rows(rows, assignment, "row_id", "train", ["make", "year"], "price")


@query("snk_6_bounded_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 25")
def _(spark, sf):
    return dedupe.retain_latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 25).select("user_id", "event_id")


@query("snk_7_latest_k", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def _(spark, sf):
    return dedupe.retain_latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "event_type")


@query("prj_1_feature_contract", f"WITH {LISTINGS} SELECT make, model, year, status, mileage FROM listings")
def _(spark, sf):
    return CONTRACT.apply(listings(spark, sf).select("status", "mileage", "make", "year", "model", "price"))


@query("prj_2_target_contract", "SELECT count(*) FILTER (t IS NULL) AS n_null, count(*) FILTER (isnan(t) OR isinf(t)) AS n_not_finite, count(*) FILTER (t <= 0) AS n_not_positive FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 50 END AS t FROM events)")
def _(spark, sf):
    return rules.target_violations(table(spark, sf, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value") - 50).alias("t")), "t")


@query("prj_3_rejection_cascade", f"WITH {JUDGED} SELECT row_id, reason_code FROM judged")
def _(spark, sf):
    return rules.with_reason(raw_listings(spark, sf), reason_rules()).select("row_id", "reason_code")


def canonical(spark, sf):
    c = F.col
    return listings(spark, sf).select("row_id", F.when(c("seller") % 13 == 0, "CA").otherwise("US").alias("market_country"), F.lit("USD").alias("currency"), (c("year") + F.when(c("seller") % 17 == 0, 50).otherwise(0)).alias("year"), (c("price") * 100).cast("long").alias("price_cents"), "mileage", F.lower(F.when(c("seller") % 19 == 0, "sold").otherwise(c("status"))).alias("vehicle_status"), F.sha2("row_id", 256).alias("raw_content_sha256"), F.concat(F.lit("https://example.org/"), c("row_id")).alias("canonical_url"))


@query("prj_4_canonical_invariants", f"WITH {LISTINGS} SELECT row_id, CASE WHEN seller % 13 = 0 THEN 'country_invalid' WHEN seller % 17 = 0 THEN 'year_invalid' WHEN seller % 19 = 0 THEN 'status_invalid' END AS reason_code FROM listings")
def _(spark, sf):
    return rules.with_reason(canonical(spark, sf), rules.listing_rules()).select("row_id", "reason_code")


@query("prj_5_region_rules", f"WITH {RAW} SELECT row_id, CASE WHEN state IN ('ca', 'NY1') THEN 'state_invalid' WHEN state = 'ON' THEN 'market_not_us' END AS reason_code FROM raw")
def _(spark, sf):
    return rules.with_reason(raw_listings(spark, sf), rules.region_rules(F.col("state"), ["CA", "TX", "NY"])).select("row_id", "reason_code")


RANGES = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value - 20 END AS low, CASE WHEN event_id % 7 <> 0 THEN value + (event_id % 3 - 1) * 10 - 20 END AS high FROM events"


@query("prj_6_range_flags", f"""WITH r AS ({RANGES}) SELECT event_id, coalesce(low > 0 AND high > 0 AND low <= high, false) AS valid, low IS NULL AND high IS NULL AS both_missing, (low IS NULL) <> (high IS NULL) AS one_missing,
coalesce(low > high, false) AS inverted, coalesce(low = 0, false) OR coalesce(high = 0, false) AS zero, coalesce(low < 0, false) OR coalesce(high < 0, false) AS negative, coalesce(low = high, false) AS equal FROM r""")
def _(spark, sf):
    c = F.col
    r = table(spark, sf, "events").select("event_id", F.when(c("event_id") % 5 != 0, c("value") - 20).alias("low"), F.when(c("event_id") % 7 != 0, c("value") + (c("event_id") % 3 - 1) * 10 - 20).alias("high"))
    return r.select("event_id", *rules.range_flags(c("low"), c("high")))


@query("prj_7_permission_gate", f"WITH {LISTINGS} SELECT row_id, source = 'F' AND sold_on >= DATE '1996-01-01' AND sold_on < DATE '1998-01-01' AS approved FROM listings")
def _(spark, sf):
    grants = listings(spark, sf).where("source = 'F'").select("source").distinct().select("source", F.lit("training").alias("use"), F.lit("1996-01-01").cast("date").alias("granted_from"), F.lit("1998-01-01").cast("date").alias("granted_until"))
    return rules.gate_by_permission(listings(spark, sf), grants, "source", "training", F.col("sold_on")).select("row_id", "approved")


@query("prj_8_training_exclusions", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'price_kind_not_approved:' || event_type WHEN user_id % 9 = 0 THEN 'currency_not_approved:CAD' END AS reason FROM events")
def _(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", rules.training_exclusion(F.col("event_type"), F.when(F.col("user_id") % 9 == 0, "CAD").otherwise("USD"), ["view", "purchase"]).alias("reason"))


@query("prj_9_leakage_denylist", f"""WITH {LISTINGS} SELECT 'mmr' AS "column", 'an appraisal made after the sale' AS reason, false AS present, 0 AS "values" FROM listings GROUP BY ()
UNION ALL SELECT 'mileage', 'not allowed here', true, count(mileage) FROM listings UNION ALL SELECT 'seller', 'identifies the row', true, count(seller) FROM listings""")
def _(spark, sf):
    return rules.leakage_audit(listings(spark, sf), {"mileage": "not allowed here", "seller": "identifies the row", "mmr": "an appraisal made after the sale"})


@query("prj_10_sentinel_audit", f"""WITH {RAW} SELECT 'mileage' AS "column", count(*) FILTER (mileage = '-5') AS sentinel, count(*) FILTER (trim(mileage) = '') AS missing, count(*) FILTER (mileage <> '-5' AND trim(mileage) <> '') AS exposed FROM raw
UNION ALL SELECT 'brand', count(*) FILTER (brand = '-5'), count(*) FILTER (trim(brand) = ''), count(*) FILTER (brand <> '-5' AND trim(brand) <> '') FROM raw""")
def _(spark, sf):
    return rules.sentinel_audit(raw_listings(spark, sf), ["mileage", "brand"], "-5")


@query("prj_11_published_row_checks", f"""WITH {JUDGED}, k AS (SELECT private_key, count(*) AS n FROM judged GROUP BY 1), o AS (SELECT private_key AS k, lag(private_key) OVER (ORDER BY number) AS b FROM judged)
SELECT count(*) FILTER (state IS DISTINCT FROM 'CA') AS fixed_differs, count(*) FILTER (reason_code IS NOT NULL AND reason_code <> 'price_invalid') AS unknown_reasons, count(*) FILTER (k NOT BETWEEN 1 AND 14) AS out_of_bounds,
(SELECT CAST(sum(n - 1) AS BIGINT) FROM k) AS repeated_keys, (SELECT count(*) FILTER (k <= b) FROM o) AS not_increasing FROM judged""")
def _(spark, sf):
    return integrity.row_violations(rules.with_reason(raw_listings(spark, sf), reason_rules()), "private_key", {"state": "CA"}, ["price_invalid"], {"k": (1, 14)}, "number")


@query("prj_12_url_boundary", """WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(\\?[^#]*)?(#.*)?$', ['scheme', 'userinfo', 'host', 'port', 'path', 'query', 'fragment']) AS p FROM pages)
SELECT page_id, CASE WHEN p.scheme NOT IN ('http', 'https') THEN 'scheme' WHEN p.userinfo <> '' THEN 'userinfo' WHEN p.host NOT LIKE '%.example.com' AND p.host NOT LIKE '%.example.org' THEN 'host' WHEN p.port <> '' THEN 'port' WHEN p.fragment <> '' THEN 'fragment'
WHEN NOT starts_with(p.path, '/') OR p.path LIKE '%..%' THEN 'path' WHEN len(list_filter(list_transform(string_split(p.query[2:], '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> '' AND x <> 'page')) > 0 THEN 'query' END AS violation FROM u""")
def _(spark, sf):
    allowed = lambda host: host.endswith(".example.com") | host.endswith(".example.org")
    return table(spark, sf, "pages").select("page_id", rules.url_violation(F.col("url"), allowed, "/", ["page"]).alias("violation"))


@query("prj_13_provenance_equality", f"WITH {LISTINGS} SELECT row_id, CASE WHEN seller % 7 = 0 THEN 'policy' ELSE 'version' END AS differs FROM listings WHERE seller % 7 = 0 OR year = 1997")
def _(spark, sf):
    c = F.col
    rows = listings(spark, sf).select("row_id", c("source").alias("run_id"), F.when(c("seller") % 7 == 0, "other").otherwise("policy-1").alias("policy"), F.when(c("year") != 1997, "v1").alias("version"))
    runs = rows.select("run_id").distinct().select("run_id", F.lit("policy-1").alias("policy"), F.lit("v1").alias("version"))
    return rules.provenance_violations(rows, runs, ["policy", "version"]).select("row_id", "differs")


# Scalars over line items; the text under test is in the SQL.
def scalar(name: str, sql: str, **columns):
    """A query of scalar functions: ``columns`` maps a name to (input SQL, function)."""
    inputs = ", ".join(f"{text} AS x_{c}" for c, (text, _) in columns.items())

    @query(name, f"WITH t AS (SELECT l_orderkey, l_linenumber, {inputs} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql} FROM t")
    def _(spark, sf):
        rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{text} AS x_{c}" for c, (text, _) in columns.items()])
        return rows.select("l_orderkey", "l_linenumber", *[f(F.col(f"x_{c}")).alias(c) for c, (_, f) in columns.items()])


K = "((l_orderkey + l_linenumber) % 9)"
NUM = f"CASE WHEN {K} = 0 THEN '' WHEN {K} = 1 THEN 'n/a' WHEN {K} = 2 THEN '12.0' WHEN {K} = 3 THEN '1.5' WHEN {K} = 4 THEN '999999' WHEN {K} = 5 THEN '3 owners' WHEN {K} = 6 THEN '51,000 mi.' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END"
scalar("sca_1_normalize_text", f"CASE WHEN {K} < 4 THEN 'full width fi 1 é' ELSE trim(regexp_replace(x_v, '\\s+', ' ', 'g')) END AS v", v=(f"CASE WHEN {K} < 4 THEN ' ｆｕｌｌ\u3000ｗｉｄｔｈ  ﬁ ① e\u0301' ELSE concat('  a   ', CAST(l_linenumber AS STRING), '  b ') END", S.normalize_text))
scalar("sca_2_source_text", "CASE WHEN trim(x_v) <> '' AND length(trim(x_v)) <= 8 AND NOT starts_with(x_v, '=') THEN trim(x_v) END AS v, CASE WHEN trim(x_w) = '' OR length(trim(x_w)) > 8 THEN 'text_invalid' WHEN starts_with(x_w, '=') THEN 'csv_formula_injection' END AS w",
       v=(f"CASE WHEN {K} = 0 THEN ' ' WHEN {K} = 1 THEN '=1+1' WHEN {K} = 2 THEN 'far too long a text' ELSE ' abc ' END", lambda c: S.source_text(c, 8, True)["value"]), w=(f"CASE WHEN {K} = 0 THEN ' ' WHEN {K} = 1 THEN '=1+1' WHEN {K} = 2 THEN 'far too long a text' ELSE ' abc ' END", lambda c: S.source_text(c, 8, True)["reason"]))
scalar("sca_3_price_text", "CASE WHEN x_v IN ('', 'n/a', '12,34', 'EUR 100', '$250/mo', 'USD 5 USD') THEN NULL WHEN x_v = 'USD 12,345' THEN 1234500 ELSE CAST(replace(x_v[2:], ',', '') AS DECIMAL(18,2))::DOUBLE * 100 END::BIGINT AS v",
       v=(f"CASE WHEN {K} = 0 THEN '' WHEN {K} = 1 THEN 'n/a' WHEN {K} = 2 THEN '12,34' WHEN {K} = 3 THEN 'EUR 100' WHEN {K} = 4 THEN '$250/mo' WHEN {K} = 5 THEN 'USD 5 USD' WHEN {K} = 6 THEN 'USD 12,345' ELSE concat('$', CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING)) END", S.price_text_cents))
scalar("sca_4_numeric_price", "CASE WHEN x_v IN ('0', '12.345', 'x') THEN NULL ELSE CAST(CAST(x_v AS DECIMAL(18,2)) * 100 AS BIGINT) END AS v", v=(f"CASE WHEN {K} = 0 THEN '0' WHEN {K} = 1 THEN '12.345' WHEN {K} = 2 THEN 'x' WHEN {K} = 3 THEN '7.500' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END", S.decimal_cents))
scalar("sca_5_integral", "CASE WHEN regexp_full_match(x_v, '[0-9]+(\\.0+)?') THEN CAST(regexp_extract(x_v, '^[0-9]+') AS BIGINT) END AS v", v=(NUM, S.integral))
COUNT = f"CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '-5' WHEN 3 THEN '51 000 mi' WHEN 4 THEN '1.5' WHEN 5 THEN ' 3 Owners ' WHEN 6 THEN '51,000 mi.' WHEN 7 THEN '99999999999' WHEN 8 THEN '+1,2' WHEN 9 THEN 'five' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END"
COUNTED = "TRY_CAST(nullif(regexp_extract(regexp_replace(lower(x_{c}), '[,\\s]', '', 'g'), '^([+-]?[0-9]+)((mi|miles|owners?|accidents?)\\.?)?$', 1), '') AS INTEGER)"
scalar("sca_6_optional_int", f"{COUNTED.format(c='v')} AS v, lower(x_ok) IN ('', 'n/a') OR {COUNTED.format(c='ok')} IS NOT NULL AS ok", v=(COUNT, lambda c: S.optional_int(c)["value"]), ok=(COUNT, lambda c: S.optional_int(c)["valid"]))
scalar("sca_7_odometer", "CASE WHEN regexp_full_match(x_v, '[0-9]+(\\.0+)?') AND x_v <> '999999' THEN CAST(regexp_extract(x_v, '^[0-9]+') AS BIGINT) END AS v", v=(NUM, S.odometer))
scalar("sca_8_mileage_text", "CASE WHEN regexp_full_match(x_v, '[0-9]{1,3}(,[0-9]{3})* mi\\.') THEN CAST(regexp_extract(replace(x_v, ',', ''), '^[0-9]+') AS INTEGER) END AS v", v=(NUM, S.mileage_text))
scalar("sca_9_condition_grade", "CASE WHEN TRY_CAST(x_v AS DOUBLE) BETWEEN 1 AND 5 THEN TRY_CAST(x_v AS DOUBLE) WHEN TRY_CAST(x_v AS DOUBLE) BETWEEN 11 AND 49 AND TRY_CAST(x_v AS DOUBLE) = floor(TRY_CAST(x_v AS DOUBLE)) THEN TRY_CAST(x_v AS DOUBLE) / 10 END AS v", v=(NUM, lambda c: S.condition_grade(c).cast("double")))
SALE = f"CASE WHEN {K} = 0 THEN 'Tue Dec 16 2014 12:30:00 GMT-0800 (PST)' WHEN {K} = 1 THEN 'Wed Dec 16 2014 12:30:00 GMT-0800 (PST)' WHEN {K} = 2 THEN 'Tue Dec 16 2014 12:30:00 GMT-0700 (PST)' WHEN {K} = 3 THEN 'Mon Feb 30 2015 10:00:00 GMT-0700 (PDT)' WHEN {K} = 4 THEN 'x' ELSE 'Thu Jan 15 2015 01:00:00 GMT-0700 (MST)' END"
scalar("sca_10_sale_timestamp", "CASE WHEN x_v = 'Tue Dec 16 2014 12:30:00 GMT-0800 (PST)' THEN '2014-12-16 20:30:00' WHEN starts_with(x_v, 'Thu') THEN '2015-01-15 08:00:00' END AS v", v=(SALE, lambda c: S.sale_timestamp(c).cast("string")))
scalar("sca_11_sale_local_date", "CASE WHEN x_v LIKE '%Dec 16 2014%' THEN '2014-12-16' WHEN starts_with(x_v, 'Thu') THEN '2015-01-15' END AS v", v=(SALE, lambda c: S.sale_local_date(c).cast("string")))
scalar("sca_12_vin", "CASE WHEN regexp_full_match(upper(trim(x_v)), '[A-HJ-NPR-Z0-9]{17}') THEN upper(trim(x_v)) END AS v", v=(f"CASE WHEN {K} = 0 THEN 'NAN' WHEN {K} = 1 THEN '' WHEN {K} = 2 THEN 'iiiiiiiiiiiiiiiii' ELSE concat(' 1hgcm82633a00', lpad(CAST(l_orderkey % 10000 AS STRING), 4, '0')) END", S.vin))
scalar("sca_13_vehicle_status", "CASE WHEN lower(trim(x_v)) IN ('new', 'used') THEN lower(trim(x_v)) END AS v", v=(f"CASE WHEN {K} < 3 THEN ' NEW ' WHEN {K} < 6 THEN 'Used' ELSE 'sold' END", lambda c: S.closed_domain(c, ["new", "used"])))
scalar("sca_14_accident_status", "CASE WHEN x_v = 'None reported' THEN 'none' WHEN x_v LIKE 'At least%' THEN 'reported' END AS v", v=(f"CASE WHEN {K} < 3 THEN 'None reported' WHEN {K} < 6 THEN 'At least 1 accident or damage reported' ELSE '' END", S.accident_status))
scalar("sca_14_clean_title", "CASE WHEN lower(trim(x_v)) IN ('yes', 'clean') THEN 'clean' WHEN lower(trim(x_v)) IN ('no', 'not clean') THEN 'not_clean' WHEN x_v = '' THEN NULL ELSE 'unknown' END AS v", v=(f"CASE {K} WHEN 0 THEN 'Yes' WHEN 1 THEN ' CLEAN ' WHEN 2 THEN 'No' WHEN 3 THEN 'not clean' WHEN 4 THEN 'salvage' ELSE '' END", S.clean_title))
scalar("sca_15_derived_id", "coalesce(nullif(trim(x_v), ''), 'derived-' || substr(sha256('x'), 1, 24)) AS v", v=(f"CASE WHEN {K} < 3 THEN ' ' ELSE CAST(l_orderkey AS STRING) END", lambda c: S.derived_id(c, F.sha2(F.lit("x"), 256))))
scalar("sca_16_opaque_row_id", "sha256('source-1:' || CAST(x_v AS VARCHAR)) AS v", v=("l_orderkey", lambda c: S.opaque_row_id("source-1", c)))
scalar("sca_17_content_hash", "sha256(concat_ws(chr(31), coalesce(x_v, chr(0)), 'b')) AS v", v=(f"CASE WHEN {K} < 3 THEN NULL ELSE l_returnflag END", lambda c: S.content_hash(c, F.lit("b"))))
PADS = ["".join(f"\\x{x ^ mask:02X}" for x in b"salt".ljust(64, b"\0")) for mask in (0x36, 0x5C)]
scalar("sca_18_keyed_hash", f"sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || encode(CAST(x_v AS VARCHAR))))) AS v", v=("l_orderkey", lambda c: S.keyed_hash("salt", c)))
scalar("sca_19_canonical_url", "'https://example.org/' || replace(x_v, ' ', '%20') AS v", v=("concat('id ', l_returnflag)", lambda c: S.canonical_url(F.lit(""), "https://example.org/", c)))
scalar("sca_20_age_features", "greatest(1998 - x_age, 0) AS age, round(5000.0 / greatest(1998 - x_rate, 1), 6) AS rate", age=("CAST(year(l_shipdate) AS INT)", lambda c: S.age_years(c, 1998)), rate=("CAST(year(l_shipdate) AS INT)", lambda c: F.round(S.mileage_per_year(F.lit(5000), c, 1998), 6)))
scalar("sca_21_numeric_band", "CASE WHEN x_v IS NULL THEN 'missing' WHEN x_v <= 10 THEN 'low' WHEN x_v <= 30 THEN 'mid' ELSE 'high' END AS v", v=(f"CASE WHEN {K} > 0 THEN l_quantity END", lambda c: S.numeric_band(c, [10, 30], ["low", "mid", "high"])))
scalar("sca_22_interval_label", "CASE WHEN x_v BETWEEN 1 AND 10 THEN '(1, 10]' WHEN x_v > 10 AND x_v <= 40 THEN '(10, 40]' END AS v", v=("l_quantity", lambda c: S.interval_label(c, [1, 10, 40])))
scalar("sca_23_date_bucket", "CASE WHEN x_v >= DATE '1998-01-01' THEN 'late' WHEN x_v >= DATE '1996-01-01' THEN 'early' END AS v", v=("CAST(l_shipdate AS DATE)", lambda c: S.date_bucket(c, [("1996-01-01", "early"), ("1998-01-01", "late")])))
scalar("sca_24_missing_percent", "x_v IS NULL OR trim(x_v) = '' AS v, round(100.0::DOUBLE * x_p / 50, 6) AS p", v=(NUM, S.is_missing), p=("l_quantity", lambda c: S.percent(c, F.lit(50))))
scalar("sca_26_utc_date_zip", "CASE WHEN x_v = 'bad' THEN NULL ELSE '2020-01-02 03:04:05' END AS v, regexp_full_match(x_z, '[0-9]{5}') AS z", v=(f"CASE WHEN {K} < 4 THEN 'bad' ELSE '2020-01-02 03:04:05' END", lambda c: S.utc_or_null(c).cast("string")), z=(f"CASE WHEN {K} < 4 THEN '1234' ELSE '12345' END", S.zip_ok))
scalar("sca_27_scales", "round(1 + ln(1 + x_v / 10000), 9) AS v, least(greatest(x_c, 500), 50000) AS c", v=("l_extendedprice", lambda c: F.round(S.smooth_scale(c), 9)), c=("l_extendedprice", lambda c: S.clip(c, 500.0, 50000.0)))
scalar("sca_27_log_value", "round(ln(1 + greatest(x_v, 0) / 10000), 9) AS v", v=("l_extendedprice - 20000", lambda c: F.round(S.log_value(c), 9)))
scalar("sca_28_confidence_label", "CASE WHEN x_v <= 0.02 THEN 'high' WHEN x_v <= 0.06 THEN 'moderate' ELSE 'low' END AS v", v=("l_discount", lambda c: S.confidence_label(c, F.lit(1000), 0.02, 0.06)))
scalar("sca_29_quality_warnings", "array_to_string(list_filter([CASE WHEN x_v IS NULL THEN 'missing_mileage' END, CASE WHEN x_v > 300 THEN 'unsupported_combination' END], lambda w: w IS NOT NULL), ',') AS v", v=(f"CASE WHEN {K} > 2 THEN l_quantity * 10 END", lambda c: F.array_join(S.quality_warnings(c, F.lit(False), 300), ",")))
scalar("sca_30_online_features", "round(x_v / greatest(2000 - 1996, 1), 6) AS v, CASE WHEN x_f IS NULL THEN '1' ELSE '0' END AS f", v=("l_quantity", lambda c: F.round(S.online_features(F.lit(1996), c, F.lit("x"), F.lit(1), 2000)["mileage_per_year"], 6)), f=(f"CASE WHEN {K} > 2 THEN l_linenumber END", lambda c: S.online_features(F.lit(1996), F.lit(1), F.lit("x"), c, 2000)["owner_count_missing"]))
scalar("sca_31_identifiers", "regexp_full_match(x_v, '[A-Za-z0-9][A-Za-z0-9._:\\-]{0,127}') AS v, CASE WHEN regexp_full_match(lower(x_h), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN sha256(lower(x_h)) END AS h", v=(NUM, S.identifier_ok), h=(f"CASE WHEN {K} < 5 THEN '0F8FAD5B-D9CB-469F-A165-70867728950E' ELSE 'me' END", S.client_hash))


@query("sca_25_json_flags", """WITH f AS (SELECT CASE WHEN event_id % 4 = 0 THEN '["clean","one_owner"]' WHEN event_id % 4 = 1 THEN '{"a":1}' WHEN event_id % 4 = 2 THEN 'not-json' ELSE '' END AS x FROM events)
SELECT CASE WHEN x = '' THEN NULL WHEN x LIKE '[%' THEN 'array' WHEN x LIKE '{%' THEN 'not_array' ELSE 'invalid' END AS kind, count(*) AS n FROM f GROUP BY 1""")
def _(spark, sf):
    i = F.col("event_id") % 4
    text = F.when(i == 0, '["clean","one_owner"]').when(i == 1, '{"a":1}').when(i == 2, "not-json").otherwise("")
    return table(spark, sf, "events").select(S.json_kind(text).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def deduped(spark, sf):
    rows = raw_listings(spark, sf).select("row_id", "brand", "year", "status", "mileage", "price", "model")
    judged = rules.with_reason(rows, reason_rules())
    return dedupe.mark_duplicates(judged, ["brand", "year", "status"], F.col("row_id"), F.col("reason_code").isNull())


DEDUPED = JUDGED + ", deduped AS (SELECT *, reason_code IS NULL AND row_number() OVER (PARTITION BY reason_code IS NULL, brand, year, status ORDER BY row_id) > 1 AS is_duplicate FROM judged)"


@query("dup_1_exact_first_wins", f"WITH {DEDUPED} SELECT row_id, is_duplicate FROM deduped")
def _(spark, sf):
    return deduped(spark, sf).select("row_id", "is_duplicate")


@query("dup_2_keyed_conflicts", f"""WITH {LISTINGS}, f AS (SELECT *, first_value(row_id) OVER w AS r1, first_value(status) OVER w AS s1 FROM listings WINDOW w AS (PARTITION BY private_key ORDER BY row_id))
SELECT row_id, CASE WHEN row_id = r1 THEN 'accepted' WHEN status = s1 THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f""")
def _(spark, sf):
    return dedupe.resolve_keyed(listings(spark, sf), ["private_key"], "status", F.col("row_id")).select("row_id", "outcome")


@query("dup_2_null_keys", f"""WITH {LISTINGS}, f AS (SELECT *, first_value(row_id) OVER w AS r1, first_value(mileage) OVER w AS m1 FROM listings WINDOW w AS (PARTITION BY CASE WHEN mileage IS NOT NULL THEN seller END, status ORDER BY row_id))
SELECT row_id, CASE WHEN row_id = r1 THEN 'accepted' WHEN mileage IS NOT DISTINCT FROM m1 THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f""")
def _(spark, sf):
    """Listings without a mileage have no seller either: their key is null, and so is what they are compared by."""
    rows = listings(spark, sf).withColumn("key", F.when(F.col("mileage").isNotNull(), F.col("seller")))
    return dedupe.resolve_keyed(rows, ["key", "status"], "mileage", F.col("row_id")).select("row_id", "outcome")


@query("dup_3_content_hash", f"WITH {LISTINGS} SELECT min(row_id) AS row_id FROM listings GROUP BY make, year, status")
def _(spark, sf):
    return dedupe.mark_duplicates(listings(spark, sf), ["make", "year", "status"], F.col("row_id")).where(~F.col("is_duplicate")).select("row_id")


@query("dup_4_accounting", f"""WITH {DEDUPED}, r AS (SELECT status, string_agg(reason_code || '=' || n, ',' ORDER BY reason_code) AS by_reason FROM (SELECT status, reason_code, count(*) AS n FROM deduped WHERE reason_code IS NOT NULL GROUP BY ALL) GROUP BY 1),
p AS (SELECT *, CASE WHEN reason_code IS NULL AND NOT is_duplicate THEN CAST(CAST(price AS DECIMAL(18,2)) * 100 AS BIGINT) END AS cents FROM deduped)
SELECT status, count(*) AS seen, count(*) FILTER (reason_code IS NULL AND NOT is_duplicate) AS accepted, count(*) FILTER (reason_code IS NOT NULL) AS rejected, count(*) FILTER (reason_code IS NULL AND is_duplicate) AS duplicates,
any_value(by_reason) AS by_reason, min(cents) AS min_cents, max(cents) AS max_cents, true AS balanced FROM p LEFT JOIN r USING (status) GROUP BY status""")
def _(spark, sf):
    found = dedupe.accounting(deduped(spark, sf), by=["status"], ranges={"cents": S.decimal_cents(F.col("price"))})
    return found.withColumn("by_reason", F.nullif(F.array_join(F.transform(F.map_entries("by_reason"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), F.lit("")))


@query("dup_5_repeated_keys", "WITH k AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_orderkey END AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(coalesce(sum(n - 1) FILTER (k IS NOT NULL), 0) AS BIGINT) AS beyond_first, count(*) FILTER (k IS NOT NULL AND n > 1) AS repeated_keys, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS invalid_keys FROM k")
def _(spark, sf):
    return dedupe.repeat_stats(table(spark, sf, "lineitem"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_orderkey")))


@query("dup_6_duplicate_masks", "WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag) SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_sets, CAST(sum(n - 1) AS BIGINT) AS beyond_first FROM k")
def _(spark, sf):
    return dedupe.duplicate_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("sca_25_flag_counts", """WITH f AS (SELECT CASE WHEN event_id % 4 = 0 THEN ['clean', 'one_owner'] WHEN event_id % 4 = 3 THEN ['clean', 'use ' || event_type, 'clean'] ELSE [] END AS x FROM events)
SELECT flag, count(*) AS n FROM (SELECT unnest(x) AS flag FROM f) GROUP BY 1""")
def _(spark, sf):
    """Flags of all valid arrays, counted as often as they occur."""
    i = F.col("event_id") % 4
    text = F.when(i == 0, '["clean","one_owner"]').when(i == 1, '{"a":1}').when(i == 2, "not-json").otherwise(F.concat(F.lit('["clean", "use '), "event_type", F.lit('", "clean"]')))
    return table(spark, sf, "events").select(F.explode(S.json_flags(text)).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
