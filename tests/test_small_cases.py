"""Hand-computed and invariance cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.operators import conformal, dedupe, evaluate, integrity, mixing, models, profile, relate, rules, splits
from kerbside.schema import LISTING_SCHEMA, FeatureContract, assert_schema
from kerbside.sources import cards, publish, readers
from kerbside.streaming import keyed, outcomes


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


@pytest.mark.parametrize(
    ("text", "cents"), [("$12,345.50", 1234550), ("USD 12,345", 1234500), ("12345 USD", 1234500), ("USD 1 USD", None), ("$12,34", None), ("$5.123", None), ("EUR 5", None), ("$250/mo", None), ("", None), (None, None), ("0", None)]
)
def test_price_text(spark, text, cents):
    assert one(spark, text).select(S.price_text_cents(F.col("v"))).first()[0] == cents


def test_scalars_on_odd_text(spark):
    rows = spark.createDataFrame([("ａ b  c",), ("=1",), ("-",), (None,), ("x" * 300,)], "v string")
    assert [r[0] for r in rows.select(S.normalize_text(F.col("v"))).collect()][0] == "a b c"
    assert [r[0] for r in rows.select(S.source_text(F.col("v"), 100, True)["reason"]).collect()][1:] == ["csv_formula_injection", None, "text_invalid", "text_invalid"]


def test_sale_time(spark):
    good = "Tue Dec 16 2014 12:30:00 GMT-0800 (PST)"
    rows = spark.createDataFrame([(good,), (good.replace("Tue", "Wed"),), (good.replace("PST", "EST"),), (good.replace("12:30", "24:30"),), (good.replace("Dec 16", "Feb 30"),)], "v string")
    assert [r[0] for r in rows.select(S.sale_timestamp(F.col("v")).cast("string")).collect()] == ["2014-12-16 20:30:00", None, None, None, None]


def test_bands_take_the_lower_side(spark):
    rows = spark.createDataFrame([(8995.0,), (8995.01,), (None,)], "v double")
    assert [r[0] for r in rows.select(S.numeric_band(F.col("v"), [8995, 19995], ["a", "b", "c"])).collect()] == ["a", "b", "missing"]


def test_contract(spark):
    contract = FeatureContract(("a",), ("b",))
    df = spark.createDataFrame([(1, 2, 3.0)], "b int, a int, price double")
    assert contract.apply(df).columns == ["a", "b"]
    with pytest.raises(ValueError, match="outside"):
        contract.apply(df.withColumn("z", F.lit(1)))
    with pytest.raises(ValueError, match="missing"):
        contract.apply(df.select("b"))
    with pytest.raises(ValueError, match="schema differs"):
        assert_schema(df, LISTING_SCHEMA)


def test_first_failure_wins_and_null_passes(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (9, 9)], "a int, b int")
    found = rules.with_reason(df, [("a", F.col("a") > 5), ("b", F.col("b") > 4)])
    assert [r.reason_code for r in found.collect()] == [None, "b", "a"]


def test_two_dedupe_orders(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "bad"), (3, "x", None), (4, None, None), (5, None, None)], "n int, v string, reason_code string")
    after = dedupe.mark_duplicates(df, ["v"], F.col("n"), F.col("reason_code").isNull())
    before = dedupe.mark_duplicates(df, ["v"], F.col("n"))
    assert sorted(r.n for r in after.where("is_duplicate").collect()) == [3, 5]
    assert sorted(r.n for r in before.where("is_duplicate").collect()) == [2, 3, 5]
    assert dedupe.accounting(after).first().asDict() == {"seen": 5, "accepted": 2, "rejected": 1, "duplicates": 2, "by_reason": {"bad": 1}, "balanced": True}


def test_closest_prefix_ties_take_the_smaller(spark):
    # Two groups of two rows: prefixes 0, 2, 4 against 1 of 4: 0 and 2 are equally close, the empty one wins.
    df = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "b")], "s string, g string")
    assert splits.closest_prefix_groups(df, ["g"], "s", 1, 4, "x").where("selected").count() == 0
    assert splits.closest_prefix_groups(df, ["g"], "s", 1, 2, "x").where("selected").count() == 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_splits_do_not_depend_on_partitioning(spark, partitions):
    rows = [(f"g{i % 40}", f"s{i % 3}", i) for i in range(500)]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, s string, n int").repartition(partitions)
    found = splits.closest_prefix_split(df, ["g"], "s", 1, 5, "x").select("n", "selected")
    assert integrity.table_fingerprint(found).first()["sum"] == integrity.table_fingerprint(splits.closest_prefix_split(df.coalesce(1).orderBy("n"), ["g"], "s", 1, 5, "x").select("n", "selected")).first()["sum"]
    assert relate.mixed_groups(splits.closest_prefix_split(df, ["g"], "s", 1, 5, "x").withColumn("part", F.col("selected").cast("int")), "g", "part").where("g is null").count() == 0


def test_kfold_is_balanced_and_whole(spark):
    df = spark.createDataFrame([(i % 97,) for i in range(3000)], "g int")
    sizes = [r.n for r in splits.group_kfold(df, "g", 5).groupBy("fold").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 3000 and max(sizes) - min(sizes) <= 62


def test_chronological_promotion(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2014, 1, 1)), ("a", d(2016, 1, 1)), ("b", d(2014, 1, 1)), ("c", d(2015, 6, 1))], "k string, day date")
    found = {(r.k, r.day.year): (r.split, r.promoted) for r in splits.chrono_group_split(df, "k", "day", "2015-06-01").collect()}
    assert found == {("a", 2014): ("test", True), ("a", 2016): ("test", False), ("b", 2014): ("train", False), ("c", 2015): ("test", False)}


def test_nested_samples(spark):
    df = spark.createDataFrame([(i, f"s{i % 7}" if i % 3 else "big") for i in range(700)], "id int, s string")
    strata = df.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    small = splits.proportional_quotas(strata, "s", 50)
    large = splits.nested_quotas(small.withColumnRenamed("quota", "minimum"), "s", 200, "minimum")
    a, b = splits.stratified_sample(df, "id", "s", small, "x"), splits.stratified_sample(df, "id", "s", large, "x")
    assert (a.count(), b.count(), relate.not_in(a, b, "id").count()) == (50, 200, 0)
    with pytest.raises(ValueError, match="target"):
        splits.proportional_quotas(strata, "s", 701)


def test_three_null_rules(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "y int, m int")
    b = spark.createDataFrame([(1, None)], "y int, m int")
    assert [r.y for r in relate.anti_collisions(a, b, ["y", "m"]).collect()] == [2]
    assert relate.collision_report(a, b, ["y", "m"]).first().asDict() == {"left_keys": 1, "right_keys": 0, "shared_keys": 0}
    changed = spark.createDataFrame([("i", "s1", None), ("i", "s2", 4)], "id string, snap string, v int")
    assert profile.repetition_audit(changed, "id", "snap", ["v"]).first()["changed_ids"] == 1


def test_metrics_without_variance(spark):
    df = spark.createDataFrame([(5.0, 7.0), (5.0, 4.0)], "y double, p double")
    row = evaluate.regression_metrics(df).first()
    assert (row.mae, row.rmse, row.r2) == (1.5, pytest.approx(math.sqrt(2.5)), None)
    assert evaluate.regression_metrics(df.limit(0)).first().mae is None
    assert evaluate.combine_metrics(spark.createDataFrame([(2, 0.0, 0.0)], "n int, mae double, rmse double"), F.lit(0.0)).first().r2 == 1.0


def test_average_ranks(spark):
    found = {r.v: r["rank"] for r in evaluate.average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double"), "v").collect()}
    assert found == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


@pytest.mark.parametrize(("n", "c"), [(9, 0.9), (10, 0.9), (100, 0.95), (3, 0.9), (1, 0.8)])
def test_order_statistic(spark, n, c):
    values = random.Random(n).choices([0.0, 1.0, 2.5, 1e6, 1e-9, 7.0, 8.0, 8.000001], k=n)
    k = math.ceil((n + 1) * c)
    got = conformal.order_stats(spark.createDataFrame([("a", v) for v in values], "g string, s double"), "s", ["g"], (c,)).first()
    assert (got.support, got.radius) == (n, sorted(values)[k - 1] if k <= n else None)


def test_interval_clipping(spark):
    df = spark.createDataFrame([("a", 5.0, -20.0)], "g string, y double, p double")
    radii = spark.createDataFrame([("global", "", 0.9, 10, 8.0)], "level string, key string, coverage double, support int, radius double")
    apply = lambda clip: conformal.apply_intervals(df, radii, [("g", ["g"]), ("global", [])], 0.9, clip_upper=clip).first()
    assert (apply(False).lower, apply(False).upper, apply(False).method, apply(False).fallback) == (0.0, -12.0, "global", True)
    assert apply(True).upper == 0.0


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "source string")
    totals = {r.source: r.t for r in mixing.source_weights(df, "source").groupBy("source").agg(F.round(F.sum("weight"), 9).alias("t")).collect()}
    assert totals == {"a": 20.0, "b": 20.0}


def test_median_baseline_never_sees_its_fold(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 10.0), (1, 20.0)], "fold int, y double")
    found = {(r.fold, r.p) for r in models.median_baseline(df, "fold", 2, "y").collect()}
    assert found == {(0, 15.0), (1, 1.5)}


def test_adwin_finds_a_jump_and_no_other():
    rng = random.Random(3)
    steady = keyed.Adwin()
    assert sum(steady.add(rng.random()) for _ in range(4000)) == 0
    jump = keyed.Adwin()
    hits = [i for i in range(4000) if jump.add(rng.random() + (i >= 2000) * 1.5)]
    assert hits and 2000 <= hits[0] < 2200 and jump.n < 2600


def test_online_learner_improves():
    model, early, late = keyed.OnlineLinear(), 0.0, 0.0
    rng = random.Random(1)
    for i in range(2000):
        x = rng.random()
        y = 3 * x + 1
        error = abs(model.predict({"x": x}, {}) - y)
        early, late = early + error * (i < 100), late + error * (i >= 1900)
        model.learn({"x": x}, {}, y)
    assert late < early / 5


def test_matcher_reasons(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    p = spark.createDataFrame([("e1", "view", t(5), 1.0), ("e1", "view", t(6), 9.0), ("e2", "click", t(5), 1.0), ("e3", "view", t(5), 1.0)], "event_id string, source_id string, observed_at timestamp, prediction double")
    o = spark.createDataFrame(
        [("o1", "e1", "view", t(7), 3.0), ("o2", "e1", "view", t(8), 3.0), ("o1", "e3", "view", t(9), 3.0), ("o4", "e2", "view", t(7), 3.0), ("o5", "e2", "click", t(7), 3.0), ("o6", "zz", "view", t(7), 3.0), ("o7", "e3", "view", t(4), 3.0), ("o8", "e3", "view", t(7), float("nan")), ("o9", "e3", "view", t(8), None)],
        "outcome_id string, event_id string, source_id string, occurred_at timestamp, target double",
    )
    found = {(r.outcome_id, r.event_id): r.reason_code for r in outcomes.match_outcomes(p, o, ["view"]).collect()}
    assert found == {("o1", "e1"): None, ("o2", "e1"): "duplicate_outcome", ("o1", "e3"): "duplicate_outcome", ("o4", "e2"): "source_mismatch", ("o5", "e2"): "source_not_approved", ("o6", "zz"): "event_not_found", ("o7", "e3"): "outcome_before_prediction", ("o8", "e3"): "invalid_target", ("o9", "e3"): "invalid_target"}


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16"])
def test_strict_csv(spark, tmp_path, encoding):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n3\n4,5,6\n", encoding=encoding)
    rows = readers.read_strict_csv(spark, f"file://{path}", ["a", "b"], encoding)
    assert [r.reason_code for r in rows.collect()] == [None, "row_width_invalid", "row_width_invalid"]
    with pytest.raises(ValueError, match="header"):
        readers.read_strict_csv(spark, f"file://{path}", ["a", "c"], encoding)


def test_tampering_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    publish.publish(spark.createDataFrame([(1, "a"), (2, "b")], "n int, v string"), spark.createDataFrame([(3, "x")], "n int, reason_code string"), path)
    assert all(r.ok for r in publish.verify_published(spark, path).collect())
    spark.createDataFrame([(9, "c")], "n int, v string").write.mode("append").parquet(f"{path}/accepted")
    assert {r.part: r.ok for r in publish.verify_published(spark, path).collect()} == {"accepted": False, "rejected": True}


def test_cards(spark):
    pages = spark.createDataFrame([(1, "<article><h1>A &amp; B</h1></article><article></article>"), (2, None), (3, "<p>no card")], "page_id long, html string")
    found = sorted((r.page_id, r.position, r.title, r.reason_code) for r in cards.extract_cards(pages).collect())
    assert [x[3] for x in found] == [None, "card_invalid", "card_missing", "card_missing"] and found[0][2] == "A & B"


def test_url_boundary_allows_every_host(spark, tmp_path):
    from kerbside.plans import registry

    host = F.concat(F.lit("h"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".example.com").when(F.col("id") % 100 == 1, ".example.net").otherwise(".example.org"))
    spark.range(120_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/a")).alias("url")).write.parquet(f"file://{tmp_path}/pages.parquet")
    found = registry.queries()["prj_12_url_boundary"](spark, f"file://{tmp_path}").groupBy("violation").count().collect()
    assert {r["violation"]: r["count"] for r in found} == {None: 118_800, "host": 1_200}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "row_id string, g string, s string, y double, p double, score double, fold int")
    assert splits.closest_prefix_split(df, ["g"], "s", 1, 5, "x").count() == 0
    assert splits.group_kfold(df, "g", 5).count() == 0
    assert conformal.order_stats(df, "score", ["s"]).count() == 0
    assert conformal.fit_hierarchy(df, {"s": ["s"], "global": []}, "score").count() == 0
    assert evaluate.average_ranks(df, "y").count() == 0
    assert dedupe.mark_duplicates(df, ["g"], F.col("row_id")).count() == 0


def test_screening_sample_keeps_every_stratum(spark):
    rows = [("a", f"g{k}", k) for k in range(20)] + [(None, f"g{k}", k) for k in range(20)]
    df = spark.createDataFrame(rows, "s string, g string, k int")
    found = {tuple(r) for r in splits.screening_sample(df, ["g"], "s", 3, 10, "x").collect()}
    assert found == {tuple(r) for r in splits.closest_prefix_groups(df, ["g"], "s", 3, 10, "x").collect()}
    assert sorted((s or "", chosen) for s, _, _, chosen in found).count(("", True)) == 6
    lone = df.union(spark.createDataFrame([("b", "one", 1), ("b", "one", 2)], df.schema))
    with pytest.raises(ValueError, match="1 strata would be empty, such as 'b'"):
        splits.screening_sample(lone, ["g"], "s", 3, 10, "x")
    with pytest.raises(ValueError, match="proper fraction"):
        splits.screening_sample(df, ["g"], "s", 10, 10, "x")
    assert splits.screening_sample(df.limit(0), ["g"], "s", 3, 10, "x").count() == 0


def test_deciles_put_a_value_on_an_edge_above_or_below(spark):
    values = [1.0] * 5 + [2.0] * 5 + [float(x) for x in range(3, 13)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    known = [x for x in values if x is not None]
    edges = np.quantile(known, np.linspace(0, 1, 11))
    above = dict(zip(range(len(known)), 1 + np.searchsorted(np.unique(edges)[1:-1], known, side="right")))
    below = dict(zip(range(len(known)), 1 + np.searchsorted(edges[1:-1], known, side="left")))
    assert {r["i"]: r["decile"] for r in splits.value_decile(df, "x", upper=True).collect()} == above | {len(known): None}
    assert {r["i"]: r["decile"] for r in splits.value_decile(df, "x").collect()} == below | {len(known): None}


def test_gate_metrics_sum_rows_once(spark):
    """rows are summed once and not copied for the median; a truth that is missing counts as a row, not as a miss of a slice."""
    from statistics import mean, median

    from kerbside import staging

    rows = [(m, "ab"[i % 2], None if i % 5 == 4 else f"s{i % 3}", None if i == 7 else float(i), float(i - i % 4 + 1), float(i - i % 4 + 2 + (m == "y")), i % 6 == 0) for m in "xy" for i in range(40)]
    df = staging.written(spark.createDataFrame(rows, "method string, make string, status string, y double, lower double, upper double, fallback boolean"), "gates-test")
    since = staging.mark()
    found = {r.method: r for r in conformal.gate_metrics(df, 0.9, ["make", "status"], "y", 30.0, 5, stored=True).collect()}
    made = [path.rsplit("/", 1)[-1] for path in staging._made[since:]]
    assert any(name.startswith("kerbside-gate-parts-") for name in made) and not any(name.startswith("kerbside-values-") for name in made)
    for m in "xy":
        mine = [r for r in rows if r[0] == m]
        hit = lambda rs: mean(r[4] <= r[3] <= r[5] for r in rs if r[3] is not None)
        slices = [[r for r in mine if r[k] == v] for k in (1, 2) for v in {r[k] for r in mine}]
        share = lambda f: sum(r[3] is not None and f(r) for r in mine) / len(mine)
        want = (
            share(lambda r: r[4] <= r[3] <= r[5]) - 0.9, max(abs(hit(s) - 0.9) for s in slices if len(s) >= 5), 0.9 - hit([r for r in mine if r[3] is not None and r[3] >= 30]), abs(share(lambda r: r[3] < r[4]) - share(lambda r: r[3] > r[5])),
            mean(r[6] for r in mine), 0, mean(r[5] - r[4] for r in mine), median(r[5] - r[4] for r in mine),
        )
        assert [round(v, 9) for v in found[m][1:]] == [round(float(v), 9) for v in want]


def test_a_batch_of_pages_is_passed_on_in_parts():
    """a worker holds few pages' texts and rows, whatever the batch."""
    import pyarrow as pa

    read, batch = [], pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": ["<p>"] * 999 + [None]})

    def rows(page, html):
        read.append(html)
        return [(page, html)] * (page % 3)

    found = cards._parts(iter([batch, batch.slice(0, 0)]), rows, pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    first = next(found)
    assert len(read) == cards.PART < 300 and first.num_rows == sum(k % 3 for k in range(cards.PART))
    assert first.num_rows + sum(b.num_rows for b in found) == sum(k % 3 for k in range(1000)) and read[-1] is None


def test_flagship_holds_listings_without_texts(spark, monkeypatch):
    from kerbside.plans import learning
    from kerbside.staging import written

    held = {}

    def watched(df, label):
        held[label] = df.dtypes
        return written(df, label)

    monkeypatch.setattr(learning, "written", watched)
    assert learning.flagship(spark, "/root/testdata/sf0.001").count() == 4
    assert dict(held["flagship"]).keys() == {"kind", "code", "price"} and "string" not in dict(held["flagship"]).values()
