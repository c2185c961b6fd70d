"""Quantiles, running sums, ranks and lookups against plain Python, on odd values and hot groups."""

import datetime as dt
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import conformal, dedupe, integrity, mixing, models, profile, relate, rules, splits
from kerbside.operators.quantiles import quantiles, running_sums, values_at
from kerbside.plans import registry
from kerbside.plans.bindings import listings
from kerbside.sources import readers
from kerbside.staging import fresh_dir, release, shared_dir, written
from kerbside.streaming import keyed, outcomes
from kerbside.streaming.runs import rocksdb

SF = "/root/testdata/sf0.001"


def test_quantiles_of_odd_values(spark):
    rng = random.Random(1)
    pool = [0.0, -0.0, 1.0, 1.0000001, -7.5, 1e-300, -1e300, 3e8, 2.0, 2.0, 2.0, 5e-324]
    rows = [(rng.choice(["a", "b", None, "hot", "hot"]), rng.choice([*pool, rng.gauss(0, 50), rng.random() + 100])) for _ in range(4000)]
    rows += [("none", None), ("none", float("nan")), ("a", None), ("b", float("inf")), ("one", 4.0)]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), {"q": F.col("v")}, probs, ["g"]).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and math.isfinite(v):
            groups[g].append(v)
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12), g
    assert [r.q for r in quantiles(spark.createDataFrame([], "v double"), {"q": F.col("v")}, [0.5]).collect()] == [None]
    assert quantiles(spark.createDataFrame([], "g string, v double"), {"q": F.col("v")}, [0.5], ["g"]).count() == 0
    counted = spark.createDataFrame([("x", 1.0, 3), ("x", 2.0, 1), ("x", 9.0, 1)], "g string, v double, n long")
    assert quantiles(counted, {"q": F.col("v")}, [0.5, 0.75], ["g"], "n").first().q == [1.0, 2.0]
    assert values_at(counted, F.col("v"), [], lambda n: F.array(F.lit(0), F.lit(1), n, n + 1)).first()["values"] == [None, 1.0, 9.0, None]


def test_running_sums_and_rolling(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(0, 99), rng.randint(0, 99), 50) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at int, y long, p long, static long").repartition(5)
    run = {(r.g, r.at): (r["rank"], r.total) for r in running_sums(df, ["g"], [F.col("at")], {"total": F.col("y")}).collect()}
    roll = {(r.g, r.at): (r.rolling_n, r.rolling_mae) for r in outcomes.rolling_last_n(df.where("g is not null"), "g", ["at"], 7).collect()}
    pre = {(r.g, r.at): (r.n, r.mae, r.rmse, r.mae_delta) for r in outcomes.prequential(df, "g", ["at"]).collect()}
    seen = defaultdict(list)
    for g, at, y, p, static in sorted(rows, key=lambda r: r[1]):
        seen[g].append((y, p, static))
        errors = [abs(b - a) for a, b, _ in seen[g]]
        assert run[g, at] == (len(errors), sum(a for a, _, _ in seen[g]))
        assert pre[g, at] == pytest.approx((len(errors), sum(errors) / len(errors), math.sqrt(sum(e * e for e in errors) / len(errors)), sum(errors) / len(errors) - sum(abs(c - a) for a, _, c in seen[g]) / len(errors)))
        if g is not None:
            assert roll[g, at] == pytest.approx((min(7, len(errors)), sum(errors[-7:]) / min(7, len(errors))))


def test_keys_that_do_not_increase(spark):
    rng = random.Random(3)
    keys = [i + (rng.random() < 0.05) * rng.randint(-9, 9) for i in range(2000)]
    df = spark.createDataFrame([(k, o, None) for o, k in enumerate(keys)], "k long, o long, reason_code string").repartition(6)
    found = integrity.row_violations(df, "k", {}, [], {"k": (0, 1500)}, "o").first()
    assert found.not_increasing == sum(b <= a for a, b in zip(keys, keys[1:]))
    assert found.out_of_bounds == sum(not 0 <= k <= 1500 for k in keys) and found.repeated_keys == len(keys) - len(set(keys))


@pytest.mark.parametrize("seed", range(4))
def test_nested_quotas_go_round_by_round(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{i:02}", rng.randint(1, 60)) for i in range(25)]
    rows = [(k, n, rng.randint(0, n) if rng.random() < 0.6 else 0) for k, n in rows]
    total, least = sum(n for _, n, _ in rows), sum(m for *_, m in rows)
    target = rng.randint(least, total)
    quotas = {k: n * target // total for k, n, _ in rows}
    for k, *_ in sorted(rows, key=lambda r: (-(r[1] * target % total), r[0]))[: target - sum(quotas.values())]:
        quotas[k] += 1
    quotas = {k: max(quotas[k], m) for k, _, m in rows}
    while (excess := sum(quotas.values()) - target) > 0:
        for k, _, m in sorted((r for r in rows if quotas[r[0]] > r[2]), key=lambda r: (r[1] * target % total, r[0]))[:excess]:
            quotas[k] -= 1
    found = splits.nested_quotas(spark.createDataFrame(rows, "k string, n long, m long"), "k", target, "m")
    assert {r.k: r.quota for r in found.collect()} == quotas
    with pytest.raises(ValueError, match="minimum"):
        splits.nested_quotas(spark.createDataFrame(rows, "k string, n long, m long"), "k", max(0, least - 1), "m") if least else splits.proportional_quotas(spark.createDataFrame(rows, "k string, n long, m long"), "k", -1)


def test_lookup_falls_back_level_by_level(spark):
    table = spark.createDataFrame([("ab", "x|1", 1.0, 5), ("ab", "missing|2", 2.0, 6), ("a", "y", 3.0, 7), ("a", "z", None, 8), ("all", "", 4.0, 9)], "level string, key string, v double, n int")
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 2), ("y", 9), ("z", 1)], "a string, b int")
    found = relate.lookup_with_fallback(rows, table, [("ab", ["a", "b"]), ("a", ["a"]), ("all", [])], "v", "n")
    assert {(r.a, r.b): (r.v, r.n, r["method"]) for r in found.collect()} == {("x", 1): (1.0, 5, "ab"), ("x", 2): (4.0, 9, "all"), (None, 2): (2.0, 6, "ab"), ("y", 9): (3.0, 7, "a"), ("z", 1): (4.0, 9, "all")}
    assert relate.lookup_with_fallback(rows, table.limit(0), [("a", ["a"]), ("all", [])], "v", "n").where("v is null and method is null").count() == 5


def test_overlap_risk_forms_no_needless_pair(spark):
    origins = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["y"]), ("d", ["z"]), ("e", None), ("f", [])], "source_id string, families array<string>")
    assert {tuple(r) for r in relate.overlap_risk(origins).collect()} == {("a", "b", "confirmed"), ("b", "c", "confirmed"), ("e", None, "indeterminate"), ("f", None, "indeterminate")}


def test_the_cascade_is_evaluated_once_a_side(spark):
    plan = registry.queries()["dup_1_exact_first_wins"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 2 * 9 and len(plan) < 12_000


def test_hmac(spark):
    import hashlib
    import hmac

    from kerbside.functions.scalars import keyed_hash

    for salt in ("s", "x" * 64, "é" * 90):
        row = spark.createDataFrame([("key é",), (None,)], "k string").select(keyed_hash(salt, F.col("k")).alias("h")).collect()
        assert [r.h for r in row] == [hmac.new(salt.encode(), "key é".encode(), hashlib.sha256).hexdigest(), None]


def test_every_file_s_header_and_every_line(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    (tmp_path / "csv" / "b.csv").write_text("a,b\n7,8\n")
    rows = readers.read_strict_csv(spark, f"file://{tmp_path}/csv", ["a", "b"])
    assert Counter(r.reason_code for r in rows.collect()) == {None: 2, "row_width_invalid": 2}
    (tmp_path / "csv" / "c.csv").write_text("b,a\n9,9\n")
    with pytest.raises(Exception, match="header"):
        readers.read_strict_csv(spark, f"file://{tmp_path}/csv", ["a", "b"]).collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n{"a": 1, "a": 2}\n{"": 1}\n[1]\n{"a": "x"}\nnope\n')
    found = readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", spark.createDataFrame([], "a long, b struct<c: string>").schema).collect()
    assert [r.reason_code for r in found] == [None, "blank_line", "columns_invalid", "columns_invalid", "json_invalid", "json_invalid", "json_invalid"] and found[0].b.c == "x"


def test_accounting_by_reason(spark):
    df = spark.createDataFrame([("g", None, False, 5), ("g", None, True, 1), ("g", "x", False, 9), ("g", "y", False, None), ("g", "x", False, 0), ("h", None, False, None)], "g string, reason_code string, is_duplicate boolean, v int")
    found = {r.g: r for r in dedupe.accounting(df, by=["g"], ranges={"v": F.col("v")}).collect()}
    assert found["g"].by_reason == {"x": 2, "y": 1} and (found["g"].min_v, found["g"].max_v, found["g"].seen, found["g"].balanced) == (5, 5, 5, True) and found["h"].by_reason == {}


def test_weighting_gates(spark):
    base = {"arm": "base", "pooled": 100.0, "worst_fold": 100.0, "source_worst": 100.0, "rmse": 100.0, "high_price_mae": 100.0, "p90_ae": 100.0, "effective_share": 1.0, "max_weight": 1.0}
    arms = [base] + [base | {"arm": f"bad_{k}", k: 80.0 if k == "max_weight" else 0.5 if k == "effective_share" else 120.0} for k in base if k != "arm"] + [base | {"arm": "better", "pooled": 90.0}, base | {"arm": "near", "pooled": 90.1}, base | {"arm": "unknown", "rmse": None}]
    shape = "arm string, " + ", ".join(f"{k} double" for k in base if k != "arm")
    found = {r.arm: r for r in mixing.weighting_decision(spark.createDataFrame([tuple(a.values()) for a in arms], shape), "base", ["base", "near", "better"]).collect()}
    assert all(found[f"bad_{k}"].failed == k for k in base if k != "arm") and found["unknown"].failed == "rmse"
    assert [a for a, r in found.items() if r.chosen] == ["near"] and found["better"].near_best and not found["base"].near_best


def test_interval_counts(spark):
    rows = [("m", 5.0, 4.0, 2.0, 0.0, 8.0, False), ("m", -1.0, 1.0, 3.0, 0.0, 4.0, True), ("m", 5.0, 4.0, None, None, None, False), ("m", 1.0, 1.0, 1.0, 3.0, 2.0, False)]
    r = conformal.interval_metrics(spark.createDataFrame(rows, "method string, y double, p double, radius double, lower double, upper double, fallback boolean"), 0.9).first()
    assert (r.n, r.clipped, r.fallbacks, r.reversed, r.invalid, r.clip_changes, r.coverage) == (4, 2, 1, 1, 1, 2, 0.25)


# Streams and learners against a plain fold


def test_pending_predictions_expire(spark):
    base = fresh_dir(spark, "ttl")
    t = dt.datetime(2024, 1, 1)
    rows = [("prediction", "e1", t, 5.0, None, None), ("prediction", "e2", t, 6.0, None, None), ("outcome", "e2", t, None, "o2", 3.0)]
    spark.createDataFrame(rows, "kind string, event_id string, at timestamp, prediction double, outcome_id string, target double").write.parquet(f"{base}/in")
    s = spark.readStream.schema("kind string, event_id string, at timestamp, prediction double, outcome_id string, target double").parquet(f"{base}/in")
    made = s.where("kind = 'prediction'").select("event_id", F.lit("view").alias("source_id"), F.col("at").alias("observed_at"), "prediction")
    seen = s.where("kind = 'outcome'").select("outcome_id", "event_id", F.lit("view").alias("source_id"), F.col("at").alias("occurred_at"), "target")
    with rocksdb(spark):
        query = outcomes.match_stream(made, seen, ["view"], 2000).writeStream.outputMode("append").option("checkpointLocation", f"{base}/c").trigger(processingTime="1 second").format("parquet").start(f"{base}/out")
        try:
            until = time.time() + 90
            while time.time() < until:
                time.sleep(1)
                found = {(r.event_id, r.outcome_id, r.reason_code) for r in spark.read.schema(outcomes.RESULT).parquet(f"{base}/out").collect()} if query.lastProgress else set()
                if len(found) >= 2:
                    break
        finally:
            query.stop()
    assert found == {("e2", "o2", None), ("e1", None, "event_expired")}


def test_a_restart_changes_nothing(spark):
    rows = registry.queries()["str_4_10_stateful_stream_with_restart"](spark, SF).collect()
    assert len(rows) > 2 and all(r.whole == r.restarted for r in rows)


def test_segments_are_folded_in_order(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randint(0, 3)}", i, float(rng.randint(1, 90)), float(rng.randint(1, 90)) + 400 * (i > 1500), "c" * rng.randint(1, 3)) for i in range(3000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, at int, y double, p double, c string").repartition(6)
    drift, learned = {}, {}
    for k, _, y, p, c in rows:
        drift.setdefault(k, [keyed.Adwin(), 0, 0])
        drift[k][1] += 1
        drift[k][2] += drift[k][0].add(abs(p - y) / max(y, 1.0))
        model = learned.setdefault(k, [keyed.OnlineLinear(), 0.0])
        model[1] += abs(model[0].predict({"p": p}, {"c": c}) - y)
        model[0].learn({"p": p}, {"c": c}, y)
    assert {r.key: (r.n, r.detections) for r in keyed.adwin_by_key(df, "k", ["at"]).collect()} == {k: (n, d) for k, (_, n, d) in drift.items()}
    assert sum(d for *_, d in drift.values()) > 0
    assert {r.key: r.mae for r in keyed.online_linear_by_key(df, "k", ["at"], ["p"], ["c"], "y").collect()} == pytest.approx({k: total / drift[k][1] for k, (_, total) in learned.items()})


def test_linear_models_are_least_squares(spark):
    from kerbside.plans.learning import CATEGORICAL, NUMERIC, prepared

    rows = written(prepared(spark, SF), "t")
    table = rows.toPandas()
    want = np.zeros(len(table))
    for f in range(5):
        train = (table.fold != f).to_numpy()
        numbers = table[NUMERIC].astype(float).fillna(table[NUMERIC][train].astype(float).median())  # the training rows' median
        x = np.column_stack([numbers.to_numpy(float), *[(table[c] == v).to_numpy(float) for c in CATEGORICAL for v in sorted(table[c].unique())], np.ones(len(table))])
        want[~train] = x[~train] @ np.linalg.lstsq(x[train], table.y.to_numpy()[train], rcond=None)[0]
    found = models.out_of_fold(rows, "fold", 5, "row_id", "y", lambda: [*models.design(NUMERIC, CATEGORICAL), models.linear("y")]).toPandas()
    mine = found.sort_values(["row_id", "y"]).p.to_numpy()
    theirs = table.assign(p=want).sort_values(["row_id", "y"]).p.to_numpy()
    assert np.abs(mine - theirs).max() < 0.01 * np.abs(theirs).max() and np.abs(mine - theirs).mean() < 20
    errors = {r.fold: r.mae for r in registry.queries()["mod_7_11_linear_out_of_fold"](spark, SF).collect()}
    assert errors == pytest.approx({f: np.abs(want - table.y)[table.fold == f].mean() for f in range(5)}, rel=0.01)


def test_grid_scores_every_candidate_on_every_row(spark):
    from kerbside.plans.learning import CATEGORICAL, NUMERIC, prepared

    rows = written(prepared(spark, SF).withColumn("y", F.coalesce("mileage", F.lit(0)) * 1.0 + 2000 * F.col("age")), "t")
    found = models.grid(rows, "fold", 5, "row_id", "y", lambda: models.design(NUMERIC, CATEGORICAL), {"forest": lambda: models.random_forest("y", 4, 5), "boosted": lambda: models.boosting("y", "squared", 4), "linear": lambda: models.linear("y")})
    counts = {r.candidate: (r.n, r.mae) for r in found.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).collect()}
    median = rows.agg(F.avg(F.abs(F.col("y") - F.lit(rows.agg(F.median("y")).first()[0])))).first()[0]
    assert {n for n, _ in counts.values()} == {rows.count()} and all(mae < 0.5 * median for _, mae in counts.values())


def test_alignment_weights_by_hand(spark):
    rows = listings(spark, SF).select("row_id", "source", "make", "status").toPandas()
    weight = np.ones(len(rows))
    for d in ("make", "status"):
        share = rows.groupby(["source", d]).size().unstack(fill_value=0)
        part = share.div(share.sum(axis=1), axis=0)
        factor = (part.mean(axis=0) / part) ** (0.25 * share / (share + 200.0))
        factor = factor.where(share > 0, 1.1).clip(0.9, 1.1)
        weight *= [factor.loc[s, v] for s, v in zip(rows.source, rows[d])]
    rows["w"] = np.clip(weight, 0.8, 1.25)
    rows["w"] /= rows.groupby("source").w.transform("mean")
    found = registry.queries()["mod_18_alignment_weights"](spark, SF).toPandas()
    assert found.groupby("row_id").weight.sum().to_dict() == pytest.approx(rows.groupby("row_id").w.sum().to_dict(), abs=2e-6)


def test_cards_of_the_pages_table(spark):
    import html
    import re

    want = Counter()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        titles = re.findall(r"<article>.*?<h1>(.*?)</h1>", r.html or "", re.S)
        links = len(re.findall(r"<a [^>]*href", r.html or ""))
        want.update((r.page_id, k, " ".join(html.unescape(re.sub("<[^>]*>", "", t)).split()), links, None) for k, t in enumerate(titles))
        if not titles:
            want[r.page_id, 0, None, links, "card_missing"] += 1
    found = registry.queries()["src_5_html_cards"](spark, SF).collect()
    assert Counter((r.page_id, r.position, r.title, r.links, r.reason_code) for r in found) == want


def test_profile_reports(spark):
    df = spark.createDataFrame([("s", "a", 1.0, None), ("s", "a", 3.0, "bad"), ("s", " ", None, None), ("t", "b", 2.0, None)], "s string, c string, v double, r string")
    found = {(r.source, r.part, r.name): r.value for r in profile.source_profile(df, "s", {"cc": "c", "none": None}, "v", ["c"], F.col("r"), 1).collect()}
    assert found["s", "accounting", "read"] == 3 and found["s", "accounting", "bad"] == 1 and found["s", "accounting", "accepted"] == 2 and found["s", "mapping", "none"] == 0
    assert found["s", "distribution", "p50"] == 2 and found["s", "distinct", "c"] == 1 and found["s", "top", "c=a"] == 2 and found["t", "mapping", "cc"] == 100


def test_staging_wants_a_shared_folder(spark, monkeypatch):
    path = fresh_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Remote:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Remote)


def _rows_by_key(df):
    """Whether a join of the plan deals the rows of ``df`` out by its key."""
    return "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_source_do_not_meet_in_a_task(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with sizes that Spark does not know
    try:
        rows = spark.createDataFrame([("F", 1), ("O", 2), (None, 3)], "source string, day int")
        grants = spark.createDataFrame([("F", "training", 0, 2), ("F", "training", 5, None)], "source string, use string, granted_from int, granted_until int")
        gated = rules.gate_by_permission(rows, grants, "source", "training", F.col("day"))
        runs = spark.createDataFrame([("F", 1)], "run_id string, day int")
        wrong = rules.provenance_violations(rows.withColumnRenamed("source", "run_id"), runs, ["day"])
        weights = mixing.alignment_weights(rows, "source", {"day": (0.5, 0.85, 1.15)})
        assert not any(_rows_by_key(d) for d in (gated, wrong, weights))
        assert {r.day: r.approved for r in gated.collect()} == {1: True, 2: False, 3: False}
        assert {r.day: r.differs for r in wrong.collect()} == {2: "run_id", 3: "run_id"} and weights.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_profile_reads_its_table_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", None)], "source string, make string, price double").withColumn("make", counted("make"))
    found = profile.source_profile(rows, "source", {"make": "make"}, "price", ["make"], F.lit(None).cast("string")).collect()
    assert seen.value == 3 and {(r.source, r.name): r.value for r in found if r.part == "distinct"} == {("s", "make"): 2, ("t", "make"): 1}


def test_samples_rank_only_what_they_may_choose(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(splits, "BUCKET_ROWS", 5)
    rows = [(k, None if k % 3 == 0 else "a" if k % 3 == 1 else "b") for k in range(900)]
    quotas = spark.createDataFrame([(None, 20), ("a", 3), ("c", 4)], "s string, quota int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = splits.stratified_sample(spark.createDataFrame(rows, "k long, s string"), "k", "s", quotas, "x")
        assert not _rows_by_key(found)
        mine = lambda s, n: sorted((k for k, t in rows if t == s), key=lambda k: hashlib.sha256(f"x|{k}".encode()).hexdigest())[:n]
        assert sorted(r.k for r in found.collect()) == sorted(mine(None, 20) + mine("a", 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
