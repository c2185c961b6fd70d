"""Weights, fold-local preparation, staged intervals, gates, group folds, null keys and cards against plain Python."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from kerbside.operators import conformal, dedupe, mixing, models, preparation, splits
from kerbside.operators.quantiles import quantiles_without, values_without, weighted_quantiles, weighted_quantiles_by_cell
from kerbside.plans.learning import CATEGORICAL, NUMERIC, prepared, staged
from kerbside.sources import cards
from kerbside.staging import fresh_dir, mark, release, written

SF = "/root/testdata/sf0.001"


# Null keys


def test_every_row_has_an_outcome(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, None, "b"), (4, "k", None), (5, "k", None), (6, "k", "c"), (7, "m", "d")]
    found = dedupe.resolve_keyed(spark.createDataFrame(rows, "n int, key string, digest string"), ["key"], "digest", F.col("n"))
    assert {r.n: r.outcome for r in found.collect()} == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "accepted", 5: "duplicate", 6: "conflict", 7: "accepted"}


def test_samples_keep_null_buckets(spark):
    rows = spark.createDataFrame([(None if k % 2 else "a", k) for k in range(40)], "bucket string, k long")
    found = splits.ranked_sample(rows, "bucket", "k", 1, 4, "s").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("chosen")).collect()
    assert {(r.bucket, r.n, r.chosen) for r in found} == {(None, 20, 5), ("a", 20, 5)}
    quotas = spark.createDataFrame([(None, 3), ("a", 2)], "bucket string, quota int")
    assert Counter(r.bucket for r in splits.stratified_sample(rows, "k", "bucket", quotas, "s").collect()) == {None: 3, "a": 2}


# Quotas and folds


def test_quotas_beyond_64_bits(spark):
    sizes = {"a": 7_000_000_001, "b": 6_999_999_999, "c": 5}
    target = 2_000_000_003
    strata = spark.createDataFrame(list(sizes.items()), "s string, n long")
    total = sum(sizes.values())
    floors = {k: n * target // total for k, n in sizes.items()}
    short = target - sum(floors.values())
    order = sorted(sizes, key=lambda k: (-(sizes[k] * target % total), k))
    want = {k: floors[k] + (k in order[:short]) for k in sizes}
    assert {r.s: r.quota for r in splits.proportional_quotas(strata, "s", target).collect()} == want
    held = strata.withColumn("minimum", F.when(F.col("s") == "c", 5).otherwise(0).cast("long"))
    found = {r.s: r.quota for r in splits.nested_quotas(held, "s", target, "minimum").collect()}
    assert sum(found.values()) == target and found["c"] == 5


def test_full_rounds(spark):
    rng = random.Random(4)
    for _ in range(4):
        spare = [rng.randrange(0, 9) for _ in range(12)]
        excess = rng.randrange(0, sum(spare) + 1)
        given, rounds = 0, 0
        while rounds < 20 and given + sum(s > rounds for s in spare) <= excess and any(s > rounds for s in spare):
            given, rounds = given + sum(s > rounds for s in spare), rounds + 1
        found = splits._full_rounds(written(spark.createDataFrame([(s,) for s in spare], "__spare long"), "t"), excess)
        assert found[1] == excess - sum(min(s, found[0]) for s in spare) and sum(min(s, found[0]) for s in spare) == given


def test_group_folds_are_greedy(spark):
    rng = random.Random(9)
    sizes = {f"g{k}": int(rng.paretovariate(1.1)) for k in range(1000)}
    for k in (2, 5, 7):
        loads = [0] * k
        for n in sorted(sizes.values(), reverse=True):
            loads[loads.index(min(loads))] += n
        counts = Counter(sizes.values())
        given = splits.lightest_first(list(counts.items()), k)
        assert [sum(n * c[f] for n, c in given.items()) for f in range(k)] == loads
    small = {g: min(n, 30) for g, n in sizes.items() if n < 200}
    rows = spark.createDataFrame([(g,) for g, n in small.items() for _ in range(n)], "g string")
    found = splits.group_kfold(rows, "g", 5).collect()
    loads = [0] * 5
    for n in sorted(small.values(), reverse=True):
        loads[loads.index(min(loads))] += n
    assert {r.g: r.n for r in found} == small and [sum(r.n for r in found if r.fold == f) for f in range(5)] == loads


# Order statistics


def test_weighted_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), rng.choice([1.0, 2.5, 2.5, -3.0, 1e9, 0.0, float("nan")]), rng.choice([0.25, 1.0, 1.75, 0.0, None, 0.333333333])) for _ in range(400)]
    found = weighted_quantiles(spark.createDataFrame(rows, "g string, x double, w double"), F.col("x"), ["g"], ["0.1", "0.5", "1.0"], F.col("w"))
    for r in found.collect():
        mine = sorted((x, Decimal(str(w))) for g, x, w in rows if g == r.g and x == x and w)
        total = sum(w for _, w in mine)
        want = []
        for p in ("0.1", "0.5", "1.0"):
            upto = Decimal(0)
            for x, w in mine:
                upto += w
                if upto >= total * Decimal(p):
                    want.append(x)
                    break
        assert (r.total, r["values"]) == (total, want)


def test_quantiles_without_a_part(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 2, None]), rng.choice([float(rng.randrange(100)), rng.lognormvariate(5, 2), -5.0, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, part int, x double")
    found = {(r.g, r.without): r.q for r in quantiles_without(df, F.col("x"), [0.0, 0.3, 0.5, 1.0], ["g"], "part", 3).collect()}
    assert len(found) == 9
    for (g, f), q in found.items():
        mine = [x for a, p, x in rows if a == g and p is not None and p != f and x is not None]
        assert q == pytest.approx(np.quantile(mine, [0.0, 0.3, 0.5, 1.0]).tolist())
    alone = values_without(spark.createDataFrame([(0, 5.0)], "part int, x double"), F.col("x"), [], "part", 2, lambda n: F.array(n, n + 1))
    assert [(r.without, r.n, r["values"]) for r in alone.collect()] == [(1, 1, [5.0, None])]


# Preparation


def test_preparation_learns_from_its_rows_only(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, " a "), (float("nan"), "b"), (8.0, None), (2.0, "c")], "x double, c string")
    made = preparation.Preparation(numeric=["x"], categorical=["c"], minFrequency=2)
    model = made.fit(train)
    filled = [1.0, 2.5, 3.0, 2.5, 8.0, 2.0]
    assert model.medians == {"x": 2.5} and model.scales["x"] == pytest.approx(np.std(filled)) and model.labels == {"c": ["a", preparation.INFREQUENT]}
    asked = spark.createDataFrame([(1, None, "a", "f"), (2, 4.0, "never seen", "f"), (3, 0.0, None, "f")], "k int, x double, c string, features string")
    rows = {r.k: r.features.toArray().tolist() for r in model.transform(asked).collect()}
    assert rows == {1: pytest.approx([2.5 / np.std(filled), 1, 0]), 2: pytest.approx([4 / np.std(filled), 0, 1]), 3: pytest.approx([0, 0, 1])}
    model.write().save(str(tmp_path / "m"))
    again = preparation.PreparationModel.load(str(tmp_path / "m"))
    assert {r.k: r.features.toArray().tolist() for r in again.transform(asked).collect()} == rows
    made.write().save(str(tmp_path / "e"))
    assert preparation.Preparation.load(str(tmp_path / "e")).fit(train).labels == model.labels


def test_preparation_without_an_infrequent_level(spark):
    train = spark.createDataFrame([(1.0, "a"), (1.0, "b")] * 3, "x double, c string")
    model = preparation.Preparation(numeric=["x"], categorical=["c"], minFrequency=1).fit(train)
    found = model.transform(spark.createDataFrame([(1.0, "b"), (1.0, "z")], "x double, c string")).collect()
    assert [r.features.toArray().tolist() for r in found] == [[1, 0, 1], [1, 0, 0]]  # no deviation: divided by 1
    many = spark.createDataFrame([(1.0, f"c{k:04d}") for k in range(700)] + [(1.0, "c0699")], "x double, c string")
    labels = preparation.Preparation(numeric=[], categorical=["c"], minFrequency=1).fit(many).labels["c"]
    assert len(labels) == 512 and labels[0] == "c0000" and "c0699" in labels and labels[-1] == preparation.INFREQUENT


def test_weighted_linear_is_weighted_least_squares(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=300), rng.uniform(0.5, 2, 300)
    y = 3 * x + 5 + rng.normal(size=300) * (x > 0) * 4
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "x double, y double, w double")
    model = Pipeline(stages=[*models.design(["x"], []), models.linear("y", "w")]).fit(df)
    found = np.array([r.p for r in model.transform(df).orderBy("x").collect()])
    root = np.sqrt(w)
    line, *_ = np.linalg.lstsq(np.stack([x, np.ones(300)], 1) * root[:, None], y * root, rcond=None)
    assert found == pytest.approx(np.sort(x) * line[0] + line[1], rel=1e-4, abs=1e-4)


def test_aligned_weights_keep_totals_and_bounds(spark):
    rows = spark.createDataFrame([(0, "s", "x")] * 30 + [(0, "s", "y")] * 10 + [(0, None, "x")] * 5 + [(0, None, "y")] * 15 + [(1, "s", None)] * 4, "f int, source string, d string")
    start = mixing.source_weights(rows, "source", ["f"]).withColumnRenamed("weight", "start")
    found = mixing.alignment_weights(start, "source", {"d": (0.5, 0.85, 1.15)}, by=["f"], start="start", prior=0.0)
    totals = {(r.f, r.source): (r.t, r.n) for r in found.groupBy("f", "source").agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert totals == {(0, "s"): (pytest.approx(30), 40), (0, None): (pytest.approx(30), 20), (1, "s"): (pytest.approx(4), 4)}
    weights = {(r.source, r.d): r.weight for r in found.where("f = 0").collect()}
    assert weights["s", "y"] > weights["s", "x"] and weights[None, "x"] > weights[None, "y"]
    with pytest.raises(Exception, match="out of bounds"):
        mixing.alignment_weights(start, "source", {"d": (0.5, 0.85, 1.15)}, by=["f"], start="start", final=(0.9, 1.1)).collect()


# Intervals


def test_staged_intervals_by_hand(spark):
    rows = staged(spark, SF)
    found = conformal.staged_intervals(rows, "status", 0.9).toPandas()
    table = rows.toPandas()
    assert set(zip(table["for_fold"], table["role"], table["fold"])) == {(f, role, (f + k) % 5) for f in range(5) for role, k in (("validate", 0), ("calibrate", 1))}
    assert table["scale"].between(500, 250_000).all() and len(found) == len(table[table["role"] == "validate"])
    for (f, status), mine in found.groupby(["for_fold", "status"]):
        held = table[(table["for_fold"] == f) & (table["role"] == "calibrate") & (table["status"] == status)]
        scores = np.sort((held["y"] - held["p"]).abs() / held["scale"])
        k = int(np.ceil((len(scores) + 1) * 0.9))
        assert mine["factor"].to_numpy() == pytest.approx(scores[k - 1])
        assert mine["upper"].to_numpy() == pytest.approx((mine["p"] + scores[k - 1] * mine["scale"]).to_numpy())
    share = found["y"].between(found["lower"], found["upper"]).groupby(found["for_fold"]).agg(["mean", "size"])
    assert (abs(share["mean"] - 0.9) < 4 * np.sqrt(0.09 / share["size"]) + 0.01).all()


def test_each_regression_gate_fails_for_one_method(spark):
    def method(name, hits, fallback=lambda k: False):
        return [(name, k % 4, "f" if k < 40 else "g", 1.0, 0.0 if hits(k) else 2.0, 3.0, fallback(k)) for k in range(80)]

    rows = method("base", lambda k: k % 10 != 3) + method("same", lambda k: k % 10 != 3) + method("fold", lambda k: k % 4 != 1) + method("focus", lambda k: k >= 30) + method("fallback", lambda k: k % 10 != 3, lambda k: k % 5 == 0)
    df = spark.createDataFrame(rows, "method string, fold int, band string, y double, lower double, upper double, fallback boolean")
    limits = {"worst_fold_regression": 0.5, "fold_sd_increase": 0.2, "fallback_increase": 0.05, "focus_band_regression": 0.3, "focus_none_regression": 0.0}
    found = conformal.regression_gates(df, "base", "fold", {"band": ("band", "f"), "none": ("band", "?")}, limits)
    failed = {}
    for r in found.where("not passed").collect():
        failed.setdefault(r.method, set()).add(r.gate)
    assert failed["fold"] >= {"worst_fold_regression", "fold_sd_increase"} and "focus_band_regression" in failed["focus"] and failed["fallback"] == {"fallback_increase"} and "same" not in failed and "base" not in failed


@pytest.mark.parametrize("a,b,a_gate,b_gate,b_ok,want", [(0.95, 0.90, 0.2, 0.2, True, "b"), (0.95, 0.90, 0.2, 0.3, True, "a"), (0.95, 0.947, 0.2, 0.1, True, "a"), (0.95, 0.5, 0.2, 0.1, False, "a"), (0.5, 0.9, 9.0, 0.1, True, "b"), (0.5, 0.5, 9.0, 0.1, False, "base")])
def test_sharper_method(spark, a, b, a_gate, b_gate, b_ok, want):
    gates = spark.createDataFrame([("base", "g", 0.0, 1.0, True), ("a", "g", a_gate, 1.0, a_gate <= 1), ("b", "g", b_gate, 1.0, True), ("b", "h", 0.0, 1.0, b_ok)], "method string, gate string, observed double, threshold double, passed boolean")
    widths = spark.createDataFrame([("base", 1.0), ("a", a), ("b", b)], "method string, mean_width double")
    assert [r.method for r in conformal.choose_sharper(gates, widths, "base", ["a", "b"]).collect()] == [want]


# Cards


def test_cards_of_odd_pages(spark):
    selection = cards.Selection((("make", cards.data_field("make")), ("year", cards.data_field("year", required=False, pattern="[0-9]+"))))
    card = "<article class='a vehicle-card b' data-listing-id=7><a class=vehicle-card__link href='x?a=1'></a><b data-field=make> Ｆord <i>T</i>"
    pages = [
        (1, "https://h/p/q", card), (2, None, card + "</article>" + card.replace("=7", "=' '")), (3, "https://h/", None), (4, "https://h/", "<div><a rel=next>x</a>" + "</b>" * 3000 + "<i>" * 3000),
        (5, "https://h/", card.replace("href='x?a=1'", "href=' '") + "<a rel='x NEXT next' href=//o/n>"), (6, "https://h/", card + "<u data-field=year>old</u>"), (6, "https://h/", card.replace("Ｆord <i>T</i>", "&nbsp;") + "<u data-field=year></u>"),
    ]
    found = cards.select_cards(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, position int"), selection).collect()
    assert Counter((r.page_id, r.position, r.listing_id, r.make, r.year, r.url, r.next_url, r.reason_code) for r in found) == Counter([
        (1, 0, "7", "Ford T", None, "https://h/p/x?a=1", None, None), (2, 0, "7", "Ford T", None, "x?a=1", None, None), (2, 1, None, "Ford T", None, "x?a=1", None, "id_missing"),
        (3, 0, None, None, None, None, None, "card_missing"), (4, 0, None, None, None, None, None, "card_missing"), (5, 0, "7", "Ford T", None, None, "https://o/n", "link_missing"),
        (6, 0, "7", "Ford T old", "old", "https://h/x?a=1", None, "year_invalid"), (6, 0, "7", None, None, "https://h/x?a=1", None, "make_empty"),
    ])


def test_release_since_a_mark(spark):
    before = written(spark.range(3), "before")
    since = mark()
    path = fresh_dir(spark, "after")
    spark.range(2).write.parquet(path)
    assert release(spark, since) == 1 and before.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_models_see_prepared_features(spark):
    rows = prepared(spark, SF)
    assert rows.where("mileage is null").count() > 0
    model = models.design(NUMERIC, CATEGORICAL)[0].fit(rows)
    assert model.transform(rows).count() == rows.count()


# Work that does not grow with arms and folds


def test_weighted_medians_by_cell_equal_those_of_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([1.0, 2.5, 900.0, rng.lognormvariate(4, 2), None, float("nan")])) for _ in range(500)]
    weights = [(arm, g, s, w) for arm in ("m", "n") for g, s, w in [("a", "x", 0.25), ("a", "y", 1.333333333), (None, "x", 2.0), (None, "y", 0.0), ("b", "x", 1.0 if arm == "m" else None)]]
    df, held = spark.createDataFrame(rows, "g string, s string, v double"), spark.createDataFrame(weights, "arm string, g string, s string, weight double")
    found = weighted_quantiles_by_cell(df, F.col("v"), ["g", "s"], held, ["arm", "g"], ["0.2", "0.5"]).collect()
    whole = df.join(held.withColumnRenamed("g", "__g").withColumnRenamed("s", "__s"), F.col("g").eqNullSafe(F.col("__g")) & (F.col("s") == F.col("__s")))
    want = weighted_quantiles(whole, F.col("v"), ["arm", "g"], ["0.2", "0.5"], F.col("weight")).collect()
    assert {(r.arm, r.g): (r.total, r["values"]) for r in found} == {(r.arm, r.g): (r.total, r["values"]) for r in want} and len(found) == 5


def test_counted_rows_have_the_weights_of_rows(spark):
    cells = [("s", "x", 30), ("s", "y", 10), (None, "x", 5), (None, "y", 15)]
    counted = spark.createDataFrame(cells, "source string, d string, n long")
    plain = counted.select("source", "d", F.explode(F.expr("sequence(1, n)")).alias("k"))

    def weights(df, times=None):
        start = mixing.source_weights(df, "source", times=times).withColumnRenamed("weight", "start")
        return mixing.alignment_weights(start, "source", {"d": (0.5, 0.85, 1.15)}, start="start", prior=0.0, times=times)

    found, want = weights(counted, "n"), weights(plain)
    assert {(r.source, r.d): r.weight for r in found.collect()} == {k: pytest.approx(v) for k, v in {(r.source, r.d): r.weight for r in want.collect()}.items()}
    a, b = mixing.weight_diagnostics(found, ["source"], "n").collect(), mixing.weight_diagnostics(want, ["source"]).collect()
    assert {r.source: r.asDict() for r in a} == {r.source: {k: v if isinstance(v, (str, type(None))) else pytest.approx(v) for k, v in r.asDict().items()} for r in b}


def test_models_of_summed_rows_are_those_of_rows(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        x, c = rng.choice([1.0, 2.0, 5.0, None]), rng.choice(["a", "b", "b", None])
        rows.append((k, k % 3, x, c, (3.0 + 2.0 * (x or 1.5) + (c == "b")) * rng.lognormvariate(0, 0.4)))
    df = spark.createDataFrame(rows, "k int, fold int, x double, c string, y double")
    for model, out in ((models.linear, "p"), (models.residual_scale, "scale")):
        plain = models.out_of_fold(df, "fold", 3, "k", "y", lambda: [*models.design(["x"], ["c"]), model("y")], out)  # noqa: B023
        few = models.out_of_fold(df, "fold", 3, "k", "y", lambda: [*models.design(["x"], ["c"], times="n"), model("y", "n")], out, inputs=["x", "c"])  # noqa: B023
        a, b = ({r.k: r[out] for r in f.collect()} for f in (plain, few))
        assert len(b) == 1500 and b == pytest.approx(a, rel=1e-5)
    counted = models.summed(df, ["x", "c"], "y")
    assert counted.count() == 12 and counted.agg(F.sum("n")).first()[0] == 1500
    a, b = models.design(["x"], ["c"])[0].fit(df), models.design(["x"], ["c"], times="n")[0].fit(counted)
    assert (b.medians, b.labels) == (a.medians, a.labels) and b.scales == pytest.approx(a.scales)
