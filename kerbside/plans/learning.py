"""Queries for features, models, selection, source mixing and delayed outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import scalars as S
from kerbside.operators import evaluate, mixing, models, relate, rules
from kerbside.operators.quantiles import quantiles, with_quantiles
from kerbside.plans.analysis import METRICS, L, tidy
from kerbside.plans.bindings import SQL, listings, mileage, model, query, rounded, scored, status, table
from kerbside.plans.ingest import CONTRACT
from kerbside.staging import written
from kerbside.streaming import keyed, outcomes

FOLDS = 5
SERVED = L + ", f AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS for_fold), t AS (SELECT f.for_fold, l.* FROM listings l JOIN f ON l.fold <> f.for_fold)"


@query("mod_1_feature_engineering", f"{L} SELECT row_id, year AS model_year, greatest(2002 - year, 0) AS age, round(mileage::DOUBLE / greatest(2002 - year, 1), 6) AS mileage_per_year, CASE WHEN mileage IS NULL THEN 1 ELSE 0 END AS mileage_missing FROM listings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.engineer(listings(spark, sf), CONTRACT).select("row_id", "model_year", "age", "mileage_per_year", "mileage_missing"), "mileage_per_year", digits=6)


@query("mod_2_fold_medians", SERVED + " SELECT for_fold, median(mileage)::DOUBLE AS mileage, median(year)::DOUBLE AS year FROM t GROUP BY 1")
def _(spark, sf):
    return models.fit_medians(listings(spark, sf), ["mileage", "year"], "fold", FOLDS)


@query("mod_3_fold_scales", SERVED + " SELECT for_fold, round(stddev_pop(mileage), 4) AS mileage, round(stddev_pop(year), 6) AS year FROM t GROUP BY 1")
def _(spark, sf):
    return rounded(rounded(models.fit_scale(listings(spark, sf), ["mileage", "year"], "fold", FOLDS), "mileage"), "year", digits=6)


@query("mod_4_fold_vocabulary", SERVED + """, c AS (SELECT for_fold, 'make' AS "column", make AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT for_fold, 'model', model, count(*) FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY for_fold, "column") AS d FROM c WINDOW w AS (PARTITION BY for_fold, "column" ORDER BY n DESC, value)) SELECT for_fold, "column", value, n, CASE WHEN n >= 25 AND (d <= 40 OR k < 40) THEN value ELSE '__infrequent__' END AS level FROM r""")
def _(spark, sf):
    return models.fit_vocabulary(listings(spark, sf), ["make", "model"], "fold", FOLDS, 25, 40)


def prepared(spark, sf):
    rows = models.engineer(scored(spark, sf), CONTRACT)
    return rows.select("row_id", "fold", "make", "status", "age", "mileage", "mileage_per_year", "mileage_missing", "source", "y", "score")


NUMERIC, CATEGORICAL = ["age", "mileage", "mileage_per_year", "mileage_missing"], ["make", "status"]
INPUTS = [*NUMERIC, *CATEGORICAL]


def counted_design(numeric=NUMERIC):
    """The design of training rows that each stand for ``n``."""
    return models.design(numeric, CATEGORICAL, times="n")


def design_sql(column, offset):
    """The level of ``column`` of every row and its place: at least 1,000 training rows or infrequent, at most 20 levels, in order of names."""
    return f"""v_{column} AS (SELECT {column} AS label, count(*) AS n FROM e WHERE fold <> 0 GROUP BY 1), w_{column} AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS k FROM v_{column} WHERE n >= 1000),
x_{column} AS (SELECT label FROM w_{column} WHERE k <= CASE WHEN (SELECT count(*) FROM v_{column}) = (SELECT count(*) FROM w_{column}) AND (SELECT count(*) FROM v_{column}) <= 20 THEN 20 ELSE 19 END),
y_{column} AS (SELECT label, {offset} + row_number() OVER (ORDER BY label) - 1 AS i FROM x_{column}),
z_{column} AS (SELECT e.row_id, coalesce(y.i, CASE WHEN (SELECT count(*) FROM y_{column}) < (SELECT count(*) FROM v_{column}) THEN {offset} + (SELECT count(*) FROM y_{column}) END) AS i FROM e LEFT JOIN y_{column} y ON y.label = e.{column})"""


@query("mod_5_sparse_design_matrix", f"""{L}, e AS (SELECT row_id, fold, make, CASE WHEN fold = 0 AND year < 1994 THEN 'Unseen' ELSE status END AS status, greatest(2002 - year, 0)::DOUBLE AS age, mileage::DOUBLE AS mileage, mileage::DOUBLE / greatest(2002 - year, 1) AS rate, CASE WHEN mileage IS NULL THEN 1.0 ELSE 0.0 END AS missing FROM listings),
m AS (SELECT median(age) AS age, median(mileage) AS mileage, median(rate) AS rate, median(missing) AS missing FROM e WHERE fold <> 0),
s AS (SELECT stddev_pop(e.age) AS age, stddev_pop(coalesce(e.mileage, m.mileage)) AS mileage, stddev_pop(coalesce(e.rate, m.rate)) AS rate, stddev_pop(e.missing) AS missing FROM e, m WHERE fold <> 0),
{design_sql('make', 4)}, {design_sql('status', '4 + (SELECT count(*) FROM y_make) + CASE WHEN (SELECT count(*) FROM y_make) < (SELECT count(*) FROM v_make) THEN 1 ELSE 0 END')},
x AS (SELECT row_id, unnest([0, 1, 2, 3]) AS i, unnest([e.age / s.age, coalesce(e.mileage, m.mileage) / s.mileage, coalesce(e.rate, m.rate) / s.rate, e.missing / s.missing]) AS v FROM e, m, s
  UNION ALL SELECT row_id, i, 1.0 FROM z_make WHERE i IS NOT NULL UNION ALL SELECT row_id, i, 1.0 FROM z_status WHERE i IS NOT NULL) SELECT row_id, CAST(i AS INTEGER) AS index, round(v, 6) AS value FROM x WHERE v <> 0""")
def _(spark, sf):
    """The matrix itself, every non-zero of every row: learned on folds 1 to 4, whose rarer makes share a level, and made for all folds; old listings of fold 0 have a status that training has not."""
    from pyspark.ml.functions import vector_to_array

    rows = prepared(spark, sf).withColumn("status", F.when((F.col("fold") == 0) & (F.col("age") > 8), "Unseen").otherwise(F.col("status")))
    (stage,) = models.design(NUMERIC, CATEGORICAL, 1000, 20)
    made = stage.fit(rows.where("fold <> 0")).transform(rows)
    return made.select("row_id", F.posexplode(vector_to_array("features")).alias("index", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query("mod_6_median_baseline", SERVED + ", m AS (SELECT for_fold, make, median(y) AS p FROM t GROUP BY ALL) SELECT row_id, round(m.p, 4) AS p FROM listings l JOIN m ON l.fold = m.for_fold AND l.make = m.make")
def _(spark, sf):
    return rounded(models.median_baseline(scored(spark, sf).drop("p"), "fold", FOLDS, "y", "make").select("row_id", "p"), "p")


def oof_metrics(spark, sf, candidates):
    found = models.grid(prepared(spark, sf), "fold", FOLDS, "row_id", "y", counted_design, candidates, inputs=INPUTS)
    return tidy(evaluate.regression_metrics(found, by=["candidate", "fold"]))


@query("mod_7_11_linear_out_of_fold")
def _(spark, sf):
    found = models.out_of_fold(prepared(spark, sf).select("row_id", "fold", *INPUTS, "y"), "fold", FOLDS, "row_id", "y", lambda: [*counted_design(), models.linear("y", "n")], inputs=INPUTS)
    return tidy(evaluate.regression_metrics(found, by=["fold"]))


@query("mod_8_random_forest")
def _(spark, sf):
    """Six parameter tuples on five folds."""
    return oof_metrics(spark, sf, {name: (lambda t=t: models.random_forest("y", *t)) for name, t in models.FORESTS.items()})


@query("mod_9_gradient_boosting")
def _(spark, sf):
    """Six parameter tuples on five folds."""
    return oof_metrics(spark, sf, {name: (lambda t=t: models.boosting("y", *t)) for name, t in models.BOOSTED.items()})


@query("mod_10_residual_scale")
def _(spark, sf):
    rows = prepared(spark, sf).select("row_id", "fold", *INPUTS, F.greatest("score", F.lit(1.0)).alias("size"))
    found = models.out_of_fold(rows, "fold", FOLDS, "row_id", "size", lambda: [*counted_design(), models.residual_scale("size", "n")], "scale", inputs=INPUTS)
    return found.withColumn("scale", S.clip(F.col("scale"), 500.0, 250_000.0)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("scale"), 2).alias("mean_scale"))


def staged(spark, sf):
    rows = prepared(spark, sf).select("row_id", "fold", *NUMERIC, *CATEGORICAL, "y")
    return models.staged_scale(rows, "fold", FOLDS, "y", lambda: [*counted_design(), models.linear("y", "n")], lambda size: [*counted_design([*NUMERIC, "log_value"]), models.residual_scale(size, "n")], INPUTS)


@query("cnf_9_learned_scale")
def _(spark, sf):
    """Intervals from a learned scale: value, scale, radius and validation each on folds of their own; coverage and width by outer fold."""
    from kerbside.operators import conformal

    found = conformal.staged_intervals(staged(spark, sf), "status", 0.9)
    inside = F.col("y").between(F.col("lower"), F.col("upper")).cast("double")
    return found.groupBy("for_fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 6).alias("coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 2).alias("mean_width"), F.round(F.min("scale"), 2).alias("min_scale"), F.round(F.max("scale"), 2).alias("max_scale"))


@query("mod_12_holdout")
def _(spark, sf):
    rows = written(prepared(spark, sf).select("row_id", "fold", *INPUTS, "y"), "holdout")
    found = models.holdout(models.summed(rows.where("fold <> 0"), INPUTS, "y"), rows.where("fold = 0"), "row_id", "y", [*counted_design(), models.linear("y", "n")])
    return tidy(evaluate.regression_metrics(found))


RESULTS = L + """, c AS (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k), e AS (SELECT c.k, make, p * (0.8 + 0.05 * c.k) - y AS e FROM listings, c), z AS (SELECT k, max(m) AS worst FROM (SELECT k, make, avg(abs(e)) AS m FROM e GROUP BY ALL) GROUP BY k),
r AS (SELECT 'c' || e.k AS candidate, CASE WHEN e.k % 2 = 0 THEN 'a' ELSE 'b' END AS family, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(any_value(worst), 4) AS worst_slice_mae, e.k * 10.0::DOUBLE AS size_mb, 100.0::DOUBLE + e.k AS latency_ms FROM e JOIN z ON e.k = z.k GROUP BY e.k)"""


def results(spark, sf):
    """Eight candidates, each the prediction times its own factor, scored on all rows; sizes and latencies are given, as by a model card."""
    k = F.col("k")
    rows = scored(spark, sf).select("make", "y", "p", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("k", "make", (F.col("p") * (F.lit(0.8) + F.lit(0.05) * k) - F.col("y")).alias("e"))
    parts = rows.groupBy("k", "make").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("s"))
    found = parts.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), F.max(F.col("a") / F.col("n")).alias("worst_slice_mae"))
    return rounded(found, "mae", "rmse", "worst_slice_mae").select(F.concat(F.lit("c"), k.cast("string")).alias("candidate"), F.when(k % 2 == 0, "a").otherwise("b").alias("family"), "n", "mae", "rmse", "worst_slice_mae", (k * 10.0).alias("size_mb"), (k + 100.0).alias("latency_ms"))


@query("mod_13_shortlist", RESULTS + " SELECT family, candidate, mae, CAST(row_number() OVER (PARTITION BY family ORDER BY mae, candidate) AS INTEGER) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY family ORDER BY mae, candidate) <= 2")
def _(spark, sf):
    return models.shortlist(results(spark, sf)).select("family", "candidate", "mae", "rank")


@query("mod_14_promotion", RESULTS + """, i AS (SELECT * FROM r WHERE candidate = 'c7'), j AS (SELECT r.candidate, r.mae, r.size_mb, CASE WHEN i.mae - r.mae < 0.001 * i.mae OR i.mae - r.mae < 1 THEN 'gain' WHEN r.rmse > i.rmse * 1.05 THEN 'rmse' WHEN r.worst_slice_mae > i.worst_slice_mae * 1.05 THEN 'slice' WHEN r.size_mb > 50 THEN 'budget:size_mb' WHEN r.latency_ms > 103 THEN 'budget:latency_ms' END AS failed FROM r, i WHERE r.candidate <> 'c7'),
w AS (SELECT arg_min(candidate, (size_mb, candidate)) AS c FROM j WHERE failed IS NULL AND mae <= (SELECT min(mae) FROM j WHERE failed IS NULL) * 1.01) SELECT candidate, mae, failed, coalesce(candidate = (SELECT c FROM w), false) AS promoted FROM j""")
def _(spark, sf):
    return models.promote(results(spark, sf), "c7", 0.001, 1.0, budgets={"size_mb": 50.0, "latency_ms": 103.0})


ARMS = SERVED + """, a AS (SELECT 'all' AS arm, * FROM t UNION ALL SELECT 'one_source', * FROM t WHERE source = 'O'), o AS (SELECT arm, for_fold, make, median(y) AS p FROM a GROUP BY ALL), e AS (SELECT arm, for_fold, median(y) AS p FROM a GROUP BY ALL),
s AS (SELECT e.arm, l.row_id, l.source, l.fold, l.y, coalesce(o.p, e.p) AS p FROM listings l JOIN e ON l.fold = e.for_fold LEFT JOIN o ON o.arm = e.arm AND o.for_fold = l.fold AND o.make = l.make),
m AS (SELECT arm, source, round(avg(abs(p - y)), 4) AS mae FROM s GROUP BY GROUPING SETS ((arm), (arm, source)))"""


def paired(spark, sf):
    rows = scored(spark, sf).select("row_id", "make", "source", "fold", "y")
    return mixing.paired_arms(rows, "fold", FOLDS, {"all": F.lit(True), "one_source": F.col("source") == "O"}, "make", "y")


def arm_errors(spark, sf):
    e = F.abs(F.col("p") - F.col("y"))
    parts = paired(spark, sf).groupBy("arm", "source").agg(F.sum(e).alias("s"), F.count(F.lit(1)).alias("n"))
    # One pass: the pooled error from the sums by source.
    return parts.groupingSets([[F.col("arm")], [F.col("arm"), F.col("source")]], F.col("arm"), F.col("source")).agg(F.round(F.sum("s") / F.sum("n"), 4).alias("mae"))


@query("mod_15_paired_arms", ARMS + " SELECT arm, source, mae FROM m")
def _(spark, sf):
    return arm_errors(spark, sf)


DECISION = ARMS + """, b AS (SELECT source AS s, mae AS base FROM m WHERE arm = 'one_source'), c AS (SELECT m.*, m.mae / b.base - 1 AS change FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.s),
d AS (SELECT arm, max(mae) FILTER (source IS NULL) AS pooled, -max(change) FILTER (source IS NULL) AS gain, max(change) FILTER (source IS NOT NULL) AS worst FROM c GROUP BY arm)"""


@query("mod_16_mixing_decision", DECISION + """, p AS (SELECT *, arm = 'one_source' OR (gain >= 0.0001 AND worst <= 0.05) AS passed FROM d) SELECT arm, pooled, round(gain, 6) AS gain, round(worst, 6) AS worst, passed, arm = (SELECT arg_min(arm, (pooled, arm)) FROM p WHERE passed) AS chosen FROM p""")
def _(spark, sf):
    return rounded(mixing.mixing_decision(arm_errors(spark, sf), "one_source", 0.05, 0.0001), "gain", "worst", digits=6)


WEIGHTS = L + ", w AS (SELECT *, (count(*) OVER (PARTITION BY fold))::DOUBLE / 2 / count(*) OVER (PARTITION BY fold, source) AS weight FROM listings)"


@query("mod_17_source_balanced_weights", WEIGHTS + " SELECT row_id, round(weight, 6) AS weight FROM w")
def _(spark, sf):
    return rounded(mixing.source_weights(listings(spark, sf), "source", ["fold"]).select("row_id", "weight"), "weight", digits=6)


@query("mod_18_alignment_factors", L + """, c AS (SELECT s.source, m.make AS label, count(l.row_id) AS n FROM (SELECT DISTINCT source FROM listings) s CROSS JOIN (SELECT DISTINCT make FROM listings) m LEFT JOIN listings l ON l.source = s.source AND l.make = m.make GROUP BY ALL),
h AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS share FROM c), a AS (SELECT *, avg(share) OVER (PARTITION BY label) AS mean FROM h)
SELECT source, label, n, round(least(greatest(CASE WHEN share > 0 THEN pow(mean / share, 0.5 * n / (n + 200)) ELSE 1.15 END, 0.85), 1.15), 6) AS factor FROM a""")
def _(spark, sf):
    return rounded(mixing.alignment_factors(listings(spark, sf), "source", "make", 0.5, 0.85, 1.15), "factor", digits=6)


@query("mod_18_alignment_weights")
def _(spark, sf):
    weighted = mixing.alignment_weights(listings(spark, sf), "source", {"make": (0.25, 0.9, 1.1), "status": (0.25, 0.9, 1.1)})
    return rounded(weighted.select("row_id", "weight"), "weight", digits=6)


@query("mod_19_weight_diagnostics", WEIGHTS + " SELECT source, count(*) AS n, round(min(weight), 6) AS min, round(median(weight), 6) AS median, round(max(weight), 6) AS max, round(avg(weight), 6) AS mean, round(sum(weight), 3) AS total, round(sum(weight) * sum(weight) / sum(weight * weight), 3) AS effective, round(sum(weight) * sum(weight) / sum(weight * weight) / count(*), 6) AS effective_share FROM w GROUP BY source")
def _(spark, sf):
    found = mixing.weight_diagnostics(mixing.source_weights(listings(spark, sf), "source", ["fold"]), ["source"])
    return rounded(rounded(found, "min", "median", "max", "mean", "effective_share", digits=6), "total", "effective", digits=3)


FACTORS = SQL["mod_18_alignment_factors"]


@query("mod_19_extreme_factors", f"""SELECT source, label, factor, CAST(row_number() OVER (PARTITION BY source ORDER BY factor, label) AS INTEGER) AS lowest, CAST(row_number() OVER (PARTITION BY source ORDER BY factor DESC, label) AS INTEGER) AS highest FROM ({FACTORS})
QUALIFY row_number() OVER (PARTITION BY source ORDER BY factor, label) <= 3 OR row_number() OVER (PARTITION BY source ORDER BY factor DESC, label) <= 3""")
def _(spark, sf):
    return mixing.extreme_factors(rounded(mixing.alignment_factors(listings(spark, sf), "source", "make", 0.5, 0.85, 1.15), "factor", digits=6), "source")


ARM_ORDER = ["unweighted", "source", "source_segment"]
SEGMENTS = {"make": (0.5, 0.85, 1.15), "status": (0.5, 0.85, 1.15)}


#: What a training row's weight depends on, besides the fold that it serves.
CELL = ["fold", "source", "make", "status"]


def cell_weights(rows):
    """The weight of every cell of training rows in each fold that it serves, once for each treatment, and the number ``n`` of its rows: weight 1, balanced sources, and balanced sources with aligned makes and statuses. Weights come from the fold's training rows alone."""
    counts = written(rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")), "weight-cells")
    balanced = written(mixing.source_weights(models.serving(counts, "fold", FOLDS), "source", ["for_fold"], "n").withColumnRenamed("weight", "start"), "balanced")
    aligned = mixing.alignment_weights(balanced, "source", SEGMENTS, by=["for_fold"], start="start", times="n").withColumn("arm", F.lit("source_segment"))
    plain = balanced.select("*", F.explode(F.array(F.struct(F.lit("unweighted").alias("arm"), F.lit(1.0).alias("weight")), F.struct(F.lit("source").alias("arm"), F.col("start").alias("weight")))).alias("x")).select(*balanced.columns, "x.*")
    return written(plain.unionByName(aligned).select("arm", "for_fold", *CELL, "n", F.round("weight", 9).alias("weight")), "weighted")


def weighed(spark, sf, *more):
    """Rows with what weights depend on and ``more``, written once, and the weights of their cells."""
    rows = written(listings(spark, sf).select(*CELL, F.col("price").alias("y"), *more), "weighed")
    return rows, cell_weights(rows)


def treatments(spark, sf):
    """What the gates compare, one row for each treatment: errors of weighted medians on the same folds, and how far its weights go."""
    asked, weights = weighed(spark, sf)
    e = F.abs(F.col("p") - F.col("y"))
    # Errors are made again from the narrow rows in each pass, and not written once for each treatment.
    rows = mixing.weighted_predictions_by_cell(asked, weights, CELL, "fold", "make", "y", stored=True).select("arm", "fold", "source", "y", e.alias("e"))
    parts = written(rows.groupBy("arm", "fold", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"), F.count_if(F.col("y") >= 60_000).alias("hn"), F.sum(F.when(F.col("y") >= 60_000, F.col("e"))).alias("hs")), "treatments")
    total = parts.groupBy("arm").agg((F.sum("s") / F.sum("n")).alias("pooled"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), (F.sum("hs") / F.sum("hn")).alias("high_price_mae"))
    worst = lambda by, name: parts.groupBy("arm", by).agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("arm").agg(F.max("m").alias(name))
    wide = with_quantiles(total, rows, {"p90_ae": (F.col("e"), 0.9)}, ["arm"], stored=True).join(worst("fold", "worst_fold"), "arm").join(worst("source", "source_worst"), "arm")
    effect = mixing.weight_diagnostics(weights, ["arm", "for_fold"], "n").groupBy("arm").agg(F.min("effective_share").alias("effective_share"), F.max("max").alias("max_weight"))
    held = wide.join(effect, "arm")
    return written(rounded(rounded(held, "pooled", "rmse", "high_price_mae", "p90_ae", "worst_fold", "source_worst"), "effective_share", "max_weight", digits=6), "treatment-metrics")


def factor_sql(name, dimension):
    """Alignment factors of the table ``b`` by fold, source and label."""
    return f"""c_{name} AS (SELECT s.for_fold, s.source, s.total, m.label, count(b.row_id) AS n FROM (SELECT for_fold, source, count(*) AS total FROM b GROUP BY ALL) s JOIN (SELECT DISTINCT for_fold, {dimension} AS label FROM b) m USING (for_fold)
  LEFT JOIN b ON b.for_fold = s.for_fold AND b.source = s.source AND b.{dimension} = m.label GROUP BY ALL),
f_{name} AS (SELECT for_fold, source, label, least(greatest(CASE WHEN n > 0 THEN pow(avg(n::DOUBLE / total) OVER (PARTITION BY for_fold, label) / (n::DOUBLE / total), 0.5 * n / (n + 200)) ELSE 1.15 END, 0.85), 1.15) AS factor FROM c_{name})"""


WEIGHTED = SERVED + f""", b AS (SELECT *, (count(*) OVER (PARTITION BY for_fold))::DOUBLE / 2 / count(*) OVER (PARTITION BY for_fold, source) AS start FROM t),
{factor_sql('make', 'make')}, {factor_sql('status', 'status')},
g AS (SELECT b.*, least(greatest(f.factor * h.factor, 0.8), 1.25) * start AS w FROM b JOIN f_make f ON f.for_fold = b.for_fold AND f.source = b.source AND f.label = b.make JOIN f_status h ON h.for_fold = b.for_fold AND h.source = b.source AND h.label = b.status),
a AS (SELECT 'unweighted' AS arm, for_fold, row_id, make, source, y, 1.0::DOUBLE AS weight FROM b UNION ALL SELECT 'source', for_fold, row_id, make, source, y, start FROM b
  UNION ALL SELECT 'source_segment', for_fold, row_id, make, source, y, w * sum(start) OVER (PARTITION BY for_fold, source) / sum(w) OVER (PARTITION BY for_fold, source) FROM g),
w AS (SELECT arm, for_fold, make, y, CAST(round(weight, 9) AS DECIMAL(28,9)) AS weight FROM a),
o AS (SELECT arm, for_fold, make, min(y) AS p FROM (SELECT *, sum(weight) OVER (PARTITION BY arm, for_fold, make ORDER BY y) * 2 >= sum(weight) OVER (PARTITION BY arm, for_fold, make) AS upper FROM w) WHERE upper GROUP BY ALL),
s AS (SELECT o.arm, l.row_id, l.source, l.fold, l.y, o.p FROM listings l JOIN o ON o.for_fold = l.fold AND o.make = l.make)"""


@query("mod_20_weighted_medians", WEIGHTED + " SELECT arm, row_id, p FROM s")
def _(spark, sf):
    """Predictions of the three treatments; every make is in every training set."""
    rows, weights = weighed(spark, sf, "row_id")
    return mixing.weighted_predictions_by_cell(rows, weights, CELL, "fold", "make", "y", stored=True).select("arm", "row_id", "p")


@query("mod_20_weighting_decision", WEIGHTED + """, x AS (SELECT *, abs(p - y) AS e FROM s),
wf AS (SELECT arm, max(m) AS worst_fold FROM (SELECT arm, fold, avg(e) AS m FROM x GROUP BY ALL) GROUP BY 1), ws AS (SELECT arm, max(m) AS source_worst FROM (SELECT arm, source, avg(e) AS m FROM x GROUP BY ALL) GROUP BY 1),
h AS (SELECT arm, min(share) AS share, max(most) AS most FROM (SELECT arm, for_fold, (sum(weight::DOUBLE) * sum(weight::DOUBLE) / sum(weight::DOUBLE * weight::DOUBLE)) / count(*) AS share, max(weight)::DOUBLE AS most FROM w GROUP BY ALL) GROUP BY 1),
d AS (SELECT arm, round(avg(e), 4) AS pooled, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e) FILTER (y >= 60000), 4) AS high_price_mae, round(quantile_cont(e, 0.9), 4) AS p90_ae, round(any_value(worst_fold), 4) AS worst_fold, round(any_value(source_worst), 4) AS source_worst,
  round(any_value(h.share), 6) AS effective_share, round(any_value(h.most), 6) AS max_weight FROM x JOIN wf USING (arm) JOIN ws USING (arm) JOIN h USING (arm) GROUP BY arm),
b0 AS (SELECT * FROM d WHERE arm = 'unweighted'),
j AS (SELECT d.*, CASE WHEN d.arm = 'unweighted' THEN '' ELSE array_to_string(list_filter([CASE WHEN d.pooled > b.pooled THEN 'pooled' END, CASE WHEN d.worst_fold / b.worst_fold - 1 > 0.01 THEN 'worst_fold' END, CASE WHEN d.source_worst / b.source_worst - 1 > 0.05 THEN 'source_worst' END, CASE WHEN d.rmse / b.rmse - 1 > 0.02 THEN 'rmse' END,
  CASE WHEN d.high_price_mae / b.high_price_mae - 1 > 0.05 THEN 'high_price_mae' END, CASE WHEN d.p90_ae / b.p90_ae - 1 > 0.02 THEN 'p90_ae' END, CASE WHEN d.effective_share < 0.9 THEN 'effective_share' END, CASE WHEN d.max_weight > 1.5 THEN 'max_weight' END], lambda z: z IS NOT NULL), ',') END AS failed FROM d, b0 b),
p AS (SELECT *, failed = '' AS passed FROM j), n AS (SELECT *, passed AND pooled <= (SELECT min(pooled) FROM p WHERE passed) * 1.005 AS near_best FROM p)
SELECT *, arm = (SELECT arg_min(arm, CASE arm WHEN 'unweighted' THEN 1 WHEN 'source' THEN 2 ELSE 3 END) FROM n WHERE near_best) AS chosen FROM n""")
def _(spark, sf):
    return mixing.weighting_decision(treatments(spark, sf), "unweighted", ARM_ORDER)


@query("mod_20_weighted_linear")
def _(spark, sf):
    """The linear model of every treatment on the same folds, its training rows weighted; errors by treatment and fold."""
    rows = written(prepared(spark, sf).select("row_id", "fold", "source", *INPUTS, "y"), "weighted-linear")
    weights = cell_weights(rows).drop("n")
    found = None
    for arm in ARM_ORDER:
        mine = weights.where(F.col("arm") == arm)
        weigh = lambda train, f: train.join(mine.where(F.col("for_fold") == f).select(F.struct(*CELL).alias("__cell"), "weight"), F.struct(*CELL) == F.col("__cell")).withColumn("times", F.col("n") * F.col("weight"))  # noqa: B023, E731
        each = models.out_of_fold(rows, "fold", FOLDS, "row_id", "y", lambda: [*counted_design(), models.linear("y", "times")], weigh=weigh, inputs=["source", *INPUTS])
        each = each.withColumn("arm", F.lit(arm))
        found = each if found is None else found.unionByName(each)
    return tidy(evaluate.regression_metrics(found, by=["arm", "fold"]))


@query("mod_21_unseen_categories", f"{L} SELECT row_id, upper(model) NOT IN (SELECT DISTINCT upper(model) FROM listings WHERE fold <> 0) AS unseen FROM listings WHERE fold = 0")
def _(spark, sf):
    """The vocabulary of all training folds against the fold that is held out."""
    rows = listings(spark, sf)
    known = rows.where("fold <> 0").select(F.lit("model").alias("column"), F.upper("model").alias("value")).distinct()
    return models.unseen_categories(rows.where("fold = 0"), known, ["model"]).select("row_id", "unseen")


@query("mod_22_request_contract", f"{L} SELECT row_id, CASE WHEN year + seller % 30 > 2023 THEN 'year_invalid' WHEN mileage > 500000 THEN 'mileage_invalid' WHEN seller % 11 = 0 THEN 'coverage_invalid' END AS reason_code FROM listings")
def _(spark, sf):
    c = F.col
    requests = listings(spark, sf).select("row_id", "make", (c("year") + c("seller") % 30).alias("year"), "mileage", F.when(c("seller") % 11 == 0, 0.5).otherwise(0.9).alias("coverage"))
    return rules.with_reason(requests, models.request_rules()).select("row_id", "reason_code")


@query("mod_22_batch_scoring")
def _(spark, sf):
    """A model of folds 1, 2 and 4, calibrated on fold 3, values every row of fold 0: no fold is left out."""
    from kerbside.operators import conformal

    rows = written(prepared(spark, sf).select("row_id", "fold", *INPUTS, "y"), "scoring")
    fitted = models.holdout(models.summed(rows.where("fold in (1, 2, 4)"), INPUTS, "y"), rows.where("fold in (0, 3)"), "row_id", "y", [*counted_design(), models.linear("y", "n")])
    placed = fitted.join(rows.select("row_id", "status", "fold").dropDuplicates(["row_id"]), "row_id").withColumn("score", F.abs(F.col("p") - F.col("y")))
    radii = conformal.fit_radii(placed.where("fold = 3"), "status", "score")
    return rounded(conformal.apply_intervals(placed.where("fold = 0"), radii, [("status", ["status"]), ("global", [])], 0.9).select("row_id", "p", "lower", "upper", "method"), "p", "lower", "upper", digits=2)


@query("mod_23_training_events", f"""{L}, c AS (SELECT *, sha256(concat_ws(chr(31), make, CAST(year AS VARCHAR), coalesce(CAST(mileage AS VARCHAR), chr(0)), CAST(seller AS VARCHAR))) AS content_key FROM listings)
SELECT content_key, sha256('run-1:' || content_key) AS event_key, CASE WHEN mileage IS NULL THEN 2 ELSE 3 END AS n_features, seller AS target FROM c""")
def _(spark, sf):
    made = models.training_events(listings(spark, sf), ["make", "year", "mileage"], "seller", "run-1")
    return made.select("content_key", "event_key", F.size("features").alias("n_features"), "target")


def predictions(spark, sf):
    """Views and clicks predict a value; every 17th has a bad value, every tenth user has predictors out of contract."""
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    return e.select(F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("event_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("observed_at"), F.when(F.col("event_id") % 17 == 0, -1.0).otherwise(F.col("value")).alias("prediction"), (F.col("user_id") % 10 != 0).alias("features_valid"))


def actuals(spark, sf):
    """Purchases are outcomes of the user's day; every 13th id is used twice, some targets are bad."""
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    c = F.col
    return e.select(F.concat(F.lit("o"), F.when(c("event_id") % 13 == 0, c("user_id") * 0 + 7).otherwise(c("event_id")).cast("string")).alias("outcome_id"), F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("event_id"), F.when(c("event_id") % 5 == 0, "click").otherwise("view").alias("source_id"), c("ts").alias("occurred_at"), F.when(c("event_id") % 7 == 0, 0.0).otherwise(c("value")).alias("target"), (c("event_id") % 19 != 0).alias("utc"), c("event_id").alias("number"))


STREAM = """p AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS event_id, event_type AS source_id, ts AS observed_at, CASE WHEN event_id % 17 = 0 THEN -1.0 ELSE value END AS prediction, user_id % 10 <> 0 AS features_valid FROM events WHERE event_type IN ('view', 'click')),
o AS (SELECT 'o' || CASE WHEN event_id % 13 = 0 THEN 7 ELSE event_id END AS outcome_id, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS event_id, CASE WHEN event_id % 5 = 0 THEN 'click' ELSE 'view' END AS source_id, ts AS occurred_at, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS target, event_id % 19 <> 0 AS utc, event_id AS number FROM events WHERE event_type = 'purchase'),
f AS (SELECT event_id, arg_min(source_id, (observed_at, prediction)) AS p_source, min(observed_at) AS observed_at, arg_min(prediction, (observed_at, prediction)) AS prediction, bool_and(features_valid) AS features_valid FROM p GROUP BY 1),
j AS (SELECT o.*, f.p_source, f.observed_at, f.prediction, f.features_valid, row_number() OVER (PARTITION BY outcome_id ORDER BY occurred_at, o.event_id) > 1 AS again FROM o LEFT JOIN f USING (event_id)),
r AS (SELECT *, CASE WHEN again THEN 'duplicate_outcome' WHEN p_source IS NULL THEN 'event_not_found' WHEN p_source <> source_id THEN 'source_mismatch' WHEN source_id NOT IN ('view') THEN 'source_not_approved' WHEN NOT utc OR occurred_at < observed_at THEN 'outcome_before_prediction' WHEN NOT features_valid THEN 'invalid_predictors' WHEN target <= 0 THEN 'invalid_target' END AS reason FROM j),
m AS (SELECT outcome_id, event_id, source_id, occurred_at, prediction, target, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY event_id, reason IS NULL ORDER BY occurred_at, outcome_id) > 1 THEN 'duplicate_outcome' ELSE reason END AS reason_code FROM r)"""


def matched(spark, sf):
    return outcomes.match_outcomes(predictions(spark, sf), actuals(spark, sf).drop("number"), ["view"])


def accepted(spark, sf):
    """Accepted outcomes in whole cents, so that sums are the same in any order."""
    return in_cents(matched(spark, sf).where("reason_code is null"))


def in_cents(m):
    cents = lambda c: F.round(100 * F.col(c)).cast("long")
    return m.select("outcome_id", "event_id", F.substring("event_id", 2, 1).alias("segment"), "occurred_at", cents("prediction").alias("p"), cents("target").alias("y"), F.lit(5000).cast("long").alias("static"), "reason_code")


A = "WITH " + STREAM + ", b AS (SELECT outcome_id, substr(event_id, 2, 1) AS segment, occurred_at, CAST(round(100 * prediction) AS BIGINT) AS p, CAST(round(100 * target) AS BIGINT) AS y, reason_code FROM m), a AS (SELECT * FROM b WHERE reason_code IS NULL)"


@query("jon_12_delayed_label_join", f"WITH {STREAM} SELECT o.outcome_id, o.event_id, p.prediction, o.target FROM o JOIN p ON o.event_id = p.event_id AND o.source_id = p.source_id AND o.occurred_at >= p.observed_at")
def _(spark, sf):
    return relate.join_outcomes(predictions(spark, sf), actuals(spark, sf)).select("outcome_id", "event_id", "prediction", "target")


@query("str_1_event_validation", f"WITH {STREAM} SELECT CASE WHEN prediction <= 0 THEN 'invalid_prediction' END AS reason_code, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    return outcomes.validate_events(predictions(spark, sf)).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("str_2_idempotent_ids", f"WITH {STREAM} SELECT event_id, 1::BIGINT AS n FROM p GROUP BY 1")
def _(spark, sf):
    """Predictions as a stream of files: every id leaves it once."""
    from kerbside.staging import fresh_dir
    from kerbside.streaming.runs import run_available

    base, made = fresh_dir(spark, "ids"), predictions(spark, sf)
    made.select("event_id", F.col("observed_at").cast("timestamp").alias("observed_at")).write.parquet(f"{base}/in")
    run_available(lambda s: outcomes.dedupe_stream(s, "event_id", "observed_at"), spark.readStream.schema("event_id string, observed_at timestamp").parquet(f"{base}/in"), f"{base}/out", f"{base}/c")
    return spark.read.schema("event_id string").parquet(f"{base}/out").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("str_3_delayed_outcome_matcher", f"WITH {STREAM} SELECT outcome_id, event_id, reason_code, prediction FROM m")
def _(spark, sf):
    return matched(spark, sf).select("outcome_id", "event_id", "reason_code", "prediction")


def part_of(at, runs):
    """In which of ``runs`` parts of January 2024 a time is; later ones are in the last."""
    return F.least(F.floor(F.datediff(at.cast("timestamp"), F.lit("2024-01-01")) * runs / 30), F.lit(runs - 1))


def in_runs(spark, name, inputs, build, schema, runs, once=False):
    """What a stream puts out over tables (name to rows and their time, or the number of their part) that come in ``runs`` parts, of whole days, with a stop after each (``once``: without)."""
    from kerbside.staging import fresh_dir
    from kerbside.streaming.runs import run_available

    base = fresh_dir(spark, name)
    part = lambda at: part_of(F.col(at), runs) if isinstance(at, str) else at
    parts = {k: written(rows.withColumn("__run", part(at)), f"{name}-{k}") for k, (rows, at) in inputs.items()}
    for run in range(runs):
        for k, rows in parts.items():
            rows.where(F.col("__run") == run).drop("__run").write.mode("append").parquet(f"{base}/{k}")
        if run == runs - 1 or not once:
            run_available(lambda _: build({k: spark.readStream.schema(rows.drop("__run").schema).parquet(f"{base}/{k}") for k, rows in parts.items()}), spark.range(0), f"{base}/out", f"{base}/c")  # noqa: B023
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("str_2_3_chained_stream", f"WITH {STREAM} SELECT outcome_id, event_id, reason_code, prediction FROM m")
def _(spark, sf):
    """The matcher as a stream of three runs, with ids refused across events: the rows of the batch form."""
    made, seen = predictions(spark, sf), actuals(spark, sf).drop("number")
    found = in_runs(spark, "chained", {"p": (made, "observed_at"), "o": (seen, "occurred_at")}, lambda s: outcomes.match_stream(s["p"], s["o"], ["view"]), outcomes.RESULT, 3)
    return found.select("outcome_id", "event_id", "reason_code", "prediction")


#: Milliseconds that a prediction waits in event time, and days of a run.
WAITS, RUN_DAYS = 6 * 86_400_000, 10


@query("str_4_event_time_expiry", """WITH e AS (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10, 2) AS run FROM events WHERE event_type IN ('view', 'purchase')),
w AS (SELECT run, max(max(ts)) OVER (ORDER BY run) AS upto FROM e GROUP BY run),
p AS (SELECT user_id, min(ts) AS observed_at, arg_min(value, ts) AS prediction, min(run) AS run FROM e WHERE event_type = 'view' GROUP BY user_id),
x AS (SELECT p.*, (SELECT min(w.run) FROM w WHERE w.run >= p.run AND w.upto >= p.observed_at + INTERVAL 6 DAY) AS gone FROM p),
o AS (SELECT e.*, x.observed_at, x.prediction, x.run AS p_run, x.gone, x.user_id IS NULL OR e.run < x.run OR x.gone < e.run AS unknown FROM e LEFT JOIN x USING (user_id) WHERE event_type = 'purchase'),
r AS (SELECT *, CASE WHEN unknown THEN 'event_not_found' WHEN ts < observed_at THEN 'outcome_before_prediction' WHEN value <= 0 THEN 'invalid_target' END AS reason FROM o),
m AS (SELECT user_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY user_id, reason IS NULL ORDER BY ts, event_id) > 1 THEN 'duplicate_outcome' ELSE reason END AS reason_code, run FROM r
  UNION ALL SELECT user_id, 'event_expired', NULL FROM x WHERE gone IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = x.user_id AND r.reason IS NULL AND r.run <= x.gone))
SELECT coalesce(reason_code, 'accepted') AS reason_code, count(*) AS n, count(DISTINCT user_id) AS users FROM m GROUP BY 1""")
def _(spark, sf):
    """A user's first view waits six days for a purchase; three runs of ten days. What is late finds nothing, and what waited in vain is reported."""
    e = table(spark, sf, "events")
    # Only the first view of a user is a prediction; the others would begin anew once it has expired.
    first = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("ts"), F.min_by("value", "ts").alias("value"))
    made = first.select(F.concat(F.lit("u"), "user_id").alias("event_id"), F.lit("view").alias("source_id"), F.col("ts").alias("observed_at"), F.col("value").alias("prediction"))
    seen = e.where("event_type = 'purchase'").select(F.concat(F.lit("o"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("outcome_id"), F.concat(F.lit("u"), "user_id").alias("event_id"), F.lit("view").alias("source_id"), F.col("ts").alias("occurred_at"), F.col("value").alias("target"))
    runs = 30 // RUN_DAYS
    last = e.where("event_type = 'view'").groupBy(part_of(F.col("ts"), runs)).agg(F.max("ts").alias("ts"))  # of a run, all of whose views move the time on
    clock = last.select(F.lit("clock").alias("event_id"), F.lit("view").alias("source_id"), F.col("ts").alias("observed_at"), F.lit(1.0).alias("prediction"))
    found = in_runs(spark, "expiry", {"p": (made.unionByName(clock), "observed_at"), "o": (seen, "occurred_at")}, lambda s: outcomes.match_stream(s["p"], s["o"], ["view"], WAITS, "0 seconds"), outcomes.RESULT, runs)
    return found.where("event_id <> 'clock'").groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("users"))


@query("jon_12_interval_join_stream", f"""WITH {STREAM} SELECT o.outcome_id, p.event_id, p.prediction, o.target FROM p LEFT JOIN o ON o.event_id = p.event_id AND o.source_id = p.source_id AND o.occurred_at >= p.observed_at AND o.occurred_at <= p.observed_at + INTERVAL 12 HOUR""")
def _(spark, sf):
    """Predictions and the outcomes of their next twelve hours as two streams in three runs. A last prediction a year later moves the watermark past all others; what it matches itself is left out."""
    made, seen = predictions(spark, sf).drop("features_valid"), actuals(spark, sf).drop("number", "utc")
    late = spark.range(1).select(F.lit("end").alias("event_id"), F.lit("view").alias("source_id"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    made = made.select("event_id", "source_id", F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("prediction").cast("double").alias("prediction")).unionByName(late.select("event_id", "source_id", F.col("at").alias("observed_at"), F.lit(1.0).alias("prediction")))
    seen = seen.select("outcome_id", "event_id", "source_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.col("target").cast("double").alias("target")).unionByName(late.select(F.lit("end").alias("outcome_id"), F.lit("other").alias("event_id"), "source_id", F.col("at").alias("occurred_at"), F.lit(1.0).alias("target")))
    shape = "outcome_id string, event_id string, observed_at timestamp, occurred_at timestamp, prediction double, target double"
    found = in_runs(spark, "interval", {"p": (made, "observed_at"), "o": (seen, "occurred_at")}, lambda s: outcomes.join_outcomes_stream(s["p"], s["o"], "1 day", "12 HOURS"), shape, 3)
    return found.where("event_id <> 'end'").select("outcome_id", "event_id", "prediction", "target")


@query("str_5_prequential_metrics", A + """ SELECT outcome_id, segment, count(*) OVER w AS n, (sum(abs(p - y)) OVER w)::DOUBLE / count(*) OVER w AS mae, sqrt((sum((p - y) * (p - y)) OVER w)::DOUBLE / count(*) OVER w) AS rmse, (sum(abs(p - y)) OVER w)::DOUBLE / count(*) OVER w - (sum(abs(5000 - y)) OVER w)::DOUBLE / count(*) OVER w AS mae_delta,
sqrt((sum((p - y) * (p - y)) OVER w)::DOUBLE / count(*) OVER w) - sqrt((sum((5000 - y) * (5000 - y)) OVER w)::DOUBLE / count(*) OVER w) AS rmse_delta FROM a WINDOW w AS (PARTITION BY segment ORDER BY occurred_at, outcome_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    found = outcomes.prequential(accepted(spark, sf), "segment", ["occurred_at", "outcome_id"])
    return found.select("outcome_id", "segment", "n", "mae", "rmse", "mae_delta", "rmse_delta")


@query("str_6_rolling_last_n", A + " SELECT outcome_id, count(*) OVER w AS rolling_n, (sum(abs(p - y)) OVER w)::DOUBLE / count(*) OVER w AS rolling_mae FROM a WINDOW w AS (PARTITION BY segment ORDER BY occurred_at, outcome_id ROWS 19 PRECEDING)")
def _(spark, sf):
    return outcomes.rolling_last_n(accepted(spark, sf), "segment", ["occurred_at", "outcome_id"], 20).select("outcome_id", "rolling_n", "rolling_mae")


@query("str_7_drift_by_segment")
def _(spark, sf):
    return keyed.adwin_by_key(scored(spark, sf), "seller", ["sold_on", "row_id"])


@query("str_8_online_linear_by_segment")
def _(spark, sf):
    return rounded(keyed.online_linear_by_key(scored(spark, sf), "make", ["sold_on", "row_id"], ["mileage", "year"], ["status"], "price", 1000.0), "mae")


def in_two_runs(spark, rows, at, build, schema, name):
    """What the stream ``build`` puts out over ``rows``, stopped and started again at the middle of ``at``."""
    from kerbside.staging import fresh_dir
    from kerbside.streaming.runs import run_available

    base, kept = fresh_dir(spark, name), written(rows, name)
    number = F.unix_date(at) if dict(rows.dtypes)[at] == "date" else F.unix_micros(at)
    middle = (quantiles(kept, {"m": number.cast("double")}, [0.5], stored=True).first()["m"] or [0.0])[0]
    for first in (True, False):
        kept.where((number < middle) == first).write.mode("append").parquet(f"{base}/in")
        run_available(build, spark.readStream.schema(kept.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c")
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("str_7_drift_stream")
def _(spark, sf):
    """Drift of every seller and of listings without one, as a stream with a stop; the same as the batch form."""
    rows = scored(spark, sf).select(F.when(F.col("seller") % 10 != 0, F.col("seller")).alias("seller"), "sold_on", "row_id", "y", "p")
    return keyed.latest(in_two_runs(spark, rows, "sold_on", lambda s: keyed.adwin_stream(s, "seller", ["sold_on", "row_id"]), keyed.DRIFT, "drift"))


@query("str_8_online_stream")
def _(spark, sf):
    """The learner of every make, as a stream with a stop; the same as the batch form."""
    rows = scored(spark, sf).select("make", "sold_on", "row_id", "mileage", "year", "status", "price")
    found = in_two_runs(spark, rows, "sold_on", lambda s: keyed.online_linear_stream(s, "make", ["sold_on", "row_id"], ["mileage", "year"], ["status"], "price", 1000.0), keyed.LEARNED, "online")
    return rounded(keyed.latest(found), "mae")


@query("str_9_stream_counters", f"""WITH {STREAM}, c AS (SELECT (SELECT count(DISTINCT event_id) FROM p) AS a, count(*) FILTER (reason_code IS NULL) AS b, count(*) FILTER (reason_code IS NOT NULL) AS d FROM m) SELECT 'predicted' AS counter, a AS n FROM c UNION ALL SELECT 'learned', b FROM c UNION ALL SELECT 'pending', a - b FROM c
UNION ALL SELECT 'processed', b + d FROM c UNION ALL SELECT 'quarantined', d FROM c UNION ALL SELECT 'quarantined:' || reason_code, count(*) FROM m WHERE reason_code IS NOT NULL GROUP BY reason_code""")
def _(spark, sf):
    return outcomes.stream_status(matched(spark, sf), predictions(spark, sf))


SUMMARY = "SELECT {start} AS window_start, count(*) FILTER (reason_code IS NULL) AS n, (sum(abs(p - y)) FILTER (reason_code IS NULL))::DOUBLE / nullif(count(*) FILTER (reason_code IS NULL), 0) AS mae, count(*) FILTER (reason_code IS NOT NULL) AS quarantined FROM {rows} GROUP BY 1"


def summaries(spark, sf, width, slide=None):
    found = outcomes.windowed_metrics(in_cents(matched(spark, sf)), "occurred_at", width, slide)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("str_11_windowed_summaries", f"{A} {SUMMARY.format(start='CAST(time_bucket(INTERVAL 1 DAY, occurred_at) AS VARCHAR)', rows='b')}")
def _(spark, sf):
    return summaries(spark, sf, "1 day")


@query("str_11_sliding_summaries", f"{A}, v AS (SELECT *, unnest([0, 1]) AS back FROM b) {SUMMARY.format(start='CAST(time_bucket(INTERVAL 1 DAY, occurred_at) - to_days(back) AS VARCHAR)', rows='v')}")
def _(spark, sf):
    return summaries(spark, sf, "2 days", "1 day")


@query("str_11_late_rows", f"""{A}, v AS (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(occurred_at AS DATE)) // 10, 2) AS own FROM b),
x AS (SELECT *, CASE WHEN CAST(substr(outcome_id, 2) AS BIGINT) % 4 = 0 THEN least(own + 1, 2) ELSE own END AS run FROM v), w AS (SELECT run, max(max(occurred_at)) OVER (ORDER BY run) - INTERVAL 1 DAY AS mark FROM x GROUP BY run),
y AS (SELECT x.*, time_bucket(INTERVAL 1 DAY, occurred_at) AS start, coalesce(time_bucket(INTERVAL 1 DAY, occurred_at) + INTERVAL 1 DAY <= w.mark, false) AS late FROM x LEFT JOIN w ON w.run = x.run - 1)
SELECT CAST(start AS VARCHAR) AS window_start, count(*) FILTER (reason_code IS NULL) AS n, (sum(abs(p - y)) FILTER (reason_code IS NULL))::DOUBLE / nullif(count(*) FILTER (reason_code IS NULL), 0) AS mae, count(*) FILTER (reason_code IS NOT NULL) AS quarantined FROM y WHERE NOT late GROUP BY start
UNION ALL SELECT 'late', count(*) FILTER (late), NULL, 0 FROM y""")
def _(spark, sf):
    """Daily summaries as a stream of three runs, in which every fourth outcome comes a run late: windows that the watermark has closed do not take it, and it is counted. A last row a year later closes all windows."""
    rows = in_cents(matched(spark, sf)).select("outcome_id", "occurred_at", "p", "y", "reason_code").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    own = part_of(F.col("occurred_at"), 3)
    rows = written(rows.withColumn("run", F.when(F.substring("outcome_id", 2, 30).cast("long") % 4 == 0, F.least(own + 1, F.lit(2))).otherwise(own)), "late-rows")
    end = spark.range(1).select(F.lit("end").alias("outcome_id"), F.lit("2026-01-01").cast("timestamp").alias("occurred_at"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("y"), F.lit(None).cast("string").alias("reason_code"), F.lit(3).cast("long").alias("run"))
    found = in_runs(spark, "late", {"m": (rows.unionByName(end), F.col("run"))}, lambda s: outcomes.windowed_metrics(s["m"], "occurred_at", "1 day", late="1 day"), "window_start timestamp, n long, mae double, quarantined long", 4)
    closed = written(found.where("window_start < '2026-01-01'").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), "late-windows")
    counted = closed.agg(F.coalesce(F.sum(F.col("n") + F.col("quarantined")), F.lit(0)).alias("c"))
    late = rows.agg(F.count(F.lit(1)).alias("t")).join(F.broadcast(counted)).select(F.lit("late").alias("window_start"), (F.col("t") - F.col("c")).alias("n"), F.lit(None).cast("double").alias("mae"), F.lit(0).cast("long").alias("quarantined"))
    return closed.unionByName(late)


#: What a listing's status can be.
STATUSES = ["Certified", "New", "Used"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Rejection cascade, deduplication, group holdout, a median baseline fitted on the training rows, and its errors by status on the test rows.

    What follows sees of the listings that are equal in make, model, year, status and price only one, so these are told apart early, before any text is with
    them: for make and model stands the least of the parts that have both (``kind``), for the status its place in ``STATUSES``.
    """
    from kerbside.operators.splits import closest_prefix_groups

    c = F.col
    code = reduce(lambda x, k: x.when(c("status") == STATUSES[k], k), range(1, len(STATUSES)), F.when(c("status") == STATUSES[0], 0)).cast("byte")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", status(), mileage(), c("l_extendedprice").alias("price"))
    line = rules.with_reason(line, [("mileage_invalid", c("mileage") > 49_000), ("price_invalid", c("price") <= 0)]).where("reason_code is null").select("l_orderkey", "l_partkey", code.alias("code"), "price")
    part = table(spark, sf, "part").select("p_partkey", c("p_brand").alias("make"), model())
    named = written(part.groupBy("make", "model").agg(F.min("p_partkey").alias("kind")), "flagship-kinds")
    other = named.select(c("make").alias("__make"), c("model").alias("__model"), "kind")
    kinds = written(part.join(other, c("make").eqNullSafe(c("__make")) & (c("model") == c("__model"))).select("p_partkey", "kind"), "flagship-parts")
    order = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("short").alias("year"))
    rows = line.join(order, c("l_orderkey") == c("o_orderkey")).join(kinds, c("l_partkey") == c("p_partkey")).select("kind", "year", "code", "price")
    kept = written(rows.distinct().select("kind", "code", "price"), "flagship")
    sized = written(kept.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n")).join(named, "kind").withColumn("status", F.get(F.array(*map(F.lit, STATUSES)), c("code"))), "flagship-groups")
    chosen = closest_prefix_groups(sized, ["make", "model"], "status", 1, 5, "holdout", "n").select(c("status").alias("__status"), c("make").alias("__make"), c("model").alias("__model"), "selected")
    groups = sized.join(chosen, (c("status") == c("__status")) & c("make").eqNullSafe(c("__make")) & (c("model") == c("__model"))).select("kind", "code", "make", "status", "selected")
    split = written(kept.join(groups, ["kind", "code"]).select("make", "status", "price", "selected"), "flagship-split")
    train = split.where("not selected")
    baseline = with_quantiles(train.select(c("make").alias("__make")).distinct(), train.select(c("make").alias("__make"), "price"), {"p": (c("price"), 0.5)}, ["__make"])
    test = split.where("selected").join(baseline, c("make") == c("__make")).withColumn("y", c("price"))
    return tidy(evaluate.slice_metrics(test, "status"))


query("flagship_holdout_baseline", f"""{L}, v AS (SELECT * FROM listings WHERE (mileage IS NULL OR mileage <= 49000) AND price > 0),
d AS (SELECT make, model, status, price FROM v QUALIFY row_number() OVER (PARTITION BY make, model, year, status, price ORDER BY row_id) = 1),
g AS (SELECT status, make, model, count(*) AS n, sha256(concat_ws('|', 'holdout', status, make, model)) AS h FROM d GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY status ORDER BY h) AS running, row_number() OVER (PARTITION BY status ORDER BY h) AS rank, sum(n) OVER (PARTITION BY status) AS total FROM g),
c AS (SELECT status, abs(running * 5 - total) AS off, rank FROM r UNION ALL SELECT status, max(total), 0 FROM r GROUP BY status), b AS (SELECT status, arg_min(rank, (off, rank)) AS cut FROM c GROUP BY status),
s AS (SELECT d.*, r.rank <= b.cut AS selected FROM d JOIN r USING (status, make, model) JOIN b USING (status)), f AS (SELECT make, median(price) AS p FROM s WHERE NOT selected GROUP BY make),
t AS (SELECT status, price AS y, f.p FROM s JOIN f USING (make) WHERE selected) SELECT status AS label, CAST(grouping(status) AS INTEGER) AS overall, {METRICS} FROM t GROUP BY GROUPING SETS ((), (status))""")(flagship)


FILES = 4


def half_files(spark, sf, folder):
    """Each half of the events (by time, whose middle is found once) as ``FILES`` more files below ``folder``; yields when one is there."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    events = table(spark, sf, "events")
    middle = quantiles(events, {"m": at}, [0.5], stored=True).first()["m"] or [0.0]
    for first in (True, False):
        events.where((at < middle[0]) == F.lit(first)).repartition(FILES).write.mode("append").parquet(folder)
        yield first


def match_events(source: DataFrame) -> DataFrame:
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    event = F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    made = source.where("event_type in ('view', 'click')").select(event.alias("event_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("observed_at"), F.col("value").alias("prediction"))
    seen = source.where("event_type = 'purchase'").select(F.concat(F.lit("o"), "event_id").alias("outcome_id"), event.alias("event_id"), F.lit("view").alias("source_id"), F.col("ts").alias("occurred_at"), F.col("value").alias("target"))
    return outcomes.match_stream(made, seen, ["view"])


@query("str_4_10_stateful_stream_with_restart")
def _(spark, sf):
    """Reasons of the stateful matcher over two batches in one run, and over the same two with a stop between them."""
    from kerbside.staging import fresh_dir
    from kerbside.streaming.runs import run_available, start_available

    base, schema = fresh_dir(spark, "stream"), table(spark, sf, "events").schema
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{base}/in")
    for first in half_files(spark, sf, f"{base}/in"):
        if first:
            run_available(match_events, read(), f"{base}/restarted", f"{base}/c1")
    # The run that goes on and the whole one share nothing but the files, so one plans while the other works.
    for begun in [start_available(match_events, read(), f"{base}/{out}", f"{base}/{kept}") for out, kept in (("restarted", "c1"), ("whole", "c2"))]:
        begun.awaitTermination()
    count = lambda name: spark.read.parquet(f"{base}/{name}").groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("reason_code")).agg(F.count(F.lit(1)).alias(name))
    return count("whole").join(count("restarted"), "reason_code", "full_outer")
