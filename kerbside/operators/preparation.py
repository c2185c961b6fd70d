"""Fold-local preparation as an estimator: what it learns comes from the rows it is fitted on, and nothing else."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kerbside.operators.quantiles import quantiles
from kerbside.staging import written

MISSING, INFREQUENT, TIMES = "__missing__", "__infrequent__", "__times"


def category(value: Column) -> Column:
    """The label of a value: its text without spaces around; null and blank are missing."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(MISSING))


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of features", TypeConverters.toString)
    minFrequency = Param(Params._dummy(), "minFrequency", "rows that a category needs for a level of its own", TypeConverters.toInt)
    timesCol = Param(Params._dummy(), "timesCol", "column with the number of rows that a row stands for", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "levels of a column at most, the infrequent one included", TypeConverters.toInt)


class Preparation(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """MOD-5 over MOD-2/3/4: numbers get the median where they are missing and are divided by their deviation; categories become one-hot levels.

    A category with fewer than ``minFrequency`` rows, or beyond the ``maxCategories`` most frequent (ties by
    name), falls into one infrequent level. The driver sees a median and a deviation for each number and at most
    ``maxCategories`` labels of each category. With ``timesCol`` a row stands for that many: what is learned is that of the rows themselves.
    """

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None, outputCol="features", minFrequency=25, maxCategories=512, timesCol=None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], outputCol="features", minFrequency=25, maxCategories=512)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PreparationModel:
        numeric, categorical, most = self.getOrDefault("numeric"), self.getOrDefault("categorical"), self.getOrDefault("maxCategories")
        counted = self.isDefined("timesCol")
        rows = written(df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[category(F.col(c)).alias(c) for c in categorical], *([F.col(self.getOrDefault("timesCol")).alias(TIMES)] if counted else [])), "preparation")
        medians, scales = {}, {}
        if numeric:
            middle = quantiles(rows, {f"q{k}": F.col(c) for k, c in enumerate(numeric)}, [0.5], weight=TIMES if counted else None, stored=True).first()
            medians = {c: float(middle[f"q{k}"][0]) if middle[f"q{k}"] and middle[f"q{k}"][0] is not None else 0.0 for k, c in enumerate(numeric)}
            filled = {c: _filled(F.col(c), medians[c]) for c in numeric}
            found = _deviations(rows, filled, TIMES) if counted else rows.agg(*[F.stddev_pop(filled[c]).alias(c) for c in numeric]).first()
            scales = {c: float(found[c] or 1.0) for c in numeric}
        labels = {c: self._labels(rows, c, most) for c in categorical}
        model = PreparationModel(medians, scales, labels)
        return self._copyValues(model)

    def _labels(self, rows: DataFrame, column: str, most: int) -> list[str]:
        """The column's levels in order of their names, the infrequent one last."""
        counts = written(rows.groupBy(F.col(column).alias("label")).agg((F.sum(TIMES) if self.isDefined("timesCol") else F.count(F.lit(1))).alias("n")), "preparation-labels")
        total = counts.count()
        often = counts.where(F.col("n") >= self.getOrDefault("minFrequency"))
        room = most if total <= most and often.count() == total else most - 1
        kept = sorted(r["label"] for r in often.orderBy(F.desc("n"), "label").limit(room).collect())
        return kept + [INFREQUENT] if len(kept) < total else kept


def _deviations(rows: DataFrame, values: dict[str, Column], times: str) -> Row:
    """The population deviation of each of ``values``, a row counted ``times``: around the means, which come first."""
    means = rows.agg(*[(F.sum(v * F.col(times)) / F.sum(times)).alias(c) for c, v in values.items()]).first()
    return rows.agg(*[F.sqrt(F.sum(F.pow(v - (means[c] or 0.0), 2) * F.col(times)) / F.sum(times)).alias(c) for c, v in values.items()]).first()


def _filled(value: Column, median: float) -> Column:
    """A number that is there and finite, or the median."""
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(median))


class PreparationModel(Model, _Columns, MLWritable, MLReadable):
    """What :class:`Preparation` has learned. A label that it does not know is infrequent, if there is such a level, and all zeros otherwise."""

    def __init__(self, medians: dict[str, float] | None = None, scales: dict[str, float] | None = None, labels: dict[str, list[str]] | None = None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], outputCol="features", minFrequency=25, maxCategories=512)
        self.medians, self.scales, self.labels = medians or {}, scales or {}, labels or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        out, numeric, categorical = self.getOrDefault("outputCol"), self.getOrDefault("numeric"), self.getOrDefault("categorical")
        made = {f"__n{k}": _filled(F.col(c).cast("double"), self.medians[c]) / F.lit(self.scales[c]) for k, c in enumerate(numeric)}
        for k, c in enumerate(categorical):
            label = category(F.col(c))
            known = [x for x in self.labels[c] if x != INFREQUENT]
            made[f"__c{k}"] = F.when(label.isin(known), label).otherwise(INFREQUENT) if len(known) < len(self.labels[c]) else label
        rows = (df.withColumns(made) if made else df).drop(out)
        parts = [f"__n{k}" for k in range(len(numeric))]
        used = [k for k, c in enumerate(categorical) if self.labels[c]]
        if used:
            for k in used:
                rows = StringIndexerModel.from_labels(self.labels[categorical[k]], f"__c{k}", f"__i{k}", handleInvalid="keep").transform(rows)
            hot = OneHotEncoder(inputCols=[f"__i{k}" for k in used], outputCols=[f"__v{k}" for k in used], dropLast=True, handleInvalid="error")
            rows = hot.fit(rows).transform(rows)  # sizes come from the labels, not from the rows
            parts += [f"__v{k}" for k in used]
        rows = VectorAssembler(inputCols=parts, outputCol=out).transform(rows)
        return rows.select(*[c for c in df.columns if c != out], out)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: PreparationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        state = {"medians": self.model.medians, "scales": self.model.scales, "labels": self.model.labels}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": json.dumps(state)})


class _ModelReader(MLReader):
    def __init__(self, cls: type[PreparationModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PreparationModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(**json.loads(metadata["state"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
