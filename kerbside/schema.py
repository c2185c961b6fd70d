"""Canonical schemas and the feature contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(required: dict, optional: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required.items()] + [T.StructField(n, t, True) for n, t in optional.items()])


#: One accepted listing; prices are whole cents.
LISTING_SCHEMA = _struct(
    {"source_id": _S, "source_listing_id": _S, "canonical_url": _S, "observed_at": _TS, "market_country": _S, "year": _I, "make": _S, "model": _S, "mileage_unit": _S, "price_cents": _L, "currency": _S, "price_kind": _S, "sale_status": _S, "raw_content_sha256": _S, "parser_version": _S, "normalization_version": _S, "ingestion_run_id": _S, "authorization_policy_id": _S},
    {"trim": _S, "mileage": _I, "condition": _S, "vehicle_status": _S, "engine": _S, "drivetrain": _S, "accident_status": _S, "accident_count": _I, "owner_count": _I, "vehicle_type": _S},
)
#: One rejected row: ids, a reason and a digest, never the row itself.
QUARANTINE_SCHEMA = _struct(
    {"source_id": _S, "page_url": _S, "observed_at": _TS, "reason_code": _S, "message": _S, "raw_content_sha256": _S, "parser_version": _S, "ingestion_run_id": _S, "authorization_policy_id": _S},
    {"source_listing_id": _S},
)


@dataclass(frozen=True)
class FeatureContract:
    """Which columns a model may read, in order, and which of them must be there."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    target: str = "price"
    reference_year: int = 2002
    min_frequency: int = 25
    max_categories: int = 512

    @property
    def columns(self) -> tuple[str, ...]:
        return self.required + self.optional

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` in contract order. Unknown or missing columns are an error; the target is not a feature."""
        names = [c for c in df.columns if c != self.target]
        if unknown := sorted(set(names) - set(self.columns)):
            raise ValueError(f"columns outside the contract: {unknown}")
        if missing := sorted(set(self.required) - set(names)):
            raise ValueError(f"required columns are missing: {missing}")
        return df.select(*[c for c in self.columns if c in names])


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` itself if its names and types are those of ``schema``, in order; else an error."""
    have, want = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (df.schema, schema))
    if have != want:
        raise ValueError(f"schema differs: {[x for x in have if x not in want]} instead of {[x for x in want if x not in have]}")
    return df
