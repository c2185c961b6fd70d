"""Scalar functions as column expressions. Unless said otherwise null gives null and bad input gives null."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean "not given", time zone names with their offsets, and the characters of a VIN.
MISSING_TOKENS = ["", "unknown", "n/a", "not reported"]
ZONES = {"PST": "-0800", "PDT": "-0700", "MST": "-0700", "MDT": "-0600", "CST": "-0600", "CDT": "-0500", "EST": "-0500", "EDT": "-0400"}


VIN_PATTERN = "^[A-HJ-NPR-Z0-9]{17}$"


def once(value: Column) -> Column:
    """A value that is computed once for a row, whatever reads it: no expression or filter moves through an explode."""
    return F.explode(F.array(value))


def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _nfkc(text: Column) -> Column:
    return F.pandas_udf(_nfkc_batch, "string")(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """SCA-1: NFKC and single spaces. Python (Arrow) is asked for texts outside ASCII only."""
    return collapse(F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text))


def text_reason(text: Column, max_len: int, formulas: bool = False) -> Column:
    """SCA-2: why a text is invalid: null, control characters (so all white space but spaces), empty, too long; a formula's start, if asked."""
    # Spaces are collapsed only where the text itself is too long.
    long = (F.length(text) > max_len) & (F.length(collapse(text)) > max_len)
    bad = text.isNull() | text.rlike(r"[\x00-\x1F\x7F]") | (F.trim(text) == "") | long
    start = F.trim(text)
    formula = F.lit(formulas) & (start.startswith("=") | start.startswith("@") | ((start.startswith("+") | start.startswith("-")) & (F.length(start) > 1)))
    return F.when(bad, "text_invalid").when(formula, "csv_formula_injection")


def source_text(text: Column, max_len: int, formulas: bool = False) -> Column:
    """SCA-2: a struct of ``value`` (single spaces) and ``reason`` (see :func:`text_reason`)."""
    reason = text_reason(text, max_len, formulas)
    return F.struct(F.when(reason.isNull(), collapse(text)).alias("value"), reason.alias("reason"))


def decimal_cents(text: Column) -> Column:
    """SCA-4: cents of a positive decimal text with at most two significant decimals."""
    cents = F.when(text.rlike(r"^[0-9]{1,15}(\.[0-9]{1,18})?$"), text).try_cast("decimal(38,18)") * 100
    return F.when((cents > 0) & (cents == F.floor(cents)), cents.cast("long"))


def price_text_cents(text: Column, currency: str = "USD", symbol: str = r"\$", monthly: bool = False) -> Column:
    """SCA-3: cents of a price such as ``$12,345.50``, ``USD 12,345`` or ``12345 USD``.

    Both codes, another code or symbol, badly grouped thousands, more than two decimals, and a monthly mark
    where the kind is not monthly (or the other way round) are invalid.
    """
    shape = rf"^(?:({currency}) )?(?:{symbol} ?)?([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(\.[0-9]{{1,2}})?(?: ({currency}))?(/mo)?$"
    part = lambda k: F.regexp_extract(F.trim(text), shape, k)
    ok = F.trim(text).rlike(shape) & ~((part(1) != "") & (part(4) != "")) & ((part(5) != "") == monthly)
    return F.when(ok, decimal_cents(F.concat(F.replace(part(2), F.lit(",")), part(3))))


def integral(text: Column) -> Column:
    """SCA-5: a whole number, also written with zero decimals."""
    return F.when(text.rlike(r"^[0-9]{1,18}(\.0+)?$"), F.split_part(text, F.lit("."), F.lit(1)).cast("long"))


def optional_int(text: Column) -> Column:
    """SCA-6: a struct of ``value`` and ``valid``: missing tokens are null and valid; units, commas and white space are dropped.

    The rest must be whole, with a sign if any, and fit an integer.
    """
    bare = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    digits = F.regexp_extract(F.regexp_replace(bare, r"[,\s]", ""), r"^([+\-]?[0-9]+)((?:mi|miles|owners?|accidents?)\.?)?$", 1)
    number = F.nullif(digits, F.lit("")).try_cast("int")
    missing = bare.isin(MISSING_TOKENS)
    return F.struct(F.when(~missing, number).alias("value"), (missing | number.isNotNull()).alias("valid"))


def odometer(text: Column, sentinel: int = 999999) -> Column:
    """SCA-7: a whole number, null at the sentinel."""
    return F.nullif(integral(text), F.lit(sentinel).cast("long"))


def mileage_text(text: Column) -> Column:
    """SCA-8: ``51,000 mi.``"""
    return F.regexp_extract(F.when(text.rlike(r"^[0-9]{1,3}(,[0-9]{3})* mi\.$"), F.replace(text, F.lit(","))), r"^[0-9]+", 0).cast("int")


def condition_grade(text: Column) -> Column:
    """SCA-9: 1 to 5 as it is, whole numbers 11 to 49 divided by ten, nothing else."""
    x = F.when(text.rlike(r"^[0-9]{1,2}(\.[0-9])?$"), text).try_cast("decimal(4,1)")
    return F.when((x >= 1) & (x <= 5), x.cast("decimal(3,1)")).when((x >= 11) & (x <= 49) & (x == F.floor(x)), (x / 10).cast("decimal(3,1)"))


def _sale_part(text: Column, k: int) -> Column:
    return F.regexp_extract(text, r"^(\w{3}) (\w{3}) (\d{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) GMT([+\-]\d{4}) \(([A-Z]{3})\)$", k)


def sale_local_date(text: Column) -> Column:
    """SCA-11: the local date of a sale text, null if there is no such day."""
    month = F.array_position(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), _sale_part(text, 2)).cast("int")
    return F.try_make_timestamp(_sale_part(text, 4).try_cast("int"), month, _sale_part(text, 3).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("date")


def sale_timestamp(text: Column) -> Column:
    """SCA-10: the instant (UTC) of ``Tue Dec 16 2014 12:30:00 GMT-0800 (PST)``; weekday and zone name must agree with it."""
    day = sale_local_date(text)
    zone = F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), _sale_part(text, 9))
    offset = _sale_part(text, 8)
    minutes = F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int"))
    seconds = _sale_part(text, 5).try_cast("int") * 3600 + _sale_part(text, 6).try_cast("int") * 60 + _sale_part(text, 7).try_cast("int")
    ok = (_sale_part(text, 5) < "24") & (_sale_part(text, 6) < "60") & (_sale_part(text, 7) < "60") & (F.date_format(day, "EEE") == _sale_part(text, 1)) & (zone == offset)
    return F.when(ok, F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds - minutes * 60))


def vin(text: Column) -> Column:
    """SCA-12: upper-case, 17 characters without I, O and Q."""
    value = F.upper(F.trim(text))
    return F.when(value.rlike(VIN_PATTERN), value)


def closed_domain(text: Column, values: list[str], fold: bool = True) -> Column:
    """SCA-13: the text if it is one of ``values``, after trimming and, if ``fold``, in lower case."""
    value = F.lower(F.trim(text)) if fold else F.trim(text)
    return F.when(value.isin(values), value)


def accident_status(text: Column) -> Column:
    """SCA-14: ``none``, ``reported`` or null by keywords."""
    value = F.lower(F.trim(text))
    return F.when(value.isin("none reported", "none", "no"), "none").when(value.contains("at least 1 accident") | value.contains("damage"), "reported")


def clean_title(text: Column) -> Column:
    """SCA-14: ``clean``, ``not_clean`` or ``unknown`` by what was said of the title; null for missing."""
    value = F.lower(F.trim(text))
    said = F.when(value.isin("yes", "y", "true", "clean"), "clean").when(value.isin("no", "n", "false", "not clean"), "not_clean").otherwise("unknown")
    return F.when(~is_missing(text), said)


def derived_id(given: Column, digest: Column) -> Column:
    """SCA-15: the given id, or one made from a content hash."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit("derived-"), F.substring(digest, 1, 24)))


def opaque_row_id(fingerprint: str, row_no: Column) -> Column:
    """SCA-16: a hash of the source's fingerprint and the row number, never of values."""
    return F.sha2(F.concat_ws(":", F.lit(fingerprint), row_no.cast("string")), 256)


def content_hash(*columns: Column) -> Column:
    """SCA-17: SHA-256 of the columns in order, with marks for null and between columns."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def keyed_hash(salt: str, key: Column) -> Column:
    """SCA-18: HMAC-SHA-256 of a private key under a salt, so that keys never persist: two digests over padded salts."""
    block = salt.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    pad = lambda mask: F.lit(bytes(x ^ mask for x in block))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), key.cast("string").cast("binary")), 256))), 256)


def canonical_url(given: Column, prefix: str, key: Column) -> Column:
    """SCA-19: the given URL, or the prefix and the percent-encoded key."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit(prefix), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))))


def age_years(year: Column, reference: int) -> Column:
    """SCA-20: age from a model year, never negative."""
    return F.greatest(F.lit(reference) - year, F.lit(0))


def mileage_per_year(mileage: Column, year: Column, reference: int) -> Column:
    return mileage.cast("double") / F.greatest(age_years(year, reference), F.lit(1))


def numeric_band(value: Column, cuts: list[float], labels: list[str], missing: str = "missing") -> Column:
    """SCA-21: the first band whose cutpoint is not below the value, the last one beyond all; null has its own label."""
    band = F.when(value.isNull(), missing)
    for cut, label in zip(cuts, labels):
        band = band.when(value <= cut, label)
    return band.otherwise(labels[len(cuts)])


def interval_label(value: Column, edges: list[float]) -> Column:
    """SCA-22: ``(a, b]`` of the right-closed bin; the lowest edge belongs to the first bin; outside is null."""
    label = F.when(value == edges[0], f"({edges[0]:g}, {edges[1]:g}]")
    for a, b in zip(edges, edges[1:]):
        label = label.when((value > a) & (value <= b), f"({a:g}, {b:g}]")
    return label


def date_bucket(day: Column, starts: list[tuple[str, str]]) -> Column:
    """SCA-23: the name of the last range that has begun, from ordered (start, name); null before the first."""
    bucket = None
    for start, name in reversed(starts):
        bucket = F.when(day >= F.lit(start).cast("date"), name) if bucket is None else bucket.when(day >= F.lit(start).cast("date"), name)
    return bucket


def is_missing(value: Column) -> Column:
    """SCA-24: null or blank."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def percent(part: Column, whole: Column) -> Column:
    """SCA-24: a percentage rounded to six places, 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 6)).otherwise(0.0)


def json_kind(text: Column) -> Column:
    """SCA-25: ``array``, ``not_array`` or ``invalid`` JSON; null for missing."""
    return F.when(is_missing(text), None).when(F.json_array_length(text).isNotNull(), "array").when(F.try_parse_json(text).isNotNull(), "not_array").otherwise("invalid")


def json_flags(text: Column) -> Column:
    """SCA-25: the elements of a JSON array as an array of texts (empty: of other or no JSON)."""
    return F.coalesce(F.from_json(F.when(json_kind(text) == "array", text), "array<string>"), F.array().cast("array<string>"))


def utc_or_null(text: Column) -> Column:
    """SCA-26: a timestamp, or null for what is none."""
    return F.try_to_timestamp(text)


def zip_ok(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{5}$"), F.lit(False))


def smooth_scale(price: Column) -> Column:
    """SCA-27: 1 + log1p(p / 10000), a slowly growing scale."""
    return 1 + F.log1p(F.greatest(price, F.lit(0.0)) / 10000)


def log_value(price: Column) -> Column:
    """SCA-27: log1p(p / 10000)."""
    return F.log1p(F.greatest(price, F.lit(0.0)) / 10000)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def confidence_label(relative_width: Column, support: Column, low: float, high: float, least: int = 1000) -> Column:
    """SCA-28: narrow and well supported is ``high``, wide is ``low``."""
    return F.when((relative_width <= low) & (support >= least), "high").when(relative_width <= high, "moderate").otherwise("low")


def quality_warnings(mileage: Column, unseen: Column, most: int = 300_000) -> Column:
    """SCA-29: an array of what makes a valuation doubtful."""
    return F.array_compact(F.array(F.when(mileage.isNull(), "missing_mileage"), F.when(unseen, "unseen_category"), F.when(mileage > most, "unsupported_combination")))


def online_features(year: Column, mileage: Column, condition: Column, owners: Column, reference: int) -> Column:
    """SCA-30: the features of one event; missing counts are 0 with a flag, missing categories a word of their own."""
    return F.struct(age_years(year, reference).cast("double").alias("age"), F.coalesce(mileage_per_year(mileage, year, reference), F.lit(0.0)).alias("mileage_per_year"), F.coalesce(owners.cast("double"), F.lit(0.0)).alias("owner_count"), F.when(owners.isNull(), "1").otherwise("0").alias("owner_count_missing"), F.coalesce(condition, F.lit("__missing__")).alias("condition"))


def identifier_ok(text: Column) -> Column:
    """SCA-31: letters, digits, dot, dash, underscore and colon, 1 to 128 of them."""
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:\-]{0,127}$"), F.lit(False))


def client_hash(client: Column) -> Column:
    """SCA-31: a hashed client id, null unless it is a UUID."""
    value = F.lower(client)
    return F.when(value.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.sha2(value, 256))
