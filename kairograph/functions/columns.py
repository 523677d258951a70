"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairograph.functions.scalars import normalize
from kairograph.types import OPEN

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
SECONDS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def instant(text: str | None) -> Column:
    """A timestamp literal of a canonical text; None is the open end."""
    return F.lit(OPEN if text is None else normalize(text)).cast("timestamp")


def normalized(text: str | Column) -> Column:
    """Canonical text of a timestamp text: whole seconds are widened, anything else is null."""
    t = _c(text)
    return F.when(t.rlike(CANONICAL), t).when(t.rlike(SECONDS), F.concat(F.substring(t, 1, 19), F.lit(".000000Z")))


def parsed(text: str | Column) -> Column:
    """Timestamp of a canonical text; null where the text or its date isn't valid."""
    return F.try_to_timestamp(normalized(text), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))


def formatted(ts: str | Column) -> Column:
    """Canonical text of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def reading(ts: str | Column) -> Column:
    """Canonical text of a clock's reading: a clock doesn't stand before 1970."""
    return formatted(F.greatest(_c(ts), F.lit("1970-01-01T00:00:00Z").cast("timestamp")))


def valid_at(ts: Column, valid_from: str | Column = "valid_from", valid_to: str | Column = "valid_to") -> Column:
    """valid_from <= ts < valid_to."""
    return (_c(valid_from) <= ts) & (ts < _c(valid_to))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    return F.greatest(from_a, from_b) < F.least(to_a, to_b)


def is_open(valid_to: str | Column = "valid_to") -> Column:
    return _c(valid_to) == instant(None)


def weight_ok(weight: str | Column = "weight") -> Column:
    w = _c(weight)
    return w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < F.lit(float("inf")))


def id_ok(id_: str | Column) -> Column:
    i = _c(id_)
    return i.isNotNull() & (F.length(i) > 0) & ~i.contains("|")


def edge_type_ok(edge_type: str | Column = "edge_type") -> Column:
    return _c(edge_type).rlike("^[A-Z0-9]+$")


def edge_filter(min_weight: float | None = None, edge_types: Iterable[str] = ()) -> Column:
    """Floor of the weight and list of types; an empty list lets all types through."""
    types = list(edge_types)
    kept = F.lit(True) if min_weight is None else F.col("weight") >= float(min_weight)
    return kept & F.col("edge_type").isin(types) if types else kept


def edge_key() -> Column:
    """Name of an edge belief in the log."""
    return F.concat_ws("|", "source_id", "target_id", "edge_type", formatted("valid_from"))


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cos, in double; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
