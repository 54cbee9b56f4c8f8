"""Vector functions as Columns. Sums run in DOUBLE, element after element, so results don't depend on the platform.

Null arrays give null; arrays of different length give null (zip_with pads with null); empty arrays have length 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Below this product of lengths a cosine is undefined; the distance is then 1.
TINY = 1e-30


def _fold(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def magnitude(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def normalize(a: Column) -> Column:
    """Unit vector of a as ARRAY<DOUBLE>; null for a vector of length zero, where no direction exists."""
    n = magnitude(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def cosine(a: Column, b: Column) -> Column:
    d = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(d < TINY, F.lit(1.0)).otherwise(1.0 - dot(a, b) / d)


def unit_cosine(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b)


def sqeuclidean(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine, "unit_cosine": unit_cosine, "sqeuclidean": sqeuclidean, "euclidean": euclidean}


@dataclass(frozen=True)
class CustomMetric:
    """A metric of the caller's: column, a function of two Columns, for declarative plans, and kernel, which gives the distances of all rows of one matrix to
    all rows of another as a matrix, for neighbours by blocks and for graphs. Both must agree."""

    column: Callable[[Column, Column], Column]
    kernel: Callable

    def __call__(self, a: Column, b: Column) -> Column:
        return self.column(a, b)


def metric(name_or_function) -> Callable[[Column, Column], Column]:
    """A metric by name, or any function of two Columns (a pandas_udf too) as it is."""
    if callable(name_or_function):
        return name_or_function
    try:
        return METRICS[name_or_function]
    except KeyError:
        raise ValueError(f"unknown metric {name_or_function!r}; known: {', '.join(METRICS)}") from None


def same_point(label_a, id_a, data_a, label_b, id_b, data_b) -> Column:
    """Equality of points: label, id and every element (NaN equals NaN)."""
    return label_a.eqNullSafe(label_b) & id_a.eqNullSafe(id_b) & data_a.eqNullSafe(data_b)


def unusable_reason(data: Column, dim: int, zero_ok: bool = False) -> Column:
    """Why a vector can't be indexed, or null if it can: null, empty, dimension, null_element, not_finite, zero."""
    x = lambda f: F.exists(data, f)
    odd = lambda e: F.isnan(e) | (F.abs(e) == float("inf"))
    r = F.when(data.isNull(), "null").when(F.size(data) == 0, "empty").when(F.size(data) != dim, "dimension")
    r = r.when(x(lambda e: e.isNull()), "null_element").when(x(odd), "not_finite")
    return r if zero_ok else r.when(F.forall(data, lambda e: e == 0), "zero")


#: Bodies of the SQL functions; $T is the element type. The same sums as above, in the same order.
_SQL = {
    "vec_dot": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)",
    "vec_sqeuclidean": "aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (s, x) -> s + x)",
    "vec_euclidean": "sqrt(vec_sqeuclidean(a, b))",
    "vec_unit_cosine": "1 - vec_dot(a, b)",
    "vec_cosine": f"CASE WHEN sqrt(vec_dot(a, a)) * sqrt(vec_dot(b, b)) < {TINY} THEN 1D ELSE 1 - vec_dot(a, b) / (sqrt(vec_dot(a, a)) * sqrt(vec_dot(b, b))) END",
}


def register(spark: SparkSession) -> None:
    """Make vec_dot, vec_cosine, vec_unit_cosine, vec_sqeuclidean, vec_euclidean (a, b), vec_magnitude and vec_normalize (a) callable from SQL.

    They are SQL functions, which the optimizer puts into the plan as plain expressions; no Python runs.
    """
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_magnitude(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(vec_dot(a, a))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN CASE WHEN vec_dot(a, a) > 0 THEN transform(a, x -> x / sqrt(vec_dot(a, a))) END")
