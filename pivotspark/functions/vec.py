"""Column expressions over dense vectors stored as ``array<float|double>``.

Everything here is a built-in higher-order function (``transform``,
``zip_with``, ``aggregate``), so it stays JVM-side and needs no UDF.
Reductions that run *across rows* (centroids, weighted sums) are not here:
they are posexplode + groupBy aggregates in ``operators.vectors`` so that
Spark can combine them map-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed epsilons of the reference semantics.
EPS_COSINE = 1e-12      # added to the norm product of a cosine
EPS_DIRECTION = 1e-8    # added to a direction's norm before normalising
EPS_EXPORT = 1e-12      # floor of the norm when exporting unit vectors


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(v) -> Column:
    """array<float> -> array<double> (exact widening)."""
    return F.transform(col(v), lambda x: x.cast("double"))


def to_float(v) -> Column:
    return F.transform(col(v), lambda x: x.cast("float"))


def vsum(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def _spread(c, like) -> Column:
    """A scalar as an array as long as ``like``.

    Expressions captured inside a lambda are evaluated once per element
    (higher-order functions are interpreted, with no common-subexpression
    elimination), so a computed scalar such as a norm must enter the lambda
    as an argument: it is evaluated once here, not d times."""
    return F.array_repeat(c, F.size(col(like)))


def scale(v, c) -> Column:
    if not isinstance(c, Column):
        return F.transform(col(v), lambda x: x.cast("double") * F.lit(float(c)))
    return F.zip_with(col(v), _spread(c.cast("double"), v), lambda x, s: x.cast("double") * s)


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") + y.cast("double"))


def sub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))


def axpy(h, v, c) -> Column:
    """h + c * v (element-wise)."""
    return F.zip_with(col(h), scale(v, c), lambda x, y: x.cast("double") + y)


def cosine(a, b, eps: float = EPS_COSINE) -> Column:
    """dot(a, b) / (|a| |b| + eps) in float64."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def unit(v, eps: float = EPS_DIRECTION) -> Column:
    """v / (|v| + eps)."""
    return scale(v, F.lit(1.0) / (norm(v) + F.lit(eps)))


def unit_export(v, floor: float = EPS_EXPORT) -> Column:
    """v / max(floor, |v|) — the export convention for unit vectors."""
    return scale(v, F.lit(1.0) / F.greatest(norm(v), F.lit(floor)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def max_elem(v) -> Column:
    return F.array_max(col(v))


def log_softmax_at(logits, idx) -> Column:
    """log_softmax(logits)[idx], ``idx`` 0-based, computed stably with a
    single online log-sum-exp pass (running max and rescaled sum), so no
    row-level value is captured inside the lambda."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        x = x.cast("double")
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    lse = F.aggregate(col(logits), init, step, lambda a: a["m"] + F.log(a["s"]))
    picked = F.element_at(col(logits), col(idx).cast("int") + 1).cast("double")
    return picked - lse


def round_vec(v, digits: int = 6) -> Column:
    return F.transform(col(v), lambda x: F.round(x.cast("double"), digits))
