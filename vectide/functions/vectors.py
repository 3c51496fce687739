"""Vector expressions: preparation (P1-P4), distances (D1-D9) and integer kernels, all as Catalyst expressions.

Every coordinate is widened to DOUBLE before arithmetic and sums run from left to right. Ranking keys are narrowed to
FLOAT, so near-ties resolve by id as they do where scores are 32 bits wide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from vectide.errors import require

L2, IP, COSINE = "squared-l2", "inner-product", "cosine"
# Names under which the metrics are known.
ALIASES = {"l2": L2, "squared_l2": L2, "squared-l2": L2, "ip": IP, "mips": IP, "inner_product": IP, "inner-product": IP, "cosine": COSINE}


def metric_of(name: str) -> str:
    require(name in ALIASES, "metric", "unknown metric", name=name)
    return ALIASES[name]


def lower_is_better(metric: str) -> bool:
    return metric_of(metric) == L2


def wide(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))


def squared_l2(a, b) -> Column:
    return total(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b) -> Column:
    """Clamped to [-1, 1]; null for a zero vector."""
    return cosine_by(dot(a, b), norm(a) * norm(b))


def cosine_by(product: Column, norms: Column) -> Column:
    """The cosine of two vectors by their inner product and the product of their norms."""
    bounded = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    return F.element_at(F.transform(F.array(F.try_divide(product, norms)), bounded), 1)  # so that the product is summed once


def score(metric: str, q, v) -> Column:
    """The score as users see it: squared L2 (lower is better), inner product or cosine (higher is better)."""
    return {L2: squared_l2, IP: dot, COSINE: cosine}[metric_of(metric)](q, v)


def rank_key(metric: str, value: Column) -> Column:
    """Ascending key of a score: narrowed to FLOAT, and -0 made +0."""
    narrow = value.cast("float")
    return (narrow if lower_is_better(metric) else -narrow) + F.lit(0.0).cast("float")


def calibration_distance(metric: str, q, v) -> Column:
    """Squared L2, minus the inner product, or 1 - cosine: lower is nearer for each."""
    return {L2: lambda: squared_l2(q, v), IP: lambda: -dot(q, v), COSINE: lambda: F.lit(1.0) - cosine(q, v)}[metric_of(metric)]()


def u8_cosine_distance(a, b) -> Column:
    """Build distance of native bytes, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - cosine(a, b)))


def normalized(v) -> Column:
    """L2-normalised, the norm in DOUBLE, the result FLOAT; null for a norm that is zero or not finite."""
    n = norm(v)
    ok = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(ok, F.transform(wide(v), lambda x: (x / n).cast("float")))


def all_finite(v) -> Column:
    return F.forall(wide(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fits_u8(v) -> Column:
    """Whether every coordinate is a whole number from 0 to 255."""
    return F.forall(wide(v), lambda x: (x >= 0) & (x <= 255) & (x == F.floor(x)))


def squared_norm_exact(v) -> Column:
    """Squared norm of whole numbers, as BIGINT."""
    return F.aggregate(v.cast("array<bigint>") if isinstance(v, Column) else F.col(v).cast("array<bigint>"), F.lit(0).cast("bigint"), lambda a, x: a + x * x)


def int_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed codes (arrays of BIGINT)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def early_abandon_l2(q, v, bound: Column) -> Column:
    """The squared distance if below the bound, else -1. Partial sums only grow, so where it stops is not observable."""
    d = squared_l2(q, v)
    return F.when(d < bound, d).otherwise(F.lit(-1.0))


def adsampling_l2(q, v, bound: Column, dim: int, epsilon: float = 2.1, step: int = 64) -> Column:
    """ADSampling: given up at a checkpoint d' if partial * dim / d' > bound * (1 + epsilon / sqrt(d')); then as D8."""
    gaps = F.zip_with(wide(q), wide(v), lambda x, y: (x - y) * (x - y))
    stop = F.lit(False)
    for d in range(step, dim, step):
        stop = stop | (total(F.slice(gaps, 1, d)) * (dim / d) > bound * (1 + epsilon / math.sqrt(d)))
    return F.when(stop | (total(gaps) >= bound), F.lit(-1.0)).otherwise(total(gaps))


def rotated(v, matrix: list[list[float]]) -> Column:
    """matrix times v, for a matrix small enough to stand in the plan (tests, low dimensions)."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in matrix])


def guarded(v: Column, ok: Column, message: str) -> Column:
    """v, or an error that names what is wrong."""
    return F.when(ok, v).otherwise(F.raise_error(F.lit(message)).cast("array<double>"))
