"""Vector math on ``array<float|double>`` columns with SQL higher-order functions.

All of these stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import VectorLayout


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Note on lambdas: Catalyst inlines projected columns into later projections, so a lambda
# that refers to a row-level value computed outside it (a norm, a weight array) would
# recompute that value for every element. Every lambda below refers to lambda variables
# only; row-level values enter through ``zip_with`` against ``array_repeat``.


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Inner product (VEC4 kernel)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(v, s) -> Column:
    """Multiply every element by the row-level scalar ``s``."""
    v = as_double(v)
    return F.zip_with(v, F.array_repeat(_col(s) if isinstance(s, str) else s, F.size(v)), lambda x, y: x * y)


def multiply(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)


def l2_normalize(v, zero_norm_divisor: float | None = None) -> Column:
    """Unit vector. ``zero_norm_divisor=None`` leaves a zero vector unchanged."""
    v = as_double(v)
    n = l2_norm(v)
    div = F.when(n > 0, n).otherwise(F.lit(1.0 if zero_norm_divisor is None else zero_norm_divisor))
    return F.zip_with(v, F.array_repeat(div, F.size(v)), lambda x, y: x / y)


def weighted_normalize(v, weights: Sequence[float] | Column) -> Column:
    """VEC1: element-wise weights, then L2 normalise (zero norm -> unchanged)."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    return l2_normalize(multiply(v, w))


def block_weights(layout: VectorLayout, weights: Sequence[float] | Column | None = None) -> Column:
    w = weights if weights is not None else layout.weights
    if isinstance(w, Column):
        return w
    return F.array(*[F.lit(float(x)) for x in w])


def expand_blocks(per_block: Column, block_dim: int) -> Column:
    """[w1, w2, ...] -> [w1 x d, w2 x d, ...] (one entry per vector element)."""
    return F.flatten(F.transform(per_block, lambda x: F.array_repeat(x, block_dim)))


def block_weighted_normalize(v, layout: VectorLayout, weights: Sequence[float] | Column | None = None) -> Column:
    """VEC2: multiply block i by weight i, flatten, L2 normalise (norm 0 -> divide by 1)."""
    w = block_weights(layout, weights)
    return l2_normalize(multiply(v, expand_blocks(w, layout.block_dim)), zero_norm_divisor=1.0)


def block_mask(v, layout: VectorLayout) -> Column:
    """FLT5 for vectors: block i is visible (1.0) if any of its entries is non-null and non-zero."""
    d = layout.block_dim
    return F.array(*[
        F.exists(F.slice(_col(v), i * d + 1, d), lambda x: x.isNotNull() & (x != 0)).cast("double")
        for i in range(len(layout.names))
    ])


def masked_query_weights(mask: Column, layout: VectorLayout, exponent: float = 2.0) -> tuple[Column, Column]:
    """VEC3: effective weights ``w*m/W_A`` and confidence ``W_A**exponent``.
    All perspectives missing -> plain weights ``w/sum(w)`` and confidence 0."""
    raw = [float(x) for x in layout.weights]
    total = sum(raw) or 1.0
    wm = F.zip_with(block_weights(layout), mask, lambda w, m: w * m)
    w_a = F.aggregate(wm, F.lit(0.0), lambda acc, x: acc + x)
    eff = F.when(w_a > 0, F.zip_with(wm, F.array_repeat(w_a, len(raw)), lambda x, y: x / y)) \
        .otherwise(F.array(*[F.lit(x / total) for x in raw]))
    conf = F.when(w_a > 0, F.pow(w_a, F.lit(exponent))).otherwise(F.lit(0.0))
    return eff, conf


def masked_query_vector(v, mask: Column, eff_weights: Column, layout: VectorLayout) -> Column:
    """Zero missing blocks, scale by effective weights, flatten, L2 normalise (norm>0)."""
    factor = F.zip_with(mask, eff_weights, lambda m, w: m * w)
    return l2_normalize(multiply(v, expand_blocks(factor, layout.block_dim)))


def cosine(a, b) -> Column:
    """VEC6; 0 when either vector has zero norm."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def minkowski(a, b, p: float = 3.0) -> Column:
    s = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: F.pow(F.abs(x - y), F.lit(p))),
                    F.lit(0.0), lambda acc, x: acc + x)
    return F.pow(s, F.lit(1.0 / p))


def degree_penalty(deg) -> Column:
    """VEC11: 1/ln(deg) for deg > 1 else 1 (degree 2 is boosted, as in the original)."""
    d = _col(deg).cast("double")
    return F.when(d > 1, F.lit(1.0) / F.log(d)).otherwise(F.lit(1.0))
