"""Column expressions that several operators share. Everything here stays inside codegen."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(values) -> Column:
    """Constant array of doubles (nested lists become nested arrays), built as one expression."""
    def text(v):
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(text(x) for x in v) + ")"
        return f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)}')"
    return F.expr(text(list(values)))


def safe_div(a, b) -> Column:
    """NULL instead of the ANSI division error when the divisor is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def guarded_div(a, b, eps: float = EPS) -> Column:
    """Division kept finite by a small constant added to the divisor."""
    return as_col(a) / (as_col(b) + F.lit(eps))


def round6(c) -> Column:
    """Six decimals by plain IEEE steps, so that other engines can repeat it bit for bit."""
    return F.floor(as_col(c).cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def hash32(seed, *cols) -> Column:
    """Reproducible 32-bit hash of the seed and the given columns."""
    parts = [F.lit(str(seed))] + [as_col(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed, *cols) -> Column:
    """Uniform draw in [0, 1) derived from the hash."""
    return hash32(seed, *cols) / F.lit(4294967296.0)


def round_half_away(c) -> Column:
    """Nearest integer, halves away from zero."""
    c = as_col(c)
    return F.when(c > 0, F.floor(c + F.lit(0.5))).otherwise(F.ceil(c - F.lit(0.5))).cast("int")


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def softplus(c) -> Column:
    """ln(1 + e^x) without overflow."""
    c = as_col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def log_sum_exp(a, b) -> Column:
    a, b = as_col(a), as_col(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def clamp_floor(c, floor: float) -> Column:
    return F.greatest(as_col(c), F.lit(floor))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squares(a) -> Column:
    return F.transform(as_col(a), lambda x: x * x)


def weigh(vec, weights) -> Column:
    """Multiply each element by its weight."""
    return F.zip_with(as_col(vec), as_col(weights), lambda x, w: x * w)


def pick(vec, indices: list[int]) -> Column:
    """Elements of an array at fixed positions, in the order asked for."""
    v = as_col(vec)
    return F.array(*[F.element_at(v, i + 1) for i in indices])


def mean_pm_std(mean, std, digits: int = 2) -> Column:
    """Text cell 'mean ± std' in per cent."""
    fmt = f"%.{digits}f ± %.{digits}f"
    return F.format_string(fmt, as_col(mean) * 100, as_col(std) * 100)


def bare_param_name(c, prefix: str = "model__") -> Column:
    """Parameter name without its pipeline prefix."""
    return F.replace(as_col(c), F.lit(prefix), F.lit(""))
