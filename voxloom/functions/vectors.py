"""Vector arithmetic on array columns, always in double precision."""

from pyspark.sql import Column, functions as F

EPS = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside a lambda body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(EPS)), lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def squared_euclidean(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def score(a: Column, b: Column, distance: str, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if distance == "cosine":
        return cosine(a, b) / F.lit(float(temperature))
    if distance == "squared_euclidean":
        return -squared_euclidean(a, b) / F.lit(float(temperature))
    raise ValueError(f"unsupported distance: {distance}")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def is_finite_vector(v: Column, dim: int | None = None) -> Column:
    """Non-empty (or of the given size) and free of NULL, NaN and infinities."""
    shape = (F.size(v) == dim) if dim is not None else (F.size(v) > 0)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(v.isNotNull() & shape & finite, F.lit(False))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
