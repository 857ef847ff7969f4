"""Column functions over dense ``array<double>`` vectors and sparse ML vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine similarity, 0 when a vector has no length."""
    length = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """Sparse ML vector from arrays."""
    body = F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    return F.arrow_udf(_unchanged, VectorUDT())(body)


def _unchanged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stored form of a vector is that struct; only the type's name is new."""
    yield from batches
