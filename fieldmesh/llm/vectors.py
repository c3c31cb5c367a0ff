"""What the vector operators share: the rows that take part, as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector is there, and so are all its components, finite."""
    infinite = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinite), F.lit(False))), F.lit(False))


def scaled(vector: Column, by: float) -> Column:
    """floor(by * x) of every component x, as a double: components of any size are judged before they become integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double"))


def matrix(flat: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """A list column's values as rows of integers below `limit`; vectors of several lengths, or out of bounds, are an error."""
    width = np.diff(offsets)
    if len(width) and width.min() != width.max():
        raise ValueError(f"vectors of {width.min()} and of {width.max()} components")
    if len(flat) and np.abs(flat).max() >= limit:
        raise ValueError(f"a scaled component is not below {limit}")
    return flat.astype(np.int64).reshape(len(width), -1 if len(width) and width[0] else 0)


def array_of(value: pa.BinaryScalar, kind: type) -> np.ndarray:
    """The numbers in a binary value, which may be empty."""
    raw = value.as_buffer()
    return np.frombuffer(raw, kind) if raw.size else np.zeros(0, kind)
