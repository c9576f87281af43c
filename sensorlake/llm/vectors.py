"""Vectors of whole numbers from a column of float arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import integer_ids

SCALE = 256


def whole(vec_col: str) -> Column:
    """floor(256 * x) of each component as long; null where the vector or a component is null, or a component is not finite."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * SCALE)))


def kept_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id (long), label, v (array of long): rows with a usable vector."""
    x = df.select(integer_ids(df, id_col).alias("id"), F.col(f"`{label_col}`").alias("label"), whole(vec_col).alias("v"))
    return x.where(F.col("v").isNotNull())


def matrix(v: pa.ListArray, width: int) -> np.ndarray:
    """A row for each list, cut off or filled up with zeros to the width."""
    flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.value_lengths(), np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], place[inside]] = flat[inside]
    return out
