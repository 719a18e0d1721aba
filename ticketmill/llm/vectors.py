"""What the vector operators share: usable vectors, and Arrow columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a finite, non-zero vector, plus the vector's length as ``dim``.

    The vector is cast to doubles. Nulls, components that are null, NaN or infinite, empty vectors
    and vectors of zeros only drop out.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vectors.filter(
        F.col(id_column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    ).withColumns({vector: v, "dim": F.size(v)})


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column; all lists have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
