"""Functions that run in Python workers, for what the built-in ones can't express."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


@pandas_udf(DoubleType())
def gini(values: pd.Series) -> float:
    """The Gini coefficient of a group's values: 0 where all are equal. Nulls are left out; null for no values, or a sum of 0.

    A group comes to one task as a whole, so groups must be of bounded size.
    """
    v = np.sort(values.dropna().to_numpy(float))
    n, total = len(v), v.sum()
    return float(2 * (np.arange(1, n + 1) @ v) / (n * total) - (n + 1) / n) if n and total else None


@udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("word", StringType())]))
class cut_words:  # noqa: N801  a function, to its callers
    """The words of a text between blanks, with their positions from 1; no rows for null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(" "), 1)
