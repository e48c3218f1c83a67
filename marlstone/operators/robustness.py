"""The same fit under other samples, definitions and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marlstone.operators.regression import Fit


def table_of(fits: dict[str, Callable[[], Fit]], df: DataFrame, places: int = 6) -> DataFrame:
    """(variant, term, coefficient, error, n) of each variant's fit, in order of name and term."""
    rows = []
    for name, run in fits.items():
        found = run()
        clean = lambda v: None if v != v else round(v, places)
        rows += [(name, term, clean(b), clean(se), found.n) for term, b, se in found.rows()]
    return df.sparkSession.createDataFrame(rows, "variant string, term string, coefficient double, error double, n long")
