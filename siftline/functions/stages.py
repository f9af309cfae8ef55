"""Columns that are computed once, whatever reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that the optimizer does not write out again wherever they are used.

    Neighbouring projections are merged, and a long expression then stands once for
    each of its uses; the element of a one-element array is made by a generator, which
    no projection is merged into.  No row is added or lost.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(row)).alias("__held")).select(*kept, "__held.*")
