"""Lookups and buckets over small fixed dimensions.

A fixed dimension of a dozen entries is a literal map: it needs no join, its generated code is one short
loop, and the optimizer drops it when the mapped column is not used.
"""

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bundlelens import schema as S


def lookup(column, mapping: Mapping, default=None) -> Column:
    """Value of ``mapping`` at ``column``; ``default`` (or null) where the key is unknown."""
    col = F.col(column) if isinstance(column, str) else column
    found = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), col)
    return found if default is None else F.coalesce(found, F.lit(default))


def bucket_ordinal(mode: str, column: str = "tenure_months") -> Column:
    """0-based tenure bucket.

    ``case``: everything not below an edge, null included, lands in the last bucket.
    ``cut``: half-open bins; null and out-of-range months have no bucket.
    """
    if mode not in ("case", "cut"):
        raise ValueError(f"mode must be 'case' or 'cut', not {mode!r}")
    m = F.col(column)
    *inner, end = S.TENURE_EDGES[1:]
    expr = F.when(m < inner[0], 0)
    for i, edge in enumerate(inner[1:], start=1):
        expr = expr.when(m < edge, i)
    last = len(inner)
    if mode == "case":
        return expr.otherwise(last)
    return F.when(m >= S.TENURE_EDGES[0], expr.when(m < end, last))


def add_tenure_bucket(df: DataFrame, mode: str = "cut", labels: list[str] | None = None,
                      name: str = "tenure_bucket") -> DataFrame:
    """Add the bucket label and its sort key ``bucket_ord``."""
    labels = labels or S.TENURE_MO
    return (df.withColumn("bucket_ord", bucket_ordinal(mode))
              .withColumn(name, F.get(F.array(*[F.lit(x) for x in labels]), F.col("bucket_ord"))))


def quarter_spine(spark: SparkSession, spine: Mapping[str, float] | None = None) -> DataFrame:
    """One row per quarter of the spine with its target, as a local relation."""
    spine = S.QUARTER_TARGETS if spine is None else spine
    rows = ", ".join(f"('{q}', {float(t)}D)" for q, t in spine.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS spine(quarter, target_pct)")
