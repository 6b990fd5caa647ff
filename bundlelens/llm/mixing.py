"""Mixing sources to target weights.

Sizes are added up per source, a source's target over its size is its repetition rate, and each document is emitted ``floor(rate)``
times plus once more where a number drawn from its hash lies below the fraction. Only sources and numbers per document are shuffled;
texts are read where they lie.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlelens.llm.common import hold

WORDS = r"[^\x20\x09-\x0D]+"


def measure(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``t`` (hash of the text), ``source`` and ``size`` (number of words)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.md5(text.cast("binary")).alias("t"), F.col(f"`{source_col}`").alias("source"),
                     F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))


def with_sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum over all rows that come before in ``order``.

    Ranges of the order are added up on their own; only one row per range is put in line to carry their totals on.
    """
    ranges = hold(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(*(F.sum(x).alias(f"_{name}") for name, x in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_own_{name}") for name, x in sums.items())).join(totals, "_range")
    return out.select(*df.columns, *((F.col(f"_own_{name}") + F.col(f"_{name}")).alias(name) for name in sums))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, total: int | None = None) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``source`` and ``source_size``.

    Sources in order of their code points, null last, take the weights in turn. They share ``total`` (all sizes, if None) by weight; no
    target exceeds ``max_repeat`` times its source's size, and what is above goes to the others by weight, until none is above.

    The sources that stop at their limit are those of least limit per weight. In this order, a source stops exactly if its limit
    is below its share of what those before it leave, so one pass of sums gives them all.
    """
    if not weights or min(weights) <= 0 or max_repeat <= 0:
        raise ValueError("weights and max_repeat must be positive")
    turn = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = with_sums_before(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    placed = placed.select("source", "source_size", turn.cast("long").alias("weight"), (F.col("source_size") * max_repeat).alias("most"))
    whole = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words") if total is None else F.lit(total).cast("long").alias("words"),
                       F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    order = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    line = hold(with_sums_before(placed, order, {"most_before": F.col("most"), "weight_before": F.col("weight")}))
    left = (F.lit(whole["words"]).cast("long") - F.col("most_before")).cast("double")
    level = left / (F.lit(whole["weights"]).cast("long") - F.col("weight_before"))
    line = line.withColumns({"level": level, "stops": F.col("most") < F.col("weight") * level})
    first = line.filter(~F.col("stops")).agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source"))).first()
    share = F.lit(first[0]).cast("double") * F.col("weight")
    return line.select("source", "source_size", F.coalesce(F.least(share, F.col("most")), F.col("most")).cast("double").alias("target"))


def draw(seed: str, k: Column) -> Column:
    """A number from 0 to below 1 for the ``k``-th of the rows that are equal in id, text and source."""
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "t", k.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(seed: str, k: Column) -> Column:
    """``floor(rate)`` and the drawn copy, for a row with ``target`` and ``source_size``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.floor(rate) + (draw(seed, k) < rate - F.floor(rate)).cast("long")


def plan(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, total: int | None = None, seed: str = "mix", id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row ``id``, ``t``, ``source``, ``size``, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` (size times copies).

    Null and empty texts have size 0; a null source is a source of its own, the last; a source without words has target 0 and
    none of its documents is taken. Rows equal in id, text and source are drawn for one by one. The draw depends on id and text
    only, so reruns agree whatever the partitions, and a null id is drawn for by its text. An empty table gives no rows.
    """
    sized = hold(measure(df, id_col, text_col, source_col))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = hold(targets(sources, weights, max_repeat, total)).withColumnRenamed("source", "s")
    # Repeated rows are counted before they are joined, then written out again by number.
    each = sized.groupBy("id", "t", "source", "size").agg(F.count("*").alias("n"))
    each = each.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    out = each.withColumn("copies", copies(seed, F.col("k")))
    return out.select("id", "t", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, total: int | None = None, seed: str = "mix", id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row of ``df`` as often as ``plan`` takes it, columns as in ``df``.

    Of rows equal in id, text and source, one stands for all and comes as often as they do together.
    """
    taken = plan(df, weights, max_repeat, total, seed, id_col, text_col, source_col).groupBy("id", "t", "source").agg(
        F.sum("copies").alias("_llm_copies"), F.count("*").alias("n"))
    taken = hold(taken.withColumnsRenamed({"id": "_llm_id", "t": "_llm_t", "source": "_llm_source"}))
    rows = df.withColumn("_llm_text", F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    if not taken.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, "_llm_text", source_col])
    rows = rows.join(taken.filter("_llm_copies > 0"), F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_text") == F.col("_llm_t"))
                     & F.col(f"`{source_col}`").eqNullSafe(F.col("_llm_source")))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_llm_copies"))).alias("_llm_copy")).select(*columns)
