"""Exact ranks, tiles and quantiles over a whole table without sorting it in one task.

Everything rests on ``sums_before``: rows are first added up per distinct value (combined before the shuffle, so a value that holds a
third of all rows costs one row per task), then the distinct values are cut into ranges that follow their order and added up range by
range. The ranges are fine enough that a continuous score, a probability among others, spreads over all tasks, and their
number has a fixed bound, so putting their sums in line is bounded too.

Nothing runs before the result does: edges and tile starts are a subquery of the plan, with at most an entry per tile.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES_PER_OCTAVE = 1 << 13  # ranges between a value and its double; doubles of both signs fill at most 36 million, scores some 10,000
TIE_CELLS_HEX = 4            # 16**4 cells split the rows of one tied score
TOP_N_BRANCHES = 512         # first-level groups of a two-level top-n


def _range_of(key: Column) -> Column:
    """A range number that never falls when the key rises, whatever its size: octaves of the value, each cut evenly."""
    size = F.abs(key)
    octave = F.floor(F.log2(size))
    # Continuous at the octaves' ends, so an octave off by one there keeps the order.
    spot = octave + size / F.pow(F.lit(2.0), octave) + 1100.0
    spot = F.when(size == 0.0, 0.0).when(size == float("inf"), 3000.0).otherwise(spot)
    return F.floor(F.when(key < 0.0, -spot).otherwise(spot) * float(RANGES_PER_OCTAVE))


def _ranked(value: Column) -> Column:
    """Null and NaN have no place in an order of scores."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def sums_before(levels: DataFrame, value: str, sums: list[str], descending: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<c>_before`` (sum of the rows sorted before) and ``<c>_total`` for each ``c`` in ``sums``.

    ``levels`` has one row per value, neither null nor NaN. With ``within``, each combination of those columns, never null, is a table of its own.
    """
    key = F.col(value).cast("double") * (-1.0 if descending else 1.0)
    cut = levels.withColumn("_key", key).withColumn("_range", _range_of(F.col("_key")))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*within, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*within, "_range").agg(*[F.sum(c).alias(c) for c in sums]).select(
        *within, "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_r_{c}") for c in sums],
        *[F.sum(c).over(Window.partitionBy(*within)).alias(f"{c}_total") for c in sums])
    # A left join (every range has its sums): an inner one would add a filter to this side only, and the values would
    # then be grouped once per side instead of being shared.
    own = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_o_{c}") for c in sums]).join(ranges, [*within, "_range"], "left")
    return own.select(*levels.columns, *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums])


def count_before(df: DataFrame, value: str, descending: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct value that is neither null nor NaN: rows holding it (``n``), rows sorted before it (``before``), all rows (``total``)."""
    levels = df.filter(_ranked(F.col(value))).groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    return sums_before(levels, value, ["n"], descending, within).withColumnsRenamed({"n_before": "before", "n_total": "total"})


def tile_starts(df: DataFrame, score: str, key: str, tiles: int) -> DataFrame:
    """One row, ``marks``: the first rows of tiles 2 to ``tiles`` as an array of structs ``s`` (score), ``t`` (tie hash), ``k`` (key).

    A start at the first row of its score needs no tie hash and has empty texts. A start inside a tied score
    is looked up among that score's rows only: they are counted in cells of their hash prefix, and only the
    one cell that holds the start is sorted. The frames broadcast here have a row per tile at most.
    """
    starts = f"transform(sequence(1, {tiles - 1}), i -> i * floor(total / {tiles}) + least(i, total % {tiles}))"
    cuts = F.broadcast(count_before(df.select(score), score, descending=True).select(F.col(score).alias("s"), F.expr(
        f"transform(filter({starts}, p -> p >= before and p < before + n), p -> p - before) as offsets")).filter("size(offsets) > 0"))
    tied = (df.select(F.col(score).alias("s"), F.col(key).alias("k")).join(cuts, "s").filter("array_max(offsets) > 0")
            .withColumn("t", F.md5("k")).withColumn("cell", F.substring("t", 1, TIE_CELLS_HEX)))
    earlier = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    spots = (tied.groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"), F.any_value("offsets").alias("offsets"))
             .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("s", "cell", F.expr(
                 "transform(filter(offsets, o -> o > 0 and o >= before and o < before + n), o -> o - before + 1) as places")).filter("size(places) > 0"))
    in_cell = Window.partitionBy("s", "cell").orderBy("t", "k")
    inside = (tied.join(F.broadcast(spots), ["s", "cell"]).withColumn("place", F.row_number().over(in_cell))
              .filter("array_contains(places, place)").select("s", "t", "k"))
    first = cuts.filter("array_contains(offsets, 0)").select("s", F.lit("").alias("t"), F.lit("").alias("k"))
    return first.unionByName(inside).agg(F.collect_list(F.struct("s", "t", "k")).alias("marks"))


def exact_ntile(df: DataFrame, score: str, key: str, tiles: int = 10, name: str = "tile") -> DataFrame:
    """NTILE(tiles) by descending score; ties are ordered by md5(key), key. A null or NaN score has no tile.

    Every row finds its tile by comparing itself with the first rows of the tiles (``tile_starts``), so the table is
    neither sorted nor moved.
    """
    marks = tile_starts(df, score, key, tiles).scalar() if tiles > 1 else F.expr("array(struct(0.0D as s, '' as t, '' as k))")
    mark = [f"get(_marks, {i})" for i in range(tiles - 1)]
    split = " or ".join(f"coalesce({m}.t != '' and {m}.s = `{score}`, false)" for m in mark) or "false"
    # Whether the row comes at or after the first row of a tile.
    reached = [f"int(coalesce(`{score}` < {m}.s or (`{score}` = {m}.s and (_tie > {m}.t or (_tie = {m}.t and ({m}.t = '' or `{key}` >= {m}.k)))), false))" for m in mark]
    tile = F.expr(" + ".join(["1", *reached]))
    return (df.withColumn("_marks", marks).withColumn("_tie", F.expr(f"case when {split} then md5(`{key}`) else '' end"))
            .withColumn(name, F.when(_ranked(F.col(score)), tile).cast("bigint")).drop("_tie", "_marks"))


def quantile_edges(df: DataFrame, score: str, bins: int) -> DataFrame:
    """One row, ``edges``: the distinct quantiles of ``-score`` at 0, 1/bins, ..., 1 in order, exact with linear interpolation."""
    levels = count_before(df.select(score), score, descending=True)
    spots = f"transform(sequence(0, {2 * bins + 1}), j -> struct(j div 2 as k, j % 2 as upper, floor((total - 1) * (j div 2) / {bins}) + j % 2 as at))"
    # Whether a spot lies in a level, in whole numbers: lists of spots are only made for the few levels that hold one.
    last = f"least({bins}, ((before + n) * {bins} - 1) div nullif(total - 1, 0))"
    levels = levels.filter(f"total = 1 or (total - 1) * {last} div {bins} >= before - 1")
    picked = levels.select((-F.col(score)).alias("x"), "total", F.expr(f"inline(filter({spots}, s -> s.at >= before and s.at < before + n))"))
    picked = picked.groupBy("k").agg(F.expr("max(x) filter (where upper = 0)").alias("lo"), F.expr("max(x) filter (where upper = 1)").alias("hi"), F.max("total").alias("total"))
    edge = f"lo + coalesce((hi - lo) * (double((total - 1) * k % {bins}) / double({bins})), 0.0D)"
    return picked.agg(F.expr(f"array_sort(collect_set({edge}))").alias("edges"))


def quantile_deciles(df: DataFrame, score: str, bins: int = 10, name: str = "decile") -> DataFrame:
    """Quantile bins of descending score, 1 = highest; ties stay together and repeated edges are merged.

    Bins are closed on the right, the first one on both sides: a row's bin is the number of edges below -score.
    """
    below = F.expr(" + ".join(f"int(coalesce(get(_edges, {i}) < -`{score}`, false))" for i in range(bins + 1)))
    return (df.withColumn("_edges", quantile_edges(df, score, bins).scalar())
            .withColumn(name, F.when(_ranked(F.col(score)), F.greatest(F.lit(1), below)).cast("bigint")).drop("_edges"))


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """First n rows of each group in ``order`` (which must be unique), numbered from 1.

    Input partitions are merged in branches before the group meets in one task, so a group's last step
    reads at most ``TOP_N_BRANCHES * n`` rows however large the group is.
    """
    branch = Window.partitionBy(*keys, "_branch").orderBy(*order)
    group = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_branch", F.spark_partition_id() % TOP_N_BRANCHES)
            .withColumn("_position", F.row_number().over(branch)).filter(F.col("_position") <= n)
            .drop("_branch", "_position")
            .withColumn(name, F.row_number().over(group).cast("bigint")).filter(F.col(name) <= n))
