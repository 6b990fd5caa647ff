"""The household fact: read from files, or viewed over order tables."""

from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import lookup
from bundlelens.operators.preparation import (add_log_odds, add_propensity_tier, add_quarter_year,
                                              add_region, add_target, score_tenths)
from bundlelens.session import shared_dir
from bundlelens.sources.snapshots import latest_snapshot, source_mark, write_snapshot


CORRUPT = "_corrupt"


def _csv_text(spark: SparkSession, path: str, schema: S.T.StructType) -> DataFrame:
    """The cells of CSV files as text, and the whole line where their number doesn't fit."""
    text = S.T.StructType([S.T.StructField(f.name, S.T.StringType()) for f in schema] + [S.T.StructField(CORRUPT, S.T.StringType())])
    # enforceSchema=False checks the header against the schema instead of trusting column order.
    return (spark.read.schema(text).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def _bad_columns(schema: S.T.StructType) -> F.Column:
    """Names of the columns whose text has no value of the column's type, and ``line`` for too few or too many cells."""
    wrong = lambda f: F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f.name)
    return F.array_compact(F.array(*[wrong(f) for f in schema], F.when(F.col(CORRUPT).isNotNull(), "line")))


def scan_households(spark: SparkSession, path: str, fmt: str = "parquet", benchmark: bool = False, on_bad: str = "set_aside") -> DataFrame:
    """Read the household (or benchmark) fact with its fixed schema, from CSV with a header or from Parquet.

    A CSV row with a cell that isn't of its column's type, or with too few or too many cells, is set aside whole, whichever columns
    a query uses (``scan_rejects`` has these rows), or with ``on_bad="fail"`` ends the query with its text. A missing column is an error.
    """
    schema = S.BENCHMARK_SCHEMA if benchmark else S.HOUSEHOLD_SCHEMA
    if on_bad not in ("set_aside", "fail"):
        raise ValueError("on_bad is 'set_aside' or 'fail'")
    if fmt != "csv":
        found = spark.read.format(fmt).load(path).columns
        missing = [c for c in schema.fieldNames() if c not in found]
        if missing:
            raise ValueError(f"{path} has no columns {missing}")
        return spark.read.schema(schema).format(fmt).load(path)
    bad = _bad_columns(schema)
    typed = F.array(F.struct(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]))
    text = F.concat(F.lit("bad cells in "), F.array_join(bad, ", "), F.lit(": "), F.concat_ws(",", *schema.fieldNames()))
    # One step tests and casts a row: as a filter, the test would be repeated for every column's cast when plans are compared.
    row = F.when(F.size(bad) == 0, typed)
    return _csv_text(spark, path, schema).select(F.inline(row.otherwise(F.raise_error(text)) if on_bad == "fail" else row))


def scan_rejects(spark: SparkSession, path: str, fmt: str = "parquet", benchmark: bool = False) -> DataFrame:
    """The rows that ``scan_households`` sets aside: their columns as text, and ``bad_columns``, the columns at fault."""
    schema = S.BENCHMARK_SCHEMA if benchmark else S.HOUSEHOLD_SCHEMA
    if fmt != "csv":
        none = scan_households(spark, path, fmt, benchmark).limit(0)
        return none.select(*[F.col(c).cast("string").alias(c) for c in schema.fieldNames()], F.lit("").alias("bad_columns"))
    cells = _csv_text(spark, path, schema)
    return cells.select(*schema.fieldNames(), F.array_join(_bad_columns(schema), ",").alias("bad_columns")).filter("bad_columns <> ''")


# Fixed values of the view: names assigned by remainder or prefix of an order's columns.
_STATES = ["OH", "TX", "FL", "CA", "PA", "IL", "GA", "NC", "MI", "AZ"]
_INCOME = ["<$50k", "$50k-$75k", "$75k-$100k", "$100k-$150k", "$150k+"]
_CHANNEL_OF_SEGMENT = {"AUTOMOBILE": "Captive Agent", "MACHINERY": "Call Center", "FURNITURE": "Direct Online"}
_PRODUCT_OF_PRIORITY = {"3": "Motorcycle", "4": "Boat", "5": "Commercial Auto"}
_AGENTS = {"Independent Agent": 8, "Captive Agent": 4, "Call Center": 6, "Direct Online": 3}
_PREFIX = {"Independent Agent": "IA-", "Captive Agent": "CA-", "Call Center": "CC-", "Direct Online": "DO-"}
_BASE_PREMIUM = {"Basic": 68, "Standard": 92, "Plus": 125, "Elite": 175}
_INTERCEPT = -3.05


def _at(names: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


def _flag(cond) -> F.Column:
    return F.when(cond, 1).otherwise(0)


def order_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One household snapshot per order (FIXTURES.md section 3), with agent and benchmark columns.

    Line items are counted per order before any join, and that count leaves its rows partitioned by
    order, so ``orders`` joins it in place; only the narrow result is moved to meet ``customer``.
    Which side of a join is broadcast is left to measured sizes.
    """
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    lines = (read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")))
    base = (read("orders").join(lines, "o_orderkey", "left")
            .join(read("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"))

    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 1095
    facts = base.select(
        ok.alias("ok"), ck.alias("ck"),
        F.concat(F.lit("HH-"), num.padded(ok, 7)).alias("household_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), day.cast("int")).alias("snapshot_date"),
        _at(_STATES, F.col("c_nationkey") % 10).alias("state"),
        (22 + ck % 56).cast("int").alias("age_of_primary"),
        F.when(F.col("c_acctbal") >= 4300, "Homeowner").when(F.col("c_acctbal") >= 3300, "Condo")
         .otherwise("Renter").alias("home_ownership"),
        (1 + ck % 5).cast("int").alias("household_size"),
        _at(_INCOME, (ck % 11) % 5).alias("income_band"),
        lookup("c_mktsegment", _CHANNEL_OF_SEGMENT, "Independent Agent").alias("agency_channel"),
        lookup(F.substring("o_orderpriority", 1, 1), _PRODUCT_OF_PRIORITY, "Auto").alias("anchor_product"),
        F.when(F.col("o_totalprice") < 125000, "Basic").when(F.col("o_totalprice") < 275000, "Standard")
         .when(F.col("o_totalprice") < 400000, "Plus").otherwise("Elite").alias("policy_tier"),
        (1 + (ok * 7 + ck) % 120).cast("int").alias("tenure_months"),
        F.least(F.coalesce("n_lines", F.lit(0)), F.lit(5)).cast("int").alias("outreach_contacts_12m"),
        F.least(F.coalesce("n_returned", F.lit(0)), F.lit(3)).cast("int").alias("claims_24m"),
        (1 + (ok * 3 + ck) % 10).cast("int").alias("digital_engagement_score"),
        _flag((ok * 11 + ck) % 25 < 7).cast("int").alias("property_quote_started"),
    )

    ok, ck = F.col("ok"), F.col("ck")
    # Premium and value are built in whole cents, the score in whole tenths.
    premium_cents = lookup("policy_tier", _BASE_PREMIUM) * (850 + (ok * 31) % 351)
    property_dollars = F.when(F.col("home_ownership") == "Homeowner", 900 + (ok * 17) % 901).otherwise(400 + (ok * 17) % 501)
    months = F.least(F.lit(96), F.greatest(F.lit(12), F.col("tenure_months") + 12 + ok % 48))
    valued = (add_log_odds(facts, _INTERCEPT)
              .withColumns({"_tenths": score_tenths(F.col("log_odds")), "_cents": premium_cents.cast("bigint")})
              .withColumns({
                  "annual_premium_anchor": F.col("_cents").cast("double") / 100.0,
                  "projected_mphh_cltv":
                      F.floor(((F.col("_cents") + property_dollars * 100) * months * 18).cast("double") / 1200.0)
                       .cast("double") / 100.0,
                  "propensity_score": F.col("_tenths").cast("double") / 10.0,
                  "converted_mphh": _flag((ok * 7919 + ck * 104729) % 1000 < F.col("_tenths")).cast("int"),
                  "agent_id": F.concat(lookup("agency_channel", _PREFIX),
                                       num.padded(1 + (ok * 13 + ck) % lookup("agency_channel", _AGENTS), 4)),
              }))
    full = add_target(add_quarter_year(add_region(add_propensity_tier(valued))))
    return full.select(*S.BENCHMARK_COLUMNS, "year")


_marks: dict[tuple[str, str], str] = {}
_storing = Lock()
STORED_SCHEMA = S.T.StructType(S.BENCHMARK_SCHEMA.fields + [S.T.StructField("year", S.T.StringType())])
#: Goes up when the view gives other rows for the same tables.
VIEW_VERSION = "1"


def tables_mark(spark: SparkSession, sf_dir: str) -> str:
    """Mark of the order tables, which are taken not to change during a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _marks:
        _marks[key] = source_mark(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "lineitem")], VIEW_VERSION)
    return _marks[key]


def stored_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view above as a table: built once for its order tables, then read by every query of every session that shares the folder.

    The joins and the wide derivation run once instead of once per query. The table lies in the shared
    folder in one folder per quarter, so queries read their columns, and their quarters, only. It is trusted for its
    manifest, not for its path: one that is unfinished, has lost a file or was made from other tables is built anew.
    """
    mark = tables_mark(spark, sf_dir)
    folder = f"{shared_dir(spark)}/fact/{mark}"
    with _storing:
        path = latest_snapshot(spark, folder, mark)
        if path is None:
            path = write_snapshot(order_households(spark, sf_dir), f"{folder}/{uuid4().hex}", by="quarter", source=mark)
        return spark.read.schema(STORED_SCHEMA).parquet(path)
