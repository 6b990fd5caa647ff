"""Propensity model: features, split, boosted trees, scoring and evaluation."""

import json

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import lookup
from bundlelens.functions.ordering import sums_before
from bundlelens.session import shared_dir
from bundlelens.sources.snapshots import write_snapshot


def check_features(features: list[str], forbidden: list[str] = S.NOT_FEATURES) -> list[str]:
    """Return the features, or fail naming those that would leak the outcome."""
    bad = [c for c in features if c in forbidden or c == S.TARGET]
    if bad:
        raise ValueError(f"columns must not be model features: {bad}")
    return features


def leakage_guard(df: DataFrame, forbidden: list[str] = S.NOT_FEATURES) -> DataFrame:
    """Per column of the fact: whether it may be a feature, and how many rows fill it."""
    cols = df.columns
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c not in forbidden and c != S.TARGET).alias("allowed"),
                               F.col(f"c{i}").alias("filled_rows")) for i, c in enumerate(cols)])
    return df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).select(F.inline(lines))


def encode_features(df: DataFrame) -> DataFrame:
    """Add the ordinal codes of the five coded columns; an unknown label has no code."""
    return df.withColumns({f"{c}_enc": lookup(c, codes) for c, codes in S.ORDINAL_CODES.items()})


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, key: str = "household_id",
                     label: str = S.TARGET) -> DataFrame:
    """Add ``split`` (train or test) by a hash of seed, label and key: repeatable, per stratum, without a shuffle."""
    spot = num.key_hash(F.concat_ws("-", F.lit(seed), F.col(label), F.col(key)))
    return df.withColumn("split", F.when(spot < int(test_share * 2**32), "test").otherwise("train"))


def _sample_spot(seed: int, key: str, label: str) -> Column:
    return num.key_hash(F.concat_ws("-", F.lit(f"train-{seed}"), F.col(label), F.col(key)))


def _sample_share(rows: int, max_rows: int) -> int:
    """Spots below this are four standard deviations below the bound in expectation; all of them if there are no more rows."""
    return 2**32 if rows <= max_rows else int(max(1.0, max_rows - 4.0 * max_rows ** 0.5) / rows * 2**32)


def training_sample(train: DataFrame, max_rows: int, seed: int = 42, key: str = "household_id", label: str = S.TARGET) -> DataFrame:
    """At most ``max_rows`` of the rows, the same share of each class: those whose key hashes lowest.

    All of them if there are no more. The share aims four standard deviations below the bound and is lowered until the
    rows are within it, so the rows of the sample depend on the table alone, not on how it is divided into tasks.
    """
    spot = _sample_spot(seed, key, label)
    rows = train.count()
    if rows <= max_rows:
        return train
    below = _sample_share(rows, max_rows)
    while train.filter(spot < below).count() > max_rows:
        below = below * 99 // 100
    return train.filter(spot < below)


def train_gbt(train: DataFrame, features: list[str] = S.FEATURES, rounds: int = 80, depth: int = 4, rate: float = 0.12,
              seed: int = 42, checkpoint_every: int = 10, max_train_rows: int = 100_000, key: str = "household_id") -> PipelineModel:
    """Fit boosted trees on encoded rows.

    The rounds reread at most ``max_train_rows`` rows (those of ``training_sample``), which are dealt over the cores once and held meanwhile.
    The table is read twice: to count it and its values, and to pick these rows, which are then counted where they are held.
    A feature without a value, such as the code of an unknown label, is named before the fit starts.
    """
    check_features(features)
    known = train.agg(num.rows().alias("_rows"), *[F.count(c).alias(c) for c in features]).first()
    missing = [c for c in features if known[c] < known["_rows"]]
    if missing:
        raise ValueError(f"rows without a value, or with an unknown label, in {missing}")
    spark = train.sparkSession
    shared_dir(spark)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    below = _sample_share(known["_rows"], max_train_rows)
    picked = train.withColumn("_spot", _sample_spot(seed, key, S.TARGET)).filter(F.col("_spot") < below)
    narrow = assembler.transform(picked).select("features", F.col(S.TARGET).cast("double").alias("label"), key, "_spot")
    held = narrow.repartition(spark.sparkContext.defaultParallelism, key).drop(key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while held.filter(F.col("_spot") < below).count() > max_train_rows:
            below = below * 99 // 100
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
                              checkpointInterval=checkpoint_every).fit(held.filter(F.col("_spot") < below).drop("_spot"))
    finally:
        held.unpersist()
    return PipelineModel([assembler, model])


#: What a saved model says of itself beside its trees.
CARD = "card.json"


def save_model(model: PipelineModel, path: str, **more) -> str:
    """Save a model with its card: the features in order, the codes they were made with, and what ``more`` says. The card is written last."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    card = {"features": model.stages[0].getInputCols(), "codes": S.ORDINAL_CODES, "target": S.TARGET, **more}
    spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{CARD}")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A saved model and its card. A model of other features or codes than today's is an error: it would score other columns than it learned."""
    card = json.loads(spark.read.text(f"{path}/{CARD}").first().value)
    model = PipelineModel.load(f"{path}/model")
    check_features(card["features"])
    if card["features"] != model.stages[0].getInputCols() or model.stages[-1].numFeatures != len(card["features"]):
        raise ValueError(f"{path}: the card names other features than the model reads")
    if card["codes"] != S.ORDINAL_CODES or card["target"] != S.TARGET:
        raise ValueError(f"{path}: the model was fitted with other codes")
    return model, card


def score_households(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the conversion probability ``model_prob`` and the class ``prediction``."""
    return (model.transform(df).withColumns({"model_prob": vector_to_array("probability")[1],
                                             "prediction": F.col("prediction").cast("int")})
            .drop("features", "rawPrediction", "probability"))


def write_scores(model: PipelineModel, df: DataFrame, path: str, columns: list[str], by: str = "quarter", replace: str = "table", source: str | None = None) -> str:
    """Score rows into the folders of a dated snapshot; with ``replace="folders"``, only the dates that ``df`` has are scored anew."""
    return write_snapshot(score_households(model, df).select(*columns, "model_prob", "prediction", by), path, by=by, replace=replace, source=source)


def score_checks(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Per household: the columns in ``keep``, whether the score is a probability, and whether the class follows from it."""
    return scored.select(*keep, F.coalesce(F.col("model_prob").between(0.0, 1.0), F.lit(False)).alias("is_probability"),
                         F.coalesce((F.col("model_prob") > 0.5).cast("int") == F.col("prediction"), F.lit(False)).alias("class_follows"))


def model_auc(scored: DataFrame, score: str = "model_prob", label: str = S.TARGET) -> DataFrame:
    """Area under the ROC curve, with the counts behind it; null without rows of both classes.

    The area is the share of (converted, not converted) pairs that the score puts in order, half for ties: per distinct score, its
    converted rows times the others below it. All counts are whole numbers, so the digits don't depend on the order of
    addition. A row without a score or label counts as a household only.
    """
    known = scored.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    levels = known.groupBy(score).agg(num.total(label).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    pairs = F.col("p").cast("decimal(20,0)") * (2 * F.col("q_before") + F.col("q")).cast("decimal(18,0)")
    area = sums_before(levels, score, ["p", "q"]).agg(
        F.sum(pairs).cast("double").alias("in_order"), (2.0 * F.max("p_total").cast("double") * F.max("q_total").cast("double")).alias("all"))
    area = area.select(F.try_divide("in_order", "all").alias("auc"))
    return scored.agg(num.rows().alias("households"), num.total(label).alias("converted")).withColumn("auc", area.scalar())


def confusion(scored: DataFrame, prediction: str = "prediction", label: str = S.TARGET) -> DataFrame:
    """TN, FP, FN, TP with accuracy, precision and recall; a rate without cases is 0."""
    said, is_so = F.col(prediction) == 1, F.col(label) == 1
    or_zero = lambda a, b: F.coalesce(num.ratio(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (scored.agg(F.count_if(~said & ~is_so).alias("tn"), F.count_if(said & ~is_so).alias("fp"),
                       F.count_if(~said & is_so).alias("fn"), F.count_if(said & is_so).alias("tp"))
            .withColumns({"accuracy": or_zero(tn + tp, tn + fp + fn + tp), "precision": or_zero(tp, tp + fp),
                          "recall": or_zero(tp, tp + fn)}))


def _importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance")) for n, v in zip(names, values)])
    return spark.range(1).select(F.inline(pairs)).withColumn("label", F.coalesce(lookup("feature", S.FEATURE_LABELS), F.col("feature")))


def feature_importance(spark: SparkSession, model: PipelineModel, limit: int = 10) -> DataFrame:
    """Leading features of a fitted model with their labels, and whether each is above the shown median."""
    shown = _importances(spark, model).orderBy(F.col("importance").desc(), "feature").limit(limit)
    median = shown.agg(F.median("importance")).scalar()
    return shown.withColumn("above_median", F.col("importance") > median)


def importance_checks(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Per feature its label, whether its importance is a share, and whether all are shares of one whole."""
    every = F.sum("importance").over(Window.partitionBy())
    return _importances(spark, model).select("feature", "label", F.col("importance").between(0.0, 1.0).alias("is_share"),
                                             (F.abs(every - 1.0) < 1e-9).alias("sum_is_one"), F.count(F.lit(1)).over(Window.partitionBy()).alias("features"))
