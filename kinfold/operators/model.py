"""A baseline match classifier and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import LinkageConfig
from kinfold.operators.pairs import FEATURES

#: 0.30 to 0.90 in steps of 0.05, as ``start + k * step``.
THRESHOLDS = tuple(0.3 + k * 0.05 for k in range(13))
BINS = 1024


def training_sample(rows: DataFrame, config: LinkageConfig | None = None) -> DataFrame:
    """At most ``model_rows`` rows, chosen by a seeded hash of the pair."""
    config = config or LinkageConfig()
    return rows.orderBy(F.xxhash64(F.lit(config.seed), "source1_entity_id", "candidate_entity_id"), "source1_entity_id", "candidate_entity_id").limit(config.model_rows)


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.fillna(0.0, list(FEATURES)))


def fit(rows: DataFrame, config: LinkageConfig | None = None):  # noqa: ANN201
    """Logistic regression with an L2 penalty of half the squared weights over the summed loss."""
    from pyspark.ml.classification import LogisticRegression

    sample = training_sample(rows, config)
    n = max(1, sample.count())
    return LogisticRegression(maxIter=200, regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(_vectors(sample))


def score(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    from pyspark.ml.functions import vector_to_array

    return model.transform(_vectors(rows)).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def roc_auc(rows: DataFrame, prob: str = "prob") -> DataFrame:
    """Area under the ROC curve, ties as halves; null without both labels.  Scores are summed up per value, and
    ranked inside score bins with the bins' totals as starts, so no task gets all values."""
    p = F.col(prob)
    counts = rows.groupBy(p.alias("s")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counts = counts.withColumn("bin", F.floor(F.col("s") * BINS))
    bins = counts.groupBy("bin").agg(F.sum("neg").alias("n"))
    starts = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = counts.withColumn("inside", inside).join(starts, "bin")
    pairs = F.sum(F.col("pos") * (F.col("start") + F.col("inside") + F.col("neg") / 2))
    return below.agg(F.try_divide(pairs, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def threshold_sweep(rows: DataFrame, prob: str = "prob", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """F-beta with beta 0.5 at each threshold, in one pass over the rows."""
    cells = []
    for i, t in enumerate(thresholds):
        over = F.col(prob) >= F.lit(t)
        cells += [F.count_if(over & (F.col("label") == 1)).alias(f"tp{i}"), F.count_if(over & (F.col("label") == 0)).alias(f"fp{i}"), F.count_if(~over & (F.col("label") == 1)).alias(f"fn{i}")]
    one = rows.agg(*cells)
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    flat = one.select(F.explode(each).alias("e")).select("e.*")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return flat.withColumn("f05", F.coalesce(F.try_divide(1.25 * tp, 1.25 * tp + 0.25 * fn + fp), F.lit(0.0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold of the best score; 0.5 with score 0 where none is above 0."""
    top = sweep.where(F.col("f05") > 0).agg(F.max(F.struct("f05", -F.col("step"), "threshold")).alias("b"))
    return top.select(F.coalesce("b.f05", F.lit(0.0)).alias("best_f05"), F.coalesce("b.threshold", F.lit(0.5)).alias("best_threshold"))


def top_weights(model, most: int = 10) -> list[tuple[str, float]]:  # noqa: ANN001
    return sorted(zip(FEATURES, model.coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))[:most]
