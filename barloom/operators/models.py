"""Models on Spark ML: standardising, mixtures, forests, projections and classifiers."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import KEY, TIME


def standardise(df: DataFrame, names: list[str], train: str | None = None) -> DataFrame:
    """Columns scaled to mean 0 and population deviation 1, by the statistics of the ``train`` rows if named."""
    base = df.where(F.col(train) == 1) if train else df
    stats = base.agg(*[f(c).alias(f"_{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0) for c in names}
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in names for k in "ms"])


def gmm_regimes(df: DataFrame, names: list[str], order_by: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``regime`` and ``probs`` from a full-covariance mixture; regimes are numbered by the mean of ``order_by``."""
    filled = standardise(df.fillna(0.0, names), names)
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(filled)
    fitted = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="_g", probabilityCol="_p", maxIter=40).fit(rows)
    out = fitted.transform(rows).select(KEY, TIME, "_g", vector_to_array("_p").alias("_p"))
    joined = df.join(out, [KEY, TIME])
    means = {r["_g"]: r["m"] for r in joined.groupBy("_g").agg(F.avg(order_by).alias("m")).collect()}  # k rows
    new = {g: i for i, g in enumerate(sorted(range(k), key=lambda g: (means.get(g) is None, means.get(g) or 0.0, g)))}
    regime = F.lit(None).cast("int")
    for g, i in new.items():
        regime = F.when(F.col("_g") == g, F.lit(i)).otherwise(regime)
    probs = F.array(*[F.get("_p", F.lit(g)) for g in sorted(new, key=new.get)])
    return joined.withColumns({"regime": regime, "probs": probs}).drop("_g", "_p")


def regime_signal(df: DataFrame, readings: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``regime_signal``, ``signal_confidence`` and ``simple_signal`` from regimes and their readings."""
    named = readings.select("regime", F.col("reading").alias("regime_signal"))
    out = df.join(F.broadcast(named), "regime").withColumn("signal_confidence", F.get("probs", F.col("regime")))  # one row for each regime
    sure = F.col("signal_confidence") > threshold
    return out.withColumn("simple_signal", F.when(sure & F.col("regime_signal").isin("BUY", "SELL"), F.col("regime_signal")).otherwise("HOLD"))


def rf_forecast(df: DataFrame, names: list[str], target: str, trees: int = 200, depth: int = 8, seed: int = 42):
    """``(predictions for all rows, importances)``: a forest fitted on the rows with ``is_train`` 1."""
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(df)
    forest = RandomForestRegressor(featuresCol="_v", labelCol=target, predictionCol="forecast", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, cacheNodeIds=True)
    fitted = forest.fit(rows.where("is_train = 1"))
    weights = df.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, fitted.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return fitted.transform(rows).drop("_v"), weights


def pca_project(df: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """``pc1 .. pck`` of the standardised columns."""
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(standardise(df.dropna(subset=names), names))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_a", vector_to_array("_p"))
    return out.select(KEY, TIME, *[F.get("_a", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])


def direction_classifier(sequences: DataFrame, hidden: int = 16, iterations: int = 60, seed: int = 42) -> DataFrame:
    """``(symbol, ts, label, prediction, p_up)`` by a network with one hidden layer over ``x`` of ``sequences(symbol, ts, label, x, is_train)``.

    Fitted on the rows with ``is_train`` 1; rows without a label are left out.
    A row takes 8 bytes for each value of ``x``, of which a batch of 128 is held.
    """
    rows = sequences.where("label is not null").withColumn("_v", array_to_vector("x"))
    width = rows.select(F.size("x")).first()
    if width is None:
        return sequences.sparkSession.createDataFrame([], f"{KEY} string, {TIME} timestamp, label int, prediction int, p_up double")
    network = MultilayerPerceptronClassifier(featuresCol="_v", labelCol="label", layers=[width[0], hidden, 2], maxIter=iterations, blockSize=128, seed=seed)
    out = network.fit(rows.where("is_train = 1")).transform(rows)
    return out.select(KEY, TIME, "label", F.col("prediction").cast("int").alias("prediction"), F.get(vector_to_array("probability"), F.lit(1)).alias("p_up"))
