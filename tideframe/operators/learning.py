"""Standard models through Spark MLlib: components, classifiers, clusterers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float], list[list[float]]]:
    """(df with pc1..pck, explained shares, loadings); columns are standardised, each loading's largest entry is positive."""
    rows = vectors(df, columns, "raw")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(scaled)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, c]).argmax(), c] > 0 else -1.0 for c in range(k)]
    pc = vector_to_array("pc")
    out = model.transform(scaled).withColumns({f"pc{c + 1}": pc[c] * sign[c] for c in range(k)}).drop("raw", "features", "pc")
    return out, model.explainedVariance.toArray().tolist(), (load * sign).tolist()


def logistic_scores(df: DataFrame, columns: list[str], label: str = "label", train: str | None = None, c: float = 1.0) -> DataFrame:
    """Adds z, the probability of label 1 by a class-balanced logistic model, fitted on rows where `train` holds."""
    rows = vectors(df, columns, "raw")
    fit_on = rows if train is None else rows.where(train)
    counts = fit_on.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = fit_on.count()
    weighted = fit_on.join(F.broadcast(counts), label).withColumn("__w", total / (2.0 * F.col("__n")))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(weighted)
    model = LogisticRegression(labelCol=label, weightCol="__w", regParam=1.0 / (c * max(total, 1)), standardization=False).fit(scaler.transform(weighted))
    return model.transform(scaler.transform(rows)).withColumn("z", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def cross_validated_accuracy(df: DataFrame, columns: list[str], label: str, order: str, folds: int = 5) -> float:
    """Mean accuracy over folds that are contiguous in `order` within each label."""
    rows = vectors(df, columns, "raw").withColumn("fold", F.ntile(folds).over(Window.partitionBy(label).orderBy(order)) - 1)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    found = []
    for k in range(folds):
        model = LogisticRegression(labelCol=label, regParam=1e-4).fit(scaled.where(F.col("fold") != k))
        found.append(model.transform(scaled.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    return sum(found) / folds


def cluster(df: DataFrame, columns: list[str], k: int, seed: int = 0, method: str = "kmeans", tries: int = 10) -> DataFrame:
    """Adds `prediction`: k-means (the cheapest of the tries) or a full-covariance Gaussian mixture."""
    rows = vectors(df, columns)
    if method == "mixture":
        return GaussianMixture(k=k, seed=seed).fit(rows).transform(rows).drop("features", "probability")
    if method != "kmeans":
        raise ValueError(f"unknown clusterer {method!r}")
    fits = [KMeans(k=k, seed=seed + t).fit(rows) for t in range(tries)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(rows).drop("features")
