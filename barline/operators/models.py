"""Models on feature vectors: clusters, frozen centroids, classifiers, calibration."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_count(rows: int, least: int = 5, most: int = 500) -> int:
    """Square root of half the rows, between least and most."""
    return max(least, min(most, int(math.sqrt(rows / 2))))


def archetypes(vectors: DataFrame, key: str, x: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(key, cluster, distance): standardised vectors by k-means, with the distance to the own centre."""
    rows = vectors.select(key, array_to_vector(x).alias("raw")).where("raw IS NOT NULL")
    k = k or cluster_count(rows.count())
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=20).fit(scaled)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    told = model.transform(scaled).select(key, F.col("prediction").alias("cluster"), vector_to_array("features").alias("f"))
    gap = F.aggregate(F.zip_with("f", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return told.select(key, "cluster", F.sqrt(gap).alias("distance"))


def classify(rows: DataFrame, x: str, label: str, train: str) -> DataFrame:
    """rows with p, the probability of label 1 by class-weighted logistic regression fitted where the condition train holds."""
    v = rows.withColumn("_x", array_to_vector(x)).withColumn("_y", F.col(label).cast("double"))
    fit = v.where(train).where("_y IS NOT NULL")
    share = fit.agg(F.avg("_y")).first()[0] or 0.5
    fit = fit.withColumn("_w", F.when(F.col("_y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", maxIter=30).fit(fit)
    return model.transform(v).withColumn("p", vector_to_array("_p")[1]).select(*rows.columns, "p")


def calibrate(rows: DataFrame, p: str, label: str, train: str) -> DataFrame:
    """rows with calibrated: p through an isotonic step fitted where train holds."""
    y = rows.withColumn("_y", F.col(label).cast("double"))
    model = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol="calibrated").fit(y.where(train).where("_y IS NOT NULL"))
    return model.transform(y).drop("_y")
