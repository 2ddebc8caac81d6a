"""Inverse document frequency weights for count vectors."""

from __future__ import annotations

from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_tfidf(points: DataFrame) -> DataFrame:
    """Replace count vectors by unit vectors of counts times ln((rows + 1) / (rows with it + 1))."""
    counted = points.withColumn("_counts", array_to_vector(F.col("vector")))
    # Fitting folds one array of the vector's length per task; nothing grows with rows.
    weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_weighted", outputCol="_unit").transform(weighted)
    return unit.withColumn("vector", vector_to_array("_unit", "float32")).drop("_counts", "_weighted", "_unit")
