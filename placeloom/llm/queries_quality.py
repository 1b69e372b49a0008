"""Quality classifier: the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import quality_model
from placeloom.llm.registry import query, table


def grade() -> Column:
    """0 poor, 1 good prose that is toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        F.col("quality") == 1, 2
    )


@query("op6_quality_model")
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), grade())
    return quality_model.score(docs, model)
