"""Random forests as node tables: splits of too few rows are folded back into leaves.

MLlib limits how few rows a leaf may hold, but not how few a node needs to be split. A fitted forest is written out,
which makes it a table of nodes (tree, node, children, rows, prediction); a node whose parent held fewer than
``min_split`` rows is dropped, and a split of fewer is made a leaf with its own prediction. As rows only fall from a
parent to its children, that is one join of the table with itself. What is left is numbered anew and read back as a
model, so that scoring is MLlib's own.
"""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.tables import shared_path

NODE = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """tree, node columns of a saved forest."""
    saved = spark.read.parquet(f"{path}/data")
    return saved.select(F.col("treeID").alias("tree"), "nodeData.*")


def fold(table: DataFrame, min_split: int) -> DataFrame:
    """The table without splits of fewer than ``min_split`` rows, nodes of each tree numbered from 0 in their order."""
    splits = table.where("leftChild >= 0").select("tree", F.explode(F.array("leftChild", "rightChild")).alias("id"), F.col("rawCount").alias("above"))
    kept = table.join(splits, ["tree", "id"], "left").where(F.col("above").isNull() | (F.col("above") >= min_split)).drop("above")
    leaf = (F.col("leftChild") < 0) | (F.col("rawCount") < min_split)
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    kept = kept.withColumns({
        "gain": F.when(leaf, F.lit(-1.0)).otherwise(F.col("gain")),
        "split": F.when(leaf, none).otherwise(F.col("split")),
        "leftChild": F.when(leaf, F.lit(-1)).otherwise(F.col("leftChild")),
        "rightChild": F.when(leaf, F.lit(-1)).otherwise(F.col("rightChild")),
    })
    # a tree is in one task here, as it is in any that scores with it
    numbered = kept.withColumn("new", F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1)
    names = numbered.select("tree", "id", "new")
    for side in ("leftChild", "rightChild"):
        own = names.select("tree", F.col("id").alias(side), F.col("new").alias(f"new_{side}"))
        numbered = numbered.join(own, ["tree", side], "left")
    return numbered.select(
        "tree",
        F.col("new").alias("id"),
        "prediction", "impurity", "impurityStats", "rawCount", "gain",
        *[F.coalesce(f"new_{side}", F.lit(-1)).cast("int").alias(side) for side in ("leftChild", "rightChild")],
        "split",
    )


def with_min_split(model: RandomForestRegressionModel, spark: SparkSession, min_split: int) -> RandomForestRegressionModel:
    """The forest with every split of fewer than ``min_split`` rows folded back."""
    whole, folded = shared_path(spark, "forest"), shared_path(spark, "forest-folded")
    model.write().overwrite().save(whole)
    model.write().overwrite().save(folded)
    table = fold(nodes(spark, whole), min_split)
    table.select(F.col("tree").alias("treeID"), F.struct(*NODE).alias("nodeData")).write.mode("overwrite").parquet(f"{folded}/data")
    return RandomForestRegressionModel.load(folded)
