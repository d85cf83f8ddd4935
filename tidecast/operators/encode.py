"""Label codes and standard scaling as tables, made and applied by Spark.

A text column's labels are numbered in their order: the distinct labels are dealt out by range, counted per range, and a
label's code is its place within its range plus the labels of all ranges before. No task holds more than a range, and
no label passes through the driver, however many there are. Codes are a (column, label, code) table: it is stored, read
again and joined; labels it doesn't hold, and NULL, get the number of labels as their code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..session import cut_lineage, target_parallelism

#: Labels of a range, at least, before there are several.
RANGE_LABELS = 100_000


def label_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, label, rows: every label that stands in ``df`` and in how many rows it does, by one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("label")) for c in columns]))
    labels = df.select(each.alias("x")).select("x.*").where("label is not null")
    return cut_lineage(labels.groupBy("column", "label").agg(F.count(F.lit(1)).alias("rows")))


def label_codes(df: DataFrame, columns: Sequence[str], range_labels: int = RANGE_LABELS, labels: DataFrame | None = None) -> DataFrame:
    """column, label, code (from 0, by the label's place in byte order) of every label that stands in ``df``.

    ``labels`` is the table of ``label_rows``, if it is there already.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, label string, code long")
    labels = label_rows(df, columns) if labels is None else labels
    ranges = max(1, min(target_parallelism(spark), -(-labels.count() // range_labels)))
    # ranges are drawn from a sample: they are written down before anything depends on them
    dealt = cut_lineage(labels.drop("rows").repartitionByRange(ranges, "column", "label").withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("column", "part").orderBy("label")
    sizes = dealt.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")).drop("n")
    placed = dealt.withColumn("place", F.row_number().over(inner)).join(before, ["column", "part"])
    return placed.select("column", "label", (F.col("before") + F.col("place") - 1).cast("long").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], suffix: str = "__code") -> DataFrame:
    """``df`` with a code (double) for each of ``columns``; unseen labels and NULL share the next free code."""
    out = df
    for c in columns:
        own = codes.where(F.col("column") == c)
        known = own.select(F.col("label").alias(f"__{c}_label"), F.col("code").alias(f"__{c}_code"))
        out = out.join(known, F.col(f"`{c}`") == F.col(f"__{c}_label"), "left")
        free = own.agg(F.count(F.lit(1)).alias("n")).scalar()
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"__{c}_code"), free).cast("double")).drop(f"__{c}_label", f"__{c}_code")
    return out


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` less their mean, over their sample deviation (0 where a column doesn't vary), as array ``features``."""
    figures = [g for i, c in enumerate(columns) for g in (F.avg(c).alias(f"__m{i}"), F.stddev_samp(c).alias(f"__s{i}"))]
    one = attach_row(df, cut_lineage(df.agg(*figures)))
    each = [F.when(F.col(f"__s{i}") > 0, (F.col(f"`{c}`") - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}"))).otherwise(F.lit(0.0)) for i, c in enumerate(columns)]
    return one.withColumn("features", F.array(*each)).drop(*[f"__{k}{i}" for i in range(len(columns)) for k in "ms"])
