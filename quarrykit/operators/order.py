"""Places of rows in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.sources.folders import shared_folder


def placed(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``by``: sorted by ranges over all tasks, of which a row each is counted.

    The sorted rows are written to the shared folder, so that a lost task does not deal them anew; select what is needed
    first. No task sees more than its range, whatever the values are.
    """
    shared_folder(df.sparkSession)
    sorted_rows = df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    task = F.shiftright("_at", 33)
    tasks = sorted_rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    starts = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))  # a row a task
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.join(F.broadcast(starts), task == F.col("_task")).withColumn(name, F.col("_before") + within).drop("_at", "_task", "_before")
