"""Exact medians by group, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmatch.plans.scratch import save


def grouped(rows: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """(key, median): the middle value, or the mean of the two; null values and keys are left out.

    Equal values are counted first, then dealt by ranges of (key, value), so that
    a large group lies in as many ranges as it needs. Counts of the ranges before
    make ranks of them; only the rows at the middle ranks go on.
    """
    counted = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    part = save(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    sums = part.groupBy("k", "part").agg(F.sum("n").alias("m"))
    own = Window.partitionBy("k")
    before = sums.select("k", "part", (F.sum("m").over(own.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(own).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("k", "part").orderBy("v"))
    ranked = part.withColumn("upto", upto).join(before, ["k", "part"])
    last = F.col("before") + F.col("upto") - 1  # ranks from 0
    first = last - F.col("n") + 1
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    hit = ranked.where((first <= high) & (last >= low)).select("k", "v", ((first <= low) & (last >= low)).alias("is_low"), ((first <= high) & (last >= high)).alias("is_high"))
    middle = (F.max(F.when(F.col("is_low"), F.col("v"))) + F.max(F.when(F.col("is_high"), F.col("v")))) / 2
    return hit.groupBy(F.col("k").alias(key)).agg(middle.alias(name))
