"""Dense row numbers without a single task: a sort by ranges, and an offset for each part."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def numbered(df: DataFrame, order: list[Column], name: str = "n", start: int = 0) -> DataFrame:
    """``df`` with a column ``name`` (long) that numbers its rows in ``order`` from ``start``, without gaps.

    Rows are dealt by ranges of the order, sorted and written with their place in the part; then
    the parts' sizes (all that comes to the driver) give the number that each starts from. Rows that
    tie are numbered as they come.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch_path(spark, "numbered")
    sorted_rows.select("*", F.spark_partition_id().alias("__part"), place.alias("__at")).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = sorted((r[0], r[1]) for r in stored.groupBy("__part").count().collect())
    firsts = accumulate([start, *[n for _, n in sizes[:-1]]])
    # a row for each part
    heads = spark.createDataFrame([(p, f) for (p, _), f in zip(sizes, firsts, strict=False)], "__p int, __first long")
    joined = stored.join(F.broadcast(heads), F.col("__part") == F.col("__p"))
    return joined.select(*[F.col(c) for c in df.columns if c != name], (F.col("__first") + F.col("__at")).alias(name))
