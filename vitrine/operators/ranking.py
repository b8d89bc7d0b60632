"""Global ROW_NUMBER without pulling all rows into one task.

A plain ``row_number().over(Window.orderBy(...))`` plans an exchange into a
single partition. Here the rows are range-partitioned and sorted by the full
ordering (the range partitioner samples boundaries on all order columns, so a
run of equal leading values is still split across tasks when later columns
differ), each row gets an id holding its partition index and its position in
that partition, the rows are written once to the shared checkpoint folder (so
the ids are fixed however often they are read), and per-partition row counts
become offsets. The offsets table has one row per sort partition, a bound set
by the shuffle partition count, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.materialize import materialize

_POS_BITS = 33          # monotonically_increasing_id: partition index << 33 | position


def global_row_number(df: DataFrame, order: list[Column], out: str = "row_number") -> DataFrame:
    """Add ``out`` = 1-based position of each row in the total ``order``.

    ``order`` should make the order total (end with a unique key), otherwise
    ties get an arbitrary but fixed numbering.
    """
    tagged = materialize(
        df.orderBy(*order).withColumn("_rn_id", F.monotonically_increasing_id()), "rank")
    part = F.shiftright(F.col("_rn_id"), _POS_BITS)
    pos = F.col("_rn_id").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    before = Window.orderBy("_rn_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(part.alias("_rn_part")).agg(F.count(F.lit(1)).alias("_rn_n"))
        .select("_rn_part", F.coalesce(F.sum("_rn_n").over(before), F.lit(0)).alias("_rn_off"))
    )
    return (
        tagged.join(F.broadcast(offsets), part == F.col("_rn_part"))
        .withColumn(out, F.col("_rn_off") + pos + 1)
        .drop("_rn_id", "_rn_part", "_rn_off")
    )
