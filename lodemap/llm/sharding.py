"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts the rows, in order of ``key``, into ``shards`` contiguous shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). With T the total and p the bytes before a row, its
    shard is the one of ``shards`` equal targets that holds the middle of the row, so no shard misses its target by more
    than the rows at its two cuts. Returns key, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null: this law cuts anew when shards are added).

    Rows with equal keys are ordered by checksum, size and place in the input; null keys come first. Other columns are
    ignored, whatever their names. An empty table gives no rows; one huge row fills its shard and others may stay empty.

    One range exchange of narrow rows (the text stays behind); all that is gathered afterwards is one row a partition and
    one row a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__at"),
    )
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("__at")]
    local = Window.partitionBy("__part").orderBy(*order)
    ranged = rows.repartitionByRange(spread(docs), *order).withColumn("__part", F.spark_partition_id())
    # the table fixes which partition a row is in; the running sums below only ever compare rows of one partition
    ranged = written(ranged.sortWithinPartitions(*order), "shards")
    totals = ranged.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(everything).alias("__total"),
    )
    placed = (
        ranged.withColumn("__end", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__row", F.row_number().over(local))
        .join(F.broadcast(starts), "__part")  # a row for each partition of the range exchange
        .withColumn("__at_byte", F.col("__bytes_before") + F.col("__end") - F.col("size"))
        .withColumn("__at_row", F.col("__rows_before") + F.col("__row") - 1)
        .withColumn("shard", F.expr(f"cast(({shards}L * (2 * __at_byte + size)) div (2 * __total) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("__at_row").alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__at_row") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
