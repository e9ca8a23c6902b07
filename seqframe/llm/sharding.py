"""Sharding by sampled splitters (native).

Draw a size-weighted sample of keys, take its quantiles as splitters, deal the records into the ranges
between them, divide overfull ranges by a second hash, then place shard boundaries by exact running sums.
All rows take part in the sums; only the splitters come from a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, at, count_at_most, documents

#: Ranges for each shard, and keys drawn for each range. At most MAX_RANGES ranges, so the driver holds at
#: most MAX_RANGES * KEYS_PER_RANGE sampled keys (in expectation) whatever the input.
RANGES_PER_SHARD, KEYS_PER_RANGE, ROWS_PER_RANGE, MAX_RANGES = 32, 16, 100_000, 16_384


def splitters(slim: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample: a row enters with probability min(1, weight / step)."""
    step = max(1.0, total / (ranges * KEYS_PER_RANGE))
    chance = F.pmod(F.xxhash64("_slice", "_key", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = slim.where(chance < F.col("_w") / step).select("_key", F.greatest(F.col("_w").cast("double"), F.lit(step)).alias("v"))
    keys = sorted((r[0], r[1]) for r in drawn.collect())
    each, out, so_far = sum(v for _, v in keys) / ranges, [], 0.0
    for k, v in keys:
        if so_far >= each * (len(out) + 1) and (not out or k > out[-1]):
            out.append(k)
        while so_far >= each * (len(out) + 1) and len(out) < ranges:
            out.append(out[-1] if out else k)
        so_far += v
    return sorted(set(out))


def shard(df: DataFrame, n_shards: int, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of n_shards shards of near equal bytes (or rows).

    Returns id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (0 for null), law, shard and
    slot (position in the shard, gapless from 0). Rows are ordered by the hash of their text, so equal texts
    are neighbours and share a shard unless a boundary falls between them. `bytes`: a shard's bytes differ from
    total / n by less than two records; `rows`: counts differ by one at most. Null ids, null and empty texts and
    repeated rows are placed like any other row; an empty table gives an empty result.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    spark = df.sparkSession
    tables = Tables(spark, "shard")
    slim = df.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("_size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("_crc"),
        F.xxhash64(text_col).alias("_key"),
        # Rows without an id are told apart by their place, so that many of one text are divided like others.
        F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col), F.lit("slice"))).alias("_slice"),
    )
    slim = tables.keep(slim.withColumn("_w", F.col("_size") if law == "bytes" else F.lit(1).cast("long")), "slim")
    total, rows = slim.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = int(max(RANGES_PER_SHARD * n_shards, min(MAX_RANGES, rows // ROWS_PER_RANGE)))
    cuts = splitters(slim, total, ranges) if rows else []
    n_ranges = len(cuts) + 1
    ranged = slim.withColumn("_range", count_at_most(cuts, F.col("_key")).cast("int"))
    # Overfull ranges (a hot key, say) are divided evenly by the hash of the id.
    held = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum("_w")).collect()}
    each = max(1.0, total / ranges)
    parts = [max(1, round(held.get(i, 0) / each)) for i in range(n_ranges)]
    first = [sum(parts[:0])]
    for p in parts:
        first.append(first[-1] + p)
    cut = ranged.withColumn("_bucket", (at(first, F.col("_range")) + F.pmod(F.col("_slice"), at(parts, F.col("_range")))).cast("int"))
    sums = {r[0]: (r[1], r[2]) for r in cut.groupBy("_bucket").agg(F.sum("_w"), F.count(F.lit(1))).collect()}
    weight_before, rows_before, w, n = [], [], 0, 0
    for b in range(first[-1]):
        weight_before.append(w)
        rows_before.append(n)
        w, n = w + sums.get(b, (0, 0))[0], n + sums.get(b, (0, 0))[1]
    order = Window.partitionBy("_bucket").orderBy("_key", "_slice", "_id", "_crc", "_size")
    placed = (
        cut.withColumn("_rank", F.row_number().over(order) - 1)
        .withColumn("_sum", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
        .select(
            "_id", "_size", "_crc",
            F.least(F.lit(n_shards - 1), F.floor((at(weight_before, F.col("_bucket")) + F.col("_sum")) * n_shards / F.lit(max(1, total)))).cast("int").alias("_shard"),
            (at(rows_before, F.col("_bucket")) + F.col("_rank")).alias("_place"),
        )
    )
    placed = tables.keep(placed, "placed")
    starts = {r[0]: r[1] for r in placed.groupBy("_shard").agg(F.min("_place")).collect()}
    start = at([starts.get(s, 0) for s in range(n_shards)], F.col("_shard"))
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - start).cast("long").alias("slot"),
    )


def op2_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(documents(spark, sf_dir), 24, "bytes").withColumn("grown_shard", F.lit(None).cast("int"))
