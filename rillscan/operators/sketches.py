"""Frequency sketches and samples of distinct tokens; every one merges by the aggregate that builds it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_long


def frequencies(stream: DataFrame) -> DataFrame:
    """(token, n, share): exact counts."""
    counted = stream.groupBy("token").agg(F.count("*").alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("total"))).select("token", "n", (F.col("n") / F.col("total")).alias("share"))


def _salted(name: str, row, token):
    return md5_long(F.concat_ws(":", F.lit(name), row.cast("string"), token))


def sketch_size(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth): a power of two of at least 3 / epsilon ** 2 buckets, and ln(1 / delta) rows, an odd number."""
    return 1 << max(0, math.ceil(math.log2(3 / epsilon**2))), max(1, math.ceil(math.log(1 / delta))) | 1


def count_sketch(stream: DataFrame, width: int, depth: int) -> DataFrame:
    """(row, bucket, value): signed counts. Tokens are counted first, so a common token is one row in each sketch row."""
    counted = stream.groupBy("token").agg(F.count("*").alias("n")).select("token", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    sign = F.when(_salted("s", F.col("row"), F.col("token")) % 2 == 0, 1).otherwise(-1)
    return counted.groupBy("row", (_salted("b", F.col("row"), F.col("token")) % width).alias("bucket")).agg(F.sum(F.col("n") * sign).alias("value"))


def sketch_estimates(sketch: DataFrame, tokens: DataFrame, width: int, depth: int) -> DataFrame:
    """(token, estimate): the upper median over the rows."""
    rows = tokens.select("token", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    sign = F.when(_salted("s", F.col("row"), F.col("token")) % 2 == 0, 1).otherwise(-1)
    placed = rows.withColumns({"bucket": _salted("b", F.col("row"), F.col("token")) % width, "sign": sign})
    values = placed.join(sketch, ["row", "bucket"], "left").groupBy("token").agg(F.sort_array(F.collect_list(F.coalesce(F.col("value") * F.col("sign"), F.lit(0)))).alias("v"))
    return values.select("token", F.get("v", F.lit(depth // 2)).cast("long").alias("estimate"))


def bucket_sample(stream: DataFrame, buckets: int) -> DataFrame:
    """(bucket, token): of each hash bucket the token of the least priority; a uniform sample of distinct tokens."""
    # hashes are made of distinct tokens only
    placed = stream.select("token").distinct().select("token", (md5_long(F.concat(F.lit("b:"), "token")) % buckets).alias("bucket"), md5_long(F.concat(F.lit("p:"), "token")).alias("priority"))
    return placed.groupBy("bucket").agg(F.min(F.struct("priority", "token")).alias("least")).select("bucket", "least.token")


def bottom_k(stream: DataFrame, k: int) -> DataFrame:
    """(token, priority): the k distinct tokens of the least hashes."""
    return stream.select("token").distinct().select("token", md5_long(F.concat(F.lit("p:"), "token")).alias("priority")).orderBy("priority", "token").limit(k)


def sample_quantile(sample: DataFrame, counts: DataFrame, q: float) -> DataFrame:
    """(token, n): the sampled token whose frequency is the nearest-rank quantile. The sample has a row for each bucket at most."""
    order = Window.orderBy("n", "token")
    ranked = sample.join(counts, "token").select("token", "n", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy()).alias("size"))
    return ranked.where(F.col("rank") == F.greatest(F.lit(1), F.ceil(q * F.col("size")))).select("token", "n")


def seeded_sample(stream: DataFrame, by: list[str], buckets: int, seed: str) -> DataFrame:
    """(by.., bucket, token, priority): in each group, of each hash bucket the distinct token of the least priority; other seeds, other samples.

    Samples of parts merge by the same rule: see ``merge_samples``.
    """
    placed = stream.select(*by, "token", (md5_long(F.concat(F.lit(f"b{seed}:"), "token")) % buckets).alias("bucket"), md5_long(F.concat(F.lit(f"p{seed}:"), "token")).alias("priority"))
    return merge_samples(placed, by)


def merge_samples(samples: DataFrame, by: list[str]) -> DataFrame:
    """One sample of what several samples(by.., bucket, token, priority) together have seen."""
    return samples.groupBy(*by, "bucket").agg(F.min(F.struct("priority", "token")).alias("least")).select(*by, "bucket", "least.token", "least.priority")


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by.., value): the value of rank ceil(q n), at least the first, of each group, small groups in an array each."""
    sorted_ = F.sort_array(F.collect_list(value))
    return rows.groupBy(*by).agg(sorted_.alias("v")).select(*by, F.get("v", F.greatest(F.ceil(F.lit(q) * F.size("v")), F.lit(1)).cast("int") - 1).alias(value))


def rank_errors(found: DataFrame, counts: DataFrame, q: float) -> DataFrame:
    """found(.., n) with ``truth``, ``value_error``, ``rank_error``: against the exact quantile of counts(n), and how far the found value's ranks are from q.

    A value has all ranks from the share of smaller counts to that of counts up to it.
    """
    per = counts.groupBy("n").agg(F.count("*").alias("tokens"))  # a row for each distinct frequency
    reach = per.select(F.col("n").alias("at"), F.sum("tokens").over(Window.orderBy("n")).alias("upto"), F.sum("tokens").over(Window.partitionBy()).alias("size"))
    truth = reach.where(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("size")), F.lit(1))).agg(F.min("at").alias("truth"))
    pairs = found.crossJoin(F.broadcast(truth)).join(reach, F.col("at") <= F.col("n"), "left")
    groups = [c for c in found.columns] + ["truth"]
    at_most = pairs.groupBy(*groups).agg(F.coalesce(F.max(F.col("upto") / F.col("size")), F.lit(0.0)).alias("high"), F.coalesce(F.max(F.when(F.col("at") < F.col("n"), F.col("upto") / F.col("size"))), F.lit(0.0)).alias("low"))
    off = F.when(F.lit(q) < F.col("low"), F.col("low") - q).when(F.lit(q) > F.col("high"), q - F.col("high")).otherwise(0.0)
    return at_most.select(*groups, (F.abs(F.col("n") - F.col("truth")) / F.greatest(F.col("truth"), F.lit(1))).alias("value_error"), off.alias("rank_error"))
