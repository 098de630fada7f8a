"""N-gram models of token streams: the chance of a token after a context, of any order, with back-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import SEPARATOR


def build(stream: DataFrame, order: int) -> DataFrame:
    """(length, context, token, n, p): counts and shares of each token after contexts of 0 to order - 1 tokens; the context of length 0 is empty."""
    by = Window.partitionBy("stream_id").orderBy("pos")
    back = stream.select("token", *[F.lag("token", k).over(by).alias(f"b{k}") for k in range(1, order)])
    each = [F.when(F.col(f"b{length}").isNotNull() if length else F.lit(True), F.struct(F.lit(length).alias("length"), F.concat_ws(SEPARATOR, *[f"b{k}" for k in range(length, 0, -1)]).alias("context"))) for length in range(order)]
    counted = back.select("token", F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("c")).groupBy("c.length", "c.context", "token").agg(F.count("*").alias("n"))
    totals = counted.groupBy("length", "context").agg(F.sum("n").alias("total"))
    return counted.join(totals, ["length", "context"]).select(F.col("length").cast("long").alias("length"), "context", "token", "n", (F.col("n") / F.col("total")).alias("p"))


def conditional(sequences: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(seq_id, pos, token, p) of sequences(seq_id, pos, token): by the longest context that the model has seen, or else the token's own share.

    A seen context after which the token never came gives 0, as does a token that the model has not seen.
    """
    by = Window.partitionBy("seq_id").orderBy("pos")
    rows = sequences.select("seq_id", "pos", "token", *[F.lag("token", k).over(by).alias(f"b{k}") for k in range(1, order)])
    seen = model.select("length", "context").distinct()
    chances = []
    for length in range(order - 1, 0, -1):
        context = F.when(F.col(f"b{length}").isNotNull(), F.concat_ws(SEPARATOR, *[f"b{k}" for k in range(length, 0, -1)]))
        known = seen.where(F.col("length") == length).select(F.col("context").alias(f"c{length}"), F.lit(0.0).alias(f"seen{length}"))
        own = model.where(F.col("length") == length).select(F.col("context").alias(f"c{length}"), "token", F.col("p").alias(f"p{length}"))
        rows = rows.withColumn(f"c{length}", context).join(known, f"c{length}", "left").join(own, [f"c{length}", "token"], "left")
        chances += [F.col(f"p{length}"), F.col(f"seen{length}")]
    alone = model.where("length = 0").select("token", F.col("p").alias("p0"))
    rows = rows.join(alone, "token", "left")
    known = F.col("p0").isNotNull()
    return rows.select("seq_id", "pos", "token", F.when(known, F.coalesce(*chances, "p0")).otherwise(0.0).alias("p"))


def first_order(model: DataFrame) -> DataFrame:
    """(before_token, token, n, p): the transitions from one token to the next."""
    return model.where("length = 1").select(F.col("context").alias("before_token"), "token", "n", "p")
