"""Dyadic interval membership: which grams occur in which halves of a block, and search that descends it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability
from ..functions.hashing import md5_long
from ..session import cut
from . import match, sketches


def levels(block: int, least: int) -> list[tuple[int, int]]:
    """(level, span) from the whole block down to spans of ``least`` tokens, which are the effective leaves; least 1 keeps those below a gram's length."""
    out, span = [], block
    while span >= least and span >= 1:
        out.append((len(out), span))
        span //= 2
    return out


def members(grams: DataFrame, block: int, least: int) -> DataFrame:
    """(stream_id, block, level, interval, gram), distinct: the exact form of one filter for each level."""
    spans = F.array(*[F.struct(F.lit(l).alias("level"), F.lit(s).alias("span")) for l, s in levels(block, least)])
    placed = grams.select("stream_id", F.floor(F.col("pos") / block).alias("block"), (F.col("pos") % block).alias("at"), "gram", F.explode(spans).alias("s"))
    return placed.select("stream_id", "block", F.col("s.level").cast("long").alias("level"), F.floor(F.col("at") / F.col("s.span")).alias("interval"), "gram").distinct()


def with_levels(asked: DataFrame, plan: DataFrame) -> DataFrame:
    """asked(pid, k, gram, m) with ``seed``, the level where a pattern's search begins, and ``least``, from which on each gram is probed.

    plan(pid, level) or plan(pid, k, level). With a level for each gram the search begins at the
    first gram's, and a gram is skipped above its own.
    """
    if "k" not in plan.columns:
        return asked.join(plan.select("pid", F.col("level").alias("seed")), "pid").withColumn("least", F.col("seed"))
    own = plan.select("pid", "k", F.col("level").alias("least"))
    return asked.join(own, ["pid", "k"]).join(plan.where("k = 0").select("pid", F.col("level").alias("seed")), "pid")


def step(held: DataFrame, nodes: DataFrame, asked: DataFrame, level: int) -> DataFrame:
    """What probing a pattern's grams in order finds in nodes(pid, stream_id, block, interval) of a level.

    met: leading grams that the interval holds, all of them where no probed one is missing; grams: all of the pattern.
    A gram is probed from its ``least`` level on, the first always; after a miss the ones skipped
    before it are probed too, so that ``met`` is exact.
    """
    at = held.where(F.col("level") == level).select("stream_id", "block", "interval", "gram", F.lit(1).alias("yes"))
    probed = nodes.join(asked, "pid").join(at, ["stream_id", "block", "interval", "gram"], "left")
    missing = F.when(F.col("yes").isNull(), F.col("k"))
    counted = probed.groupBy("pid", "stream_id", "block", "interval").agg(F.count("*").alias("grams"), F.min(missing).alias("first"), F.min(F.when((F.col("least") <= level) | (F.col("k") == 0), missing)).alias("seen"), F.first("m").alias("m"))
    return counted.select("pid", "stream_id", "block", "interval", "grams", "m", F.when(F.col("seen").isNull(), F.col("grams")).otherwise(F.col("first")).alias("met"))


def candidates(held: DataFrame, asked: DataFrame, block: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(pid, stream_id, lo, hi): ranges of places where a match may start, and (level, nodes, probes) of the descent to them.

    asked comes from ``with_levels``. An interval without a pattern's first gram is dropped. One with
    all grams is halved while a half can hold the pattern, else it is a range. One with the first c
    grams alone can hold starts in its last c places only: an earlier one's gram c would be inside.
    """
    geometry = levels(block, least)
    firsts = asked.where("k = 0")
    blocks_ = held.where("level = 0").select("stream_id", "block").distinct()
    number = blocks_.agg(F.count("*").alias("blocks"))
    starts = {min(r["seed"], len(geometry) - 1) for r in firsts.select("seed").distinct().collect()}  # levels, so few
    ranges, visits, nodes = [], [], None
    for level, span in geometry:
        if level not in starts and (nodes is None or not nodes.take(1)):
            visits.append(number.select(F.lit(level).cast("long").alias("level"), F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("probes")))
            nodes = None
            continue
        at = held.where(F.col("level") == level)
        # a search that should begin below the last level begins there
        begins = F.col("seed") == level if level + 1 < len(geometry) else F.col("seed") >= level
        seeds = at.join(firsts.where(begins).select("pid", "gram"), "gram").select("pid", "stream_id", "block", "interval")
        begun = firsts.where(begins).agg(F.count("*").alias("patterns")).crossJoin(number).select((F.col("patterns") * F.col("blocks") * (1 << level)).alias("n"))
        if nodes is not None:
            halves = nodes.select("pid", "stream_id", "block", F.explode(F.array(F.col("interval") * 2, F.col("interval") * 2 + 1)).alias("interval"))
            begun = begun.unionByName(halves.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
            seeds = seeds.unionByName(halves.join(firsts.select("pid", "gram"), "pid").join(at.drop("level"), ["stream_id", "block", "interval", "gram"], "left_semi").select("pid", "stream_id", "block", "interval"))
        found = cut(step(held, seeds, asked, level).where("met > 0"))
        # an interval without the first gram costs one probe; one that misses gram c costs c + 1
        visits.append(begun.crossJoin(found.agg(F.count("*").alias("hit"), F.coalesce(F.sum(F.least(F.col("met") + 1, F.col("grams"))), F.lit(0)).alias("probes"))).select(F.lit(level).cast("long").alias("level"), F.col("n").alias("nodes"), (F.col("n") - F.col("hit") + F.col("probes")).alias("probes")))
        halved = (F.col("met") == F.col("grams")) & (F.col("m") <= span // 2) & F.lit(level + 1 < len(geometry))
        nodes = found.where(halved)
        start, end = F.col("block") * block + F.col("interval") * span, F.col("block") * block + (F.col("interval") + 1) * span - 1
        ranges.append(found.where(~halved).select("pid", "stream_id", F.when(F.col("met") == F.col("grams"), start).otherwise(F.greatest(start, end - F.col("met") + 1)).alias("lo"), end.alias("hi")))
    if not ranges:  # no pattern, no range
        ranges = [firsts.select("pid", *[F.lit(None).cast("long").alias(c) for c in ("stream_id", "lo", "hi")]).limit(0)]
    return reduce(DataFrame.unionByName, ranges), reduce(DataFrame.unionByName, visits)


def verify(stream: DataFrame, patterns: DataFrame, ranges: DataFrame) -> DataFrame:
    """(pid, stream_id, pos): starts in the ranges where the stream's tokens are the pattern's; no other place is compared."""
    starts = ranges.select("pid", "stream_id", F.explode(F.sequence("lo", "hi")).alias("start")).distinct()
    tokens = patterns.select("pid", F.size("tokens").alias("m"), F.posexplode("tokens").alias("k", "token"))
    wanted = starts.join(tokens, "pid").select("pid", "stream_id", "start", "m", (F.col("start") + F.col("k")).alias("pos"), "token")
    same = wanted.join(stream, ["stream_id", "pos", "token"]).groupBy("pid", "stream_id", "start").agg(F.count("*").alias("same"), F.first("m").alias("m"))
    return same.where("same = m").select("pid", "stream_id", F.col("start").alias("pos"))


def search(stream: DataFrame, patterns: DataFrame, plan: DataFrame, block: int, n: int) -> DataFrame:
    """(pid, stream_id, pos) of all matches: grams that no pattern has are dropped, the rest is indexed by interval, descended and verified.

    Patterns need n tokens at least. plan(pid, level) or plan(pid, k, level) says where search begins.
    """
    asked = match.pattern_grams(patterns, n)
    grams = match.ngrams(stream, n).join(asked.select("gram").distinct(), "gram", "left_semi")
    held = cut(members(grams, block, n))
    return verify(stream, patterns, candidates(held, with_levels(asked, plan), block, n)[0])


def drop_levels(held: DataFrame, dropped: DataFrame) -> DataFrame:
    """Membership without the upper levels that dropped(stream_id, block, dropped) names; search then begins below them."""
    return held.join(dropped, ["stream_id", "block"], "left").where(F.col("dropped").isNull() | (F.col("level") >= F.col("dropped"))).drop("dropped")


def _places(gram, bits: int, hashes: int):
    """Places from 1 on, by two hashes out of one."""
    h = md5_long(gram)
    a, b = h % bits, F.floor(h / bits) % (bits - 1) + 1
    return F.array(*[(a + b * k) % bits + 1 for k in range(hashes)])


def bloom_build(grams: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(key, bucket, bitmap): a Bloom filter for each key, as bitmaps of 32768 bits; merging is a bitwise or."""
    places = grams.select(key, F.explode(_places(F.col("gram"), bits, hashes)).alias("p"))
    return places.groupBy(key, F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def bloom_probe(filters: DataFrame, key: str, asked: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, gram) pairs of asked(gram) that a filter says yes to: never a false no."""
    places = asked.select("gram", F.explode(F.array_distinct(_places(F.col("gram"), bits, hashes))).alias("p")).withColumns({"bucket": F.bitmap_bucket_number("p"), "bit": F.bitmap_bit_position("p").cast("int")})
    needed = places.groupBy("gram").agg(F.count("*").alias("needed"))
    met = places.join(filters, "bucket").where(F.expr("shiftright(conv(hex(substring(bitmap, cast(floor(bit / 8) as int) + 1, 1)), 16, 10)::int, bit % 8) & 1 = 1"))
    return met.groupBy(key, "gram").agg(F.count("*").alias("met")).join(needed, "gram").where("met = needed").select(key, "gram")


def policy_levels(grams: DataFrame, block: int, confidence: float, beta: float, buckets: int, quantile: float = 0.05, predictive: bool = False) -> DataFrame:
    """(stream_id, block, dropped): upper levels that each block's filters lose when it is full.

    Each block has a sampler of its own, ``buckets`` distinct grams; the frequency at the quantile of
    the sampled ones says how deep a search of rare grams begins. predictive: the next block begins
    without the levels that the last one lost.
    """
    placed = grams.select("stream_id", F.floor(F.col("pos") / block).alias("block"), F.col("gram").alias("token"))
    counts = placed.groupBy("stream_id", "block", "token").agg(F.count("*").alias("n"))
    totals = placed.groupBy("stream_id", "block").agg(F.count("*").alias("total"))
    sampled = sketches.seeded_sample(counts, ["stream_id", "block"], buckets, "").join(counts, ["stream_id", "block", "token"])
    rare = sketches.nearest_rank(sampled, ["stream_id", "block"], "n", quantile).join(totals, ["stream_id", "block"])
    p = F.col("n") / F.col("total")
    last = block.bit_length() - 1
    own = rare.select("stream_id", "block", F.when(p >= 1, 0).otherwise(probability.pruning_level_filtered(block, confidence, F.least(p, F.lit(0.999999)), beta)).cast("long").alias("dropped"))
    if not predictive:
        return own
    before = F.least(F.coalesce(F.lag("dropped").over(Window.partitionBy("stream_id").orderBy("block")), F.lit(0)), F.lit(last))
    return own.withColumn("dropped", F.greatest("dropped", before).cast("long"))
