"""Suffix arrays of streams by prefix doubling, no text is copied for a suffix.

Streams of up to MOST_TOKENS tokens are ranked and searched in the memory of the task that holds them, many at
a time; longer ones by windows and joins, which spill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, reach

#: Patterns that are sent to every stream's search at once.
MOST_PATTERNS = 100_000
#: Tokens of the longest stream, and of all patterns, that a task holds in memory.
MOST_TOKENS = 1 << 20
#: Tokens of streams that are ranked or searched at a time.
TOKENS = 1 << 16


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key; the first does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _begins(ids: pa.ChunkedArray) -> np.ndarray:
    """Whether a stream begins at a row of sorted streams; null is a stream too."""
    return _starts(pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by stream as tables of whole streams, of some TOKENS rows each."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        # a stream is whole once another one has begun
        if rows >= TOKENS and held[0].column("stream_id")[0].as_py() != batch.column("stream_id")[-1].as_py():
            table = pa.Table.from_batches(held).combine_chunks()
            end = int(np.flatnonzero(_begins(table.column("stream_id")))[-1])
            yield table.slice(0, end)
            held = table.slice(end).to_batches()
            rows = table.num_rows - end
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(tokens: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 1 on of tokens, in their order; 0 for none."""
    known = sorted(t for t in tokens.unique().to_pylist() if t is not None)
    return pc.fill_null(pc.add(pc.index_in(tokens, pa.array(known, tokens.type)), 1), 0).to_numpy().astype(np.int64)


def suffix_array(stream: DataFrame, longest: int) -> DataFrame:
    """(stream_id, pos, rank): order of the suffixes of each stream; exact for streams of up to ``longest`` tokens.

    ``longest`` is the length of the longest stream, or less where ranks by so many tokens are enough.
    """
    if longest > MOST_TOKENS:
        return _by_windows(stream, longest)
    reach(stream.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            streams = np.cumsum(_begins(table.column("stream_id"))) - 1
            rank, n, span = _codes(table.column("token")), len(streams), 1
            while True:
                order = np.lexsort((rank, streams)) if span == 1 else np.lexsort((after, rank, streams))
                new = _starts(streams[order], rank[order]) if span == 1 else _starts(streams[order], rank[order], after[order])
                # numbers count on from one stream to the next, so that those of different streams differ
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(new)
                if span >= longest or new.all():
                    break
                after = np.zeros(n, np.int64)
                if span < n:
                    after[:-span] = np.where(streams[span:] == streams[:-span], rank[span:], 0)
                span *= 2
            first = np.flatnonzero(_starts(streams))
            least = np.minimum.reduceat(rank, first)
            yield from pa.table({"stream_id": table.column("stream_id"), "pos": table.column("pos"), "rank": pa.array(rank - least[streams])}).to_batches(max_chunksize=TOKENS)

    held = stream.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("pos").cast("long").alias("pos"), "token")
    return held.repartition("stream_id").sortWithinPartitions("stream_id", "pos").mapInArrow(run, "stream_id long, pos long, rank long")


def _by_windows(stream: DataFrame, longest: int) -> DataFrame:
    """The same ranks by windows in each stream."""
    by = lambda *c: Window.partitionBy("stream_id").orderBy(*c)
    ranks = stream.select("stream_id", "pos", (F.dense_rank().over(by("token")) - 1).cast("long").alias("rank"))
    span = 1
    while span < longest:
        paired = ranks.withColumn("next", F.coalesce(F.lead("rank", span).over(by("pos")), F.lit(-1).cast("long")))
        ranks = cut(paired.select("stream_id", "pos", (F.dense_rank().over(by("rank", "next")) - 1).cast("long").alias("rank")))
        span *= 2
    return ranks


def lcp(ranks: DataFrame, steps: list[tuple[int, DataFrame]]) -> DataFrame:
    """(stream_id, rank, lcp): tokens that each suffix shares with the next in order, from the ranks of doubling.

    steps(span, ranks of the first ``span`` tokens), the longest first: where both suffixes have equal ranks
    they share ``span`` tokens more, and the comparison goes on behind them.
    """
    by = Window.partitionBy("stream_id").orderBy("rank")
    pairs = ranks.select("stream_id", "rank", F.col("pos").alias("a"), F.lead("pos").over(by).alias("b")).withColumn("lcp", F.lit(0).cast("long"))
    for span, known in steps:
        one, two = (known.select("stream_id", (F.col("pos")).alias(f"{side}_at"), F.col("rank").alias(f"{side}_rank")) for side in "ab")
        both = pairs.withColumns({"a_at": F.col("a") + F.col("lcp"), "b_at": F.col("b") + F.col("lcp")}).join(one, ["stream_id", "a_at"], "left").join(two, ["stream_id", "b_at"], "left")
        pairs = both.select("stream_id", "rank", "a", "b", F.when(F.col("a_rank") == F.col("b_rank"), F.col("lcp") + span).otherwise(F.col("lcp")).alias("lcp"))
    return pairs.select("stream_id", "rank", "lcp")


def doubled(stream: DataFrame, longest: int) -> list[tuple[int, DataFrame]]:
    """(span, (stream_id, pos, rank)) by the first 1, 2, 4 .. tokens, the longest first; ranks only of places with so many tokens left."""
    by = lambda *c: Window.partitionBy("stream_id").orderBy(*c)
    ranks = cut(stream.select("stream_id", "pos", F.dense_rank().over(by("token")).cast("long").alias("rank")))
    steps, span = [(1, ranks)], 1
    while 2 * span <= longest:
        paired = ranks.withColumn("next", F.lead("rank", span).over(by("pos"))).where("next is not null")
        ranks = cut(paired.select("stream_id", "pos", F.dense_rank().over(by("rank", "next")).cast("long").alias("rank")))
        span *= 2
        steps.append((span, ranks))
    return steps[::-1]


class Trie:
    """Patterns of tokens, by edges (node, token) in order."""

    def __init__(self, patterns: list[tuple[int, list[str]]]):
        self.codes = {t: i for i, t in enumerate(dict.fromkeys(t for _, tokens in patterns for t in tokens))}
        edges, ends = {}, {}
        for pid, tokens in patterns:
            node = 0
            for t in tokens:
                node = edges.setdefault((node, self.codes[t]), len(edges) + 1)
            ends.setdefault(node, []).append(pid)
        keys = np.array([node * len(self.codes) + code for node, code in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.pids = np.array([p for node in sorted(ends) for p in ends[node]], np.int64)
        self.times = np.zeros(len(edges) + 1, np.int64)
        self.times[list(ends)] = [len(p) for p in ends.values()]
        self.firsts = np.cumsum(self.times) - self.times

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by its token's code, or 0."""
        keys = nodes * len(self.codes) + codes
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((codes >= 0) & (self.keys[at] == keys), self.children[at], 0)


def _descend(trie: Trie, streams: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pid, row) arrays of the matches in streams that stand one behind the other, by their suffix arrays.

    The suffixes that begin with a node's tokens are neighbours in the order of ranks. Each round splits these runs
    by the next token, and drops those that the trie does not go on with, whole.
    """
    leaves, depth = np.lexsort((ranks, streams)), 0
    run, node = streams[leaves], np.zeros(len(leaves), np.int64)
    while len(leaves):
        at = leaves + depth
        inside = at < len(streams)
        at = np.where(inside, at, 0)
        code = np.where(inside & (streams[at] == streams[leaves]), codes[at], -1)
        heads = np.flatnonzero(_starts(run, code))
        sizes = np.diff(heads, append=len(leaves))
        child = trie.step(node[heads], code[heads])
        goes_on = np.repeat(child > 0, sizes)
        run, node, leaves = np.repeat(np.arange(len(heads)), sizes)[goes_on], np.repeat(child, sizes)[goes_on], leaves[goes_on]
        times, depth = trie.times[node], depth + 1
        if total := int(times.sum()):
            nth = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
            yield trie.pids[np.repeat(trie.firsts[node], times) + nth], np.repeat(leaves, times)


def find(stream: DataFrame, ranks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pid, stream_id, pos): patterns(pid, tokens) searched in each stream's suffix array(stream_id, pos, rank).

    All patterns go down the arrays at once, as a trie along a suffix tree. A larger workload, or a longer stream,
    is searched by rounds of joins.
    """
    sized = patterns.where(F.size("tokens") > 0).select(F.col("pid").cast("long").alias("pid"), "tokens")
    total = sized.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    longest = stream.groupBy("stream_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if total > MOST_TOKENS or longest > MOST_TOKENS:
        return _by_rounds(stream, ranks, sized)
    reach(stream.sparkSession)
    rows = [(r["pid"], r["tokens"]) for r in sized.collect()]  # at most MOST_TOKENS tokens
    sent = stream.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        if not len(trie.keys):
            return
        known = pa.array(list(trie.codes), pa.string())
        for table in _whole(batches):
            # a place's token and its rank come as two rows, the token first
            order = table.column("rank").drop_null().to_numpy()
            places = table.filter(pc.is_null(table.column("rank")))
            if len(order) != places.num_rows:
                raise ValueError("each place of a stream needs one token and one rank")
            streams = np.cumsum(_begins(places.column("stream_id"))) - 1
            codes = pc.fill_null(pc.index_in(places.column("token"), known), -1).to_numpy().astype(np.int64)
            for pids, at in _descend(trie, streams, codes, order):
                found = places.select(["stream_id", "pos"]).take(pa.array(at))
                yield from pa.table([pa.array(pids), *found.columns], ["pid", *found.column_names]).to_batches(max_chunksize=TOKENS)

    # one shuffle of narrow rows in place of a join of two tables
    long = lambda c: F.col(c).cast("long").alias(c)
    both = stream.select(long("stream_id"), long("pos"), "token", F.lit(None).cast("long").alias("rank")).unionByName(ranks.select(long("stream_id"), long("pos"), F.lit(None).cast("string").alias("token"), long("rank")))
    return both.repartition("stream_id").sortWithinPartitions("stream_id", "pos", F.col("rank").asc_nulls_first()).mapInArrow(run, "pid long, stream_id long, pos long")


def _by_rounds(stream: DataFrame, ranks: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same answers by binary search of all patterns in every stream.

    The suffixes that begin with a pattern are neighbours, from the first that is not below it on. All patterns
    are searched at once, and each round of the search halves every range by one join.
    """
    sized = patterns.where(F.size("tokens") > 0).select("pid", "tokens", F.size("tokens").alias("m"))
    longest = sized.agg(F.max("m")).first()[0] or 1
    order = Window.partitionBy("stream_id").orderBy("pos").rowsBetween(0, longest - 1)
    heads = cut(stream.select("stream_id", "pos", F.collect_list("token").over(order).alias("head")).join(ranks, ["stream_id", "pos"]).select("stream_id", "pos", "rank", "head"))
    ends = heads.groupBy("stream_id").agg(F.count("*").alias("n"))
    most = ends.agg(F.max("n")).first()[0] or 0
    # low: ranks below the pattern for sure; high: ranks from here on are not below it (first) or above it (last)
    bounds = ends.crossJoin(F.broadcast(sized)) if sized.count() <= MOST_PATTERNS else ends.join(sized)
    ranges = bounds.select("stream_id", "pid", "m", "tokens", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"), F.lit(0).cast("long").alias("low2"), F.col("n").alias("high2"))
    for _ in range(int(most).bit_length() + 1):
        for low, high, goes_right in (("low", "high", F.col("part") < F.col("tokens")), ("low2", "high2", F.col("part") <= F.col("tokens"))):
            middle = F.floor((F.col(low) + F.col(high)) / 2).cast("long")
            probed = ranges.withColumn("rank", middle).join(heads.select("stream_id", "rank", "head"), ["stream_id", "rank"], "left").withColumn("part", F.slice("head", 1, F.col("m")))
            open_ = F.col(low) < F.col(high)
            right = F.coalesce(goes_right, F.lit(False))
            moved = probed.withColumns({low: F.when(open_ & right, middle + 1).otherwise(F.col(low)), high: F.when(open_ & ~right, middle).otherwise(F.col(high))})
            ranges = moved.select("stream_id", "pid", "m", "tokens", "low", "high", "low2", "high2")
        ranges = cut(ranges)
    found = ranges.where("low < low2").select("pid", "stream_id", F.explode(F.sequence(F.col("low"), F.col("low2") - 1)).alias("rank"))
    return found.join(heads.select("stream_id", "rank", "pos"), ["stream_id", "rank"]).select("pid", "stream_id", "pos")


def borders(patterns: DataFrame) -> DataFrame:
    """(pid, prefix, border): of each prefix of patterns(pid, pattern) the longest proper prefix that is also its suffix, in linear time."""
    reach(patterns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, text in zip(batch.column("pid"), batch.column("pattern").to_pylist()):
                out, k = [0] * len(text), 0
                for i in range(1, len(text)):
                    while k and text[i] != text[k]:
                        k = out[k - 1]
                    k += text[i] == text[k]
                    out[i] = k
                yield pa.record_batch([pa.array([pid.as_py()] * len(out), pa.int64()), pa.array(range(1, len(out) + 1), pa.int64()), pa.array(out, pa.int64())], ["pid", "prefix", "border"])

    return patterns.where("pattern is not null").select(F.col("pid").cast("long").alias("pid"), "pattern").mapInArrow(run, "pid long, prefix long, border long")
