"""Exact pattern search: every start of every pattern in every stream.

Characters are searched by one automaton over all patterns, which reads each text once
whatever the number and the lengths of the patterns; a workload too large for one automaton
is joined with overlapping blocks of the texts instead. In token streams a short pattern is
joined with the grams of its own length; longer ones are searched by relational division: the
n-grams of patterns are joined with those of streams, and a start counts if all of a pattern's
grams agree on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach

#: Starts in a block of characters.
BLOCK = 512
SEPARATOR = "\x01"
#: Tokens of the longest patterns that meet grams of their own length.
WHOLE = 8
#: Characters of all patterns that one automaton holds, or that are sent to every task.
MOST_CHARACTERS = 1 << 22


def blocks(texts: DataFrame, overlap: int, size: int = BLOCK) -> DataFrame:
    """(stream_id, off, block): texts in blocks of ``size`` characters and what follows them, in time linear in the text."""
    pattern = F.lit(f"(?s)(.{{1,{size}}})(?=(.{{0,{overlap}}}))")
    parts = F.arrays_zip(F.regexp_extract_all("text", pattern, 1).alias("own"), F.regexp_extract_all("text", pattern, 2).alias("next"))
    return texts.select("stream_id", F.posexplode(parts).alias("at", "part")).select("stream_id", (F.col("at").cast("long") * size).alias("off"), F.concat("part.own", "part.next").alias("block"))


def find_all(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pid, stream_id, pos) of all, overlapping matches of patterns(pid, pattern); an empty pattern matches nowhere."""
    some = patterns.where("length(pattern) > 0").select(F.col("pid").cast("long").alias("pid"), "pattern")
    size, longest = some.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)), F.coalesce(F.max(F.length("pattern")), F.lit(1))).first()
    if size > MOST_CHARACTERS:
        return find_in_blocks(texts, some, longest)
    pids: dict[str, list[int]] = {}
    for row in some.collect():  # at most MOST_CHARACTERS characters
        pids.setdefault(row["pattern"], []).append(row["pid"])
    return find_by_automaton(texts, pids)


def find_by_automaton(texts: DataFrame, pids: dict[str, list[int]]) -> DataFrame:
    """The same answers for patterns in memory, each with the numbers it goes by."""
    reach(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, machine = list(pids), ahocorasick.Automaton()
        for number, word in enumerate(words):
            machine.add_word(word, number)
        if words:
            machine.make_automaton()
        lengths = np.array([len(w) for w in words], np.int64)
        times = np.array([len(pids[w]) for w in words], np.int64)
        owners, firsts = np.array([i for w in words for i in pids[w]], np.int64), np.cumsum(times) - times
        for batch in batches if words else ():
            for stream, text in zip(batch.column("stream_id"), batch.column("text")):
                found = np.array(list(machine.iter(text.as_py())), np.int64).reshape(-1, 2)
                if not len(found):
                    continue
                pos, word = found[:, 0] - lengths[found[:, 1]] + 1, found[:, 1]
                n = times[word]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch([pa.array(owners[np.repeat(firsts[word], n) + nth]), pa.array([stream.as_py()] * int(n.sum()), pa.int64()), pa.array(np.repeat(pos, n))], ["pid", "stream_id", "pos"])

    return texts.where("text is not null").select(F.col("stream_id").cast("long").alias("stream_id"), "text").mapInArrow(run, "pid long, stream_id long, pos long")


def find_in_blocks(texts: DataFrame, patterns: DataFrame, longest: int, size: int = BLOCK) -> DataFrame:
    """The same answers by a join of blocks of texts with patterns, none longer than ``longest``; a block without a pattern is not scanned for it."""
    held = blocks(texts, longest - 1, size).join(patterns.where("length(pattern) > 0"), F.expr("contains(block, pattern)"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("block") - F.length("pattern") + 1, F.lit(1))), lambda i: (F.substring(F.col("block"), i, F.length("pattern")) == F.col("pattern")) & (i <= size))
    return held.select("pid", "stream_id", "off", F.explode(starts).alias("i")).select("pid", "stream_id", (F.col("off") + F.col("i") - 1).alias("pos"))


def find_by_scan(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same answers by scanning every text for every pattern: the plain form that others are tested against."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text") - F.length("pattern") + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.length("pattern")) == F.col("pattern"))
    return texts.join(patterns.where("length(pattern) > 0"), F.expr("contains(text, pattern)")).select("pid", "stream_id", F.explode(starts).alias("i")).select("pid", "stream_id", (F.col("i") - 1).cast("long").alias("pos"))


def count_apart(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pid, stream_id, n): matches from the left that do not overlap. Only texts that hold a pattern are joined with it."""
    n = ((F.length("text") - F.length(F.replace("text", "pattern"))) / F.length("pattern")).cast("long")
    pairs = find_all(texts, patterns).select("pid", "stream_id").distinct()
    return pairs.join(patterns, "pid").join(texts, "stream_id").select("pid", "stream_id", n.alias("n"))


def ngrams(stream: DataFrame, n: int) -> DataFrame:
    """(stream_id, pos, gram): n tokens from each place on, with a separator between them."""
    order = Window.partitionBy("stream_id").orderBy("pos")
    parts = [F.lead("token", k).over(order).alias(f"t{k}") for k in range(n)]
    return stream.select("stream_id", "pos", *parts).where(F.col(f"t{n - 1}").isNotNull()).select("stream_id", "pos", F.concat_ws(SEPARATOR, *[f"t{k}" for k in range(n)]).alias("gram"))


def pattern_grams(patterns: DataFrame, n: int) -> DataFrame:
    """(pid, k, gram, m) for patterns(pid, tokens); patterns of fewer than n tokens have none."""
    long = patterns.where(F.size("tokens") >= n)
    return long.select("pid", F.size("tokens").alias("m"), "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - n)).alias("k")).select("pid", F.col("k").cast("long").alias("k"), F.array_join(F.slice("tokens", F.col("k") + 1, n), SEPARATOR).alias("gram"), F.col("m").cast("long").alias("m"))


def character_grams(patterns: DataFrame, n: int) -> DataFrame:
    """(pid, k, gram, m) for patterns(pid, pattern) of characters; patterns of fewer than n have none."""
    long = patterns.where(F.length("pattern") >= n)
    placed = long.select("pid", F.length("pattern").cast("long").alias("m"), F.posexplode(F.regexp_extract_all("pattern", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)).alias("k", "gram"))
    return placed.select("pid", F.col("k").cast("long").alias("k"), "gram", "m")


def merged(*matches: DataFrame) -> DataFrame:
    """(pid, stream_id, pos, nth): the distinct matches of several searches, numbered from 0 by place for each pattern and stream."""
    every = reduce(DataFrame.unionByName, [m.select("pid", "stream_id", "pos") for m in matches]).distinct()
    return every.withColumn("nth", (F.row_number().over(Window.partitionBy("pid", "stream_id").orderBy("pos")) - 1).cast("long"))


def stride(grams: DataFrame, n: int) -> DataFrame:
    """Every n-th gram and the last: the fewest that cover a pattern."""
    return grams.where((F.col("k") % n == 0) | (F.col("k") == F.col("m") - n))


def _divide(stream: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(pid, stream_id, pos): starts on which all of a pattern's asked(pid, k, gram) agree."""
    needed = asked.groupBy("pid").agg(F.count("*").alias("needed"))
    met = ngrams(stream, n).join(asked, "gram").groupBy("pid", "stream_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("met"))
    return met.join(needed, "pid").where("met = needed").select("pid", "stream_id", F.col("start").alias("pos"))


def find_tokens(stream: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """(pid, stream_id, pos) of all matches of patterns(pid, tokens); an empty pattern matches nowhere.

    Patterns of up to WHOLE tokens (n, if that is more) meet the stream's grams of their own lengths, so
    that no row is made but matches. Longer ones are divided over grams of that size, of which only the
    stride's are joined, which is enough.
    """
    n = max(n, WHOLE)
    sized = patterns.where(F.size("tokens") > 0).select("pid", "tokens")
    short, long = sized.where(F.size("tokens") <= n), sized.where(F.size("tokens") > n)
    spans, characters, longer = sized.agg(
        F.collect_set(F.when(F.size("tokens") <= n, F.size("tokens"))),
        F.coalesce(F.sum(F.when(F.size("tokens") <= n, F.length(F.array_join("tokens", SEPARATOR)) + 1)), F.lit(0)),
        F.count(F.when(F.size("tokens") > n, 1)),
    ).first()
    order = Window.partitionBy("stream_id").orderBy("pos")
    parts = [F.lead("token", k).over(order).alias(f"t{k}") for k in range(max(spans, default=1))]
    grams = F.array(*[F.when(F.col(f"t{m - 1}").isNotNull(), F.array(*[f"t{k}" for k in range(m)])) for m in sorted(spans or [1])])
    whole = stream.select("stream_id", "pos", *parts).select("stream_id", "pos", F.explode(grams).alias("tokens"))
    found = whole.join(F.broadcast(short) if characters <= MOST_CHARACTERS else short, "tokens").select("pid", "stream_id", "pos")
    return found.unionByName(_divide(stream, stride(pattern_grams(long, n), n), n)) if longer else found


def lengths(stream: DataFrame) -> DataFrame:
    """(stream_id, n): tokens of each stream."""
    return stream.groupBy("stream_id").agg(F.count("*").alias("n"))


def first_kept_exact(n: Column, window: int) -> Column:
    """First start inside the last ``window`` tokens."""
    return F.greatest(n - window, F.lit(0))


def first_kept_block(n: Column, window: int, block: int) -> Column:
    """First start of a window that drops whole blocks: it keeps between window - block + 2 and window + 1 tokens where window is whole blocks."""
    q, r = divmod(window, block)
    last = F.floor((n - 1) / block)
    filled = n - last * block
    return F.when(n <= 0, 0).otherwise(F.greatest(F.when(filled >= r + 2, last - q + 1).otherwise(last - q), F.lit(0)) * block).cast("long")


def last_tokens(stream: DataFrame, kept: Column) -> DataFrame:
    """The tokens that a window keeps, so that a search reads no others; ``kept`` is an expression of the stream's n."""
    ends = Window.partitionBy("stream_id")
    return stream.withColumn("n", F.count("*").over(ends)).where(F.col("pos") >= kept).drop("n")


def in_window(matches: DataFrame, ends: DataFrame, patterns: DataFrame, kept: Column) -> DataFrame:
    """Matches that start in the window and end in the stream; ``kept`` is an expression of the stream's n."""
    sized = patterns.select("pid", F.size("tokens").alias("m"))
    return matches.join(ends, "stream_id").join(sized, "pid").where((F.col("pos") >= kept) & (F.col("pos") + F.col("m") <= F.col("n"))).select("pid", "stream_id", "pos")


def crossing(matches: DataFrame, patterns: DataFrame, block: int) -> DataFrame:
    """Matches that begin in one block and end in another."""
    sized = patterns.select("pid", F.size("tokens").alias("m"))
    return matches.join(sized, "pid").where(F.floor(F.col("pos") / block) < F.floor((F.col("pos") + F.col("m") - 1) / block)).select("pid", "stream_id", "pos")
