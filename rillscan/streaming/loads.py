"""Structured Streaming forms: micro-batches that are searched, and a query load every so many tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.interfaces import Matcher
from ..session import reach
from ..sources import streams

#: Patterns whose sizes are sent to every task.
MOST_PATTERNS = 1_000_000


def loads_every(events: DataFrame, key: str, order: str, window: int) -> DataFrame:
    """(key, load, n_tokens): a row each time a key has seen another ``window`` tokens.

    events is a streaming DataFrame; the state of a key is one count. Rows of a batch
    are put in order first, as arrival inside a batch has none.
    """

    def count(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(f) for f in frames)
        state.update((after,))
        fired = range(before // window + 1, after // window + 1)
        yield pd.DataFrame({key: [keys[0]] * len(fired), "load": list(fired), "n_tokens": [k * window for k in fired]})

    return events.select(key, order).groupBy(key).applyInPandasWithState(count, f"{key} long, load long, n_tokens long", "n long", "append", GroupStateTimeout.NoTimeout)


def delayed(matches: DataFrame, patterns: DataFrame, delta: int) -> DataFrame:
    """(pid, stream_id, pos, known_at): after how many tokens of its stream an index that buffers knows a match.

    Patterns of up to delta / 4 tokens are looked for as tokens come, longer ones when the buffer is flushed, every delta / 2 tokens.
    """
    end, half = F.col("pos") + F.col("m"), delta // 2
    known = F.when(F.col("m") <= delta // 4, end).otherwise(F.ceil(end / half) * half)
    sized = patterns.select("pid", F.size("tokens").alias("m"))
    # numbers and sizes of this many patterns are sent to the matches, which then stay where they are
    sized = F.broadcast(sized) if sized.count() <= MOST_PATTERNS else sized
    return matches.join(sized, "pid").select("pid", "stream_id", "pos", known.cast("long").alias("known_at"))


def answers_every(events: DataFrame, key: str, order: list[str], token: str, patterns: list[list[str]], window: int) -> DataFrame:
    """(key, load, pid, pos): each time a key has seen another ``window`` tokens, the patterns' matches that have ended since the last time.

    events is a streaming DataFrame. The state of a key is its number of tokens, and the last ones: those
    of the load that is not full yet and what a match may need before it. pid is a pattern's place in the list.
    """
    reach(events.sparkSession)
    keep = max((len(p) for p in patterns), default=1) - 1

    def search(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, tail = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(order)
        tokens = list(tail) + rows[token].tolist()
        first, after = before - len(tail), before + len(rows)
        found = []
        for load in range(before // window + 1, after // window + 1):
            for pid, pattern in enumerate(patterns):
                m = len(pattern)
                for start in range(max((load - 1) * window - m + 1, first), load * window - m + 1):
                    if m and tokens[start - first : start - first + m] == pattern:
                        found.append((keys[0], load, pid, start))
        needed = after % window + keep
        state.update((after, tokens[len(tokens) - min(needed, len(tokens)) :]))
        yield pd.DataFrame(found, columns=[key, "load", "pid", "pos"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, *order, token).groupBy(key).applyInPandasWithState(search, f"{key} {kind}, load long, pid long, pos long", "n long, tail array<string>", "append", GroupStateTimeout.NoTimeout)


def search_batches(stream: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs a search over each micro-batch and appends its matches; answers come as late as the trigger. A batch that is run again replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(docs: DataFrame, patterns: DataFrame, mode: str, matcher: Matcher) -> DataFrame:
    """(pid, stream_id, pos): a stream of ``chars``, ``words`` or ``segments`` of docs against a workload(pid, text) read the same way."""
    readers = {"chars": streams.characters, "words": streams.words, "segments": streams.segments}
    stream = readers[mode](docs)
    asked = readers[mode](patterns.select(F.col("pid").alias("doc_id"), "text"))
    tokens = asked.groupBy(F.col("stream_id").alias("pid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))
    return matcher.report(stream, tokens)
