"""Document quality by weak supervision.

Each rule votes good or bad on a text, or abstains. No rule decides alone:
expectation-maximisation over all documents' vote patterns estimates how often each
rule votes which way on good and on bad texts, and a text is kept when its posterior
probability of being good reaches a threshold.

What reaches the driver is the number of documents for each vote pattern, at most
3 ** rules rows however many documents there are; the posteriors go back as a table
of the same bound, which is broadcast.

Null text counts as empty: no words, every count 0, rejected by the base rule. A null
doc_id stays null. Repeated rows are judged each by themselves, an empty table gives no
rows. A posterior that equals the threshold keeps the text. Other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunks, flat, mix, run_hashes, span_hashes, words
from ..session import cut, reach

#: Counts made of each text, all of them whole numbers.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_exclaims", "n_stops"]
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[ord("!")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?")] = True
_FIRST_OF_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _repeated(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more in their text, and which occur there earlier."""
    keys = mix(hashes + docs.astype(np.uint64) * _SPREAD)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a flat batch."""
    n = len(offsets) - 1
    starts, ends, docs = words(data, offsets)

    def per_text(which: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(which) + 1, np.int64)
        np.cumsum(which, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def of(numbers: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(numbers, weights, minlength=n).astype(np.int64)

    characters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_FIRST_OF_CHARACTER[data], out=characters[1:])
    hashes = span_hashes(data, starts, ends)
    _, seen = _repeated(hashes, docs)
    windows = run_hashes(hashes, WINDOW)
    whole = np.flatnonzero(docs[: len(windows)] == docs[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    twice, _ = _repeated(windows[whole], docs[whole])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, whole[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_docs = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1]))
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_docs = line_docs[filled]
    _, again = _repeated(span_hashes(data, line_starts[filled], line_ends[filled]), line_docs)
    return {
        "n_words": of(docs),
        "word_chars": of(docs, characters[ends] - characters[starts]),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": of(line_docs[again]),
        "n_repeat_words": of(docs[covered]),
        "n_lines": of(line_docs),
        "n_distinct_words": of(docs[~seen]),
        "n_upper": per_text(_UPPER[data]),
        "n_letters": per_text(_LETTER[data]),
        "n_exclaims": per_text(_EXCLAIM[data]),
        "n_stops": per_text(_STOP[data]),
    }


def count(docs: DataFrame, into: str, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and the counts as one struct named ``into``."""
    reach(docs.sparkSession)
    text = "text" if "text" in keep else None
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text else [F.col("text").cast("string")]))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(into, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            counts = count_texts(*flat(part.column("text").cast(pa.string())))
            packed = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], COUNTS)
            yield pa.record_batch([*(part.column(c) for c in keep), packed], [*keep, into])

    return source.mapInArrow(run, schema)


def _three_way(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes(at: str) -> list[Column]:
    """The rules' votes on the counts in struct ``at``: 0 bad, 1 good, 2 abstains."""
    c = {name: F.col(f"`{at}`.{name}").cast("double") for name in COUNTS}
    some = F.greatest(c["n_words"], F.lit(1.0))
    mean = c["word_chars"] / some
    long = c["n_words"] >= 40
    upper = c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0))
    return [
        _three_way(c["n_words"] < 20, c["n_words"] >= 20),
        _three_way((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 9)),
        _three_way(c["n_symbols"] > 0.1 * some, c["n_symbols"] <= 0.01 * some),
        _three_way((c["n_dup_lines"] > 0.5 * c["n_lines"]) & (c["n_lines"] >= 6), (c["n_dup_lines"] == 0) & (c["n_lines"] >= 2)),
        _three_way(c["n_repeat_words"] > 0.2 * some, long & (c["n_repeat_words"] <= 0.02 * some)),
        _three_way((upper > 0.4) & (c["n_letters"] >= 40), upper <= 0.15),
        _three_way(c["n_exclaims"] > 0.1 * some, c["n_exclaims"] <= 0.01 * some),
        _three_way(long & (c["n_stops"] * 100 < some), c["n_stops"] * 40 >= some),
        _three_way((c["n_words"] >= 20) & (c["n_distinct_words"] < 0.3 * some), long & (c["n_distinct_words"] >= 0.35 * some)),
    ]


N_RULES = 9
#: Prior share of good texts that a rule speaks against, and its weight as a share of all texts: the estimates are free, but good texts stay the class that rules seldom speak against.
WRONG, TRUST = 0.002, 0.2


def pattern_of(at: str) -> Column:
    """The votes as one number in base 3, the first rule last."""
    out = F.lit(0)
    for k, vote in enumerate(votes(at)):
        out = out + vote * 3**k
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, trust: float = TRUST) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    A rule that abstains says nothing. Rules are taken to vote independently for each class;
    those on repeats (lines, windows, distinct words) and on size (which among texts that pass
    the base rule never speaks against one) are not quite. A rule's bad votes on good texts
    have a prior of WRONG, worth ``trust`` times the number of texts; all rates are estimated.
    Returns the posterior probability of good for each pattern, the estimated
    probability of a vote by (class, rule, vote) where the rule votes, and the share of
    good texts.
    """
    digits = (patterns[:, None] // 3 ** np.arange(N_RULES)) % 3
    shown = np.eye(3)[digits][:, :, :2]
    # to begin with, a text that some rule speaks against is more likely bad than good
    posterior = np.where((digits == 0).any(1), 0.05, 0.999)
    prior = np.stack([np.ones((N_RULES, 2)), np.tile([WRONG, 1 - WRONG], (N_RULES, 1)) * (trust * counts.sum() + 2)])
    theta, share = np.zeros((2, N_RULES, 2)), 0.5
    for _ in range(rounds):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        theta = np.einsum("cp,prv->crv", weights, shown) + prior
        theta /= theta.sum(2, keepdims=True)
        share = (weights[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("prv,crv->cp", shown, np.log(theta)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, theta, float(share)


def posteriors(counted: DataFrame, at: str) -> DataFrame:
    """(pattern, posterior): a row for each vote pattern that occurs, at most 3 ** rules.

    Texts that fail the base rule are rejected anyway and would teach the model little
    but that rule, so they do not count in the fit.
    """
    passed = F.sum((~base_failed(at)).cast("long"))
    found = counted.groupBy(pattern_of(at).alias("pattern")).agg(passed.alias("passed")).collect()
    found.sort()
    patterns, numbers = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float)
    good = fit(patterns, numbers)[0] if len(found) else np.zeros(0)
    return counted.sparkSession.createDataFrame([(int(p), round(float(q), 9)) for p, q in zip(patterns, good)], "pattern int, posterior double")


def base_failed(at: str) -> Column:
    """Too short, or too much of it repeats."""
    n = F.col(f"`{at}`.n_words")
    return (n < 20) | (100 * F.col(f"`{at}`.n_repeat_words") > 30 * n)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the contract's counts, base_failed, kept, posterior) for each row of docs."""
    counted = cut(count(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "counts", ["doc_id"]))
    known = posteriors(counted, "counts")
    return (
        counted.withColumn("pattern", pattern_of("counts"))
        .join(F.broadcast(known), "pattern")
        .select("doc_id", *[F.col(f"counts.{c}") for c in COUNTS[:5]], base_failed("counts").alias("base_failed"), (~base_failed("counts") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns and no others."""
    at, pattern, chance = free_name(docs, "_counts"), free_name(docs, "_pattern"), free_name(docs, "_posterior")
    known = posteriors(count(docs, at, []), at).toDF(pattern, chance)
    counted = count(docs, at, docs.columns)
    return counted.withColumn(pattern, pattern_of(at)).join(F.broadcast(known), pattern).where(~base_failed(at) & (F.col(chance) >= threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])
