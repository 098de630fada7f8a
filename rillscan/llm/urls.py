"""URL filters: host and path rules first, a ratio of character language models for the rest.

Two variable-order Markov models over characters, smoothed by Witten-Bell
interpolation down to a uniform base (1 / ALPHABET for any character: a constant that takes
part in both models alike, not a distribution over all of Unicode), are trained on URLs that some rule allows and on
URLs that some rule blocks. A URL that no rule fits is allowed when the difference of
its log-likelihoods, divided by its length, reaches a threshold that is calibrated on
held-out labelled URLs.

The models are the counts of all distinct URLs that a rule fits, but for the fifth of them (by hash)
that is held out; the threshold is the best of all held-out ones. URLs are counted and cuts are compared
where the rows are. The driver and each task hold the counts of the distinct strings of ORDER + 1
characters, whose number grows with the variety of URLs. Every row is judged.

A null url, or one without ``://``, has an empty host and path, no rule, and the
verdict of an empty text: a difference of 0 against the threshold. Equal URLs get equal
verdicts; repeated rows are judged each. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, reach

#: (host and path, verdict); the longest rule that fits wins.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: One URL of so many is held out.
HELD = 5
ORDER = 4
ALPHABET = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lower-cased, path, and all that follows ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)\A.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path, rest


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def count_grams(texts: Iterable[str], order: int = ORDER) -> Counter:
    """How often each character follows each context of ``order`` characters, as strings of both; all that a model needs."""
    counts: Counter = Counter()
    for text in texts:
        padded = "\x02" * order + text + "\x03"
        counts.update(padded[i - order : i + 1] for i in range(order, len(padded)))
    return counts


class MarkovModel:
    """Character counts by context of every length up to an order, of texts or of what ``count_grams`` found in them."""

    def __init__(self, texts: list[str] | dict[str, int], order: int = ORDER):
        self.order = order
        self.next: Counter = Counter()
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in (texts if isinstance(texts, dict) else count_grams(texts, order)).items():
            for k in range(order + 1):
                self.next[gram[order - k : order], gram[order]] += n
        for (context, _), n in self.next.items():
            self.total[context] += n
            self.kinds[context] += 1

    def probability(self, context: str, character: str) -> float:
        p = 1.0 / ALPHABET
        for k in range(self.order + 1):
            at = context[self.order - k :]
            if kinds := self.kinds.get(at):
                p = (self.next.get((at, character), 0) + kinds * p) / (self.total[at] + kinds)
        return p


class Judge:
    """Length-normalised log-likelihood difference of a text: above 0 looks accepted."""

    def __init__(self, accepted: list[str] | dict[str, int], rejected: list[str] | dict[str, int], order: int = ORDER):
        self.accepted, self.rejected, self.order = MarkovModel(accepted, order), MarkovModel(rejected, order), order
        self.usable = bool(accepted and rejected)
        self.seen: dict[tuple[str, str], float] = {}

    def score(self, text: str) -> float:
        if not self.usable or not text:
            return 0.0
        if len(self.seen) > 500_000:
            self.seen.clear()
        total, padded, n = 0.0, "\x02" * self.order + text + "\x03", self.order
        for i in range(n, len(padded)):
            key = (padded[i - n : i], padded[i])
            if (ratio := self.seen.get(key)) is None:
                ratio = self.seen[key] = math.log(self.accepted.probability(*key)) - math.log(self.rejected.probability(*key))
            total += ratio
        return total / (len(text) + 1)


def calibrate(scores: list[tuple[float, bool]]) -> float:
    """The threshold of the best balanced accuracy over held-out (score, accepted) pairs, the nearest to 0 among equals."""
    good, bad = [s for s, a in scores if a], [s for s, a in scores if not a]
    if not good or not bad:
        return 0.0
    values = sorted({s for s, _ in scores})
    cuts = [0.0, *((a + b) / 2 for a, b in zip(values, values[1:]))]
    counts = sorted((s, a) for s, a in scores)

    best, at, passed_good, passed_bad = [], 0, len(good), len(bad)
    for cut in sorted(cuts):
        while at < len(counts) and counts[at][0] < cut:
            passed_good -= counts[at][1]
            passed_bad -= not counts[at][1]
            at += 1
        best.append((passed_good / len(good) + 1 - passed_bad / len(bad), -abs(cut), cut))
    return max(best)[2]


def threshold_of(scores: DataFrame) -> float:
    """What ``calibrate`` finds for scores(score, good, bad), the numbers of accepted and rejected at each distinct score, without all of them in one place."""
    ranged = keep(scores.repartitionByRange("score").select("score", "good", "bad", F.spark_partition_id().alias("part")))
    sums = ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last"), F.sum(F.when(F.col("score") < 0, F.col("good"))).alias("good0"), F.sum(F.when(F.col("score") < 0, F.col("bad"))).alias("bad0"))
    parts = sums.orderBy("part").collect()  # a row for each partition
    good, bad = sum(r.good for r in parts), sum(r.bad for r in parts)
    if not good or not bad:
        return 0.0
    before, below_good, below_bad, offsets = None, 0, 0, []
    for r in parts:
        offsets.append((r.part, below_good, below_bad, before))
        below_good, below_bad, before = below_good + r.good, below_bad + r.bad, r.last
    told = F.broadcast(ranged.sparkSession.createDataFrame(offsets, "part int, below_good long, below_bad long, before double"))
    order = Window.partitionBy("part").orderBy("score")
    under = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("part", "score", *[F.coalesce(F.sum(c).over(under), F.lit(0)).alias(c) for c in ("good", "bad")], F.lag("score").over(order).alias("last")).join(told, "part")
    last = F.coalesce("last", "before")
    middle = (last + F.col("score")) / 2
    # neighbours without a number between them are cut at the upper one
    cuts = placed.where(last.isNotNull()).select(F.when(middle > last, middle).otherwise(F.col("score")).alias("cut"), (F.col("below_good") + F.col("good")).alias("good"), (F.col("below_bad") + F.col("bad")).alias("bad"))
    zero = ranged.sparkSession.createDataFrame([(0.0, sum(r.good0 or 0 for r in parts), sum(r.bad0 or 0 for r in parts))], "cut double, good long, bad long")
    worth = (F.lit(good) - F.col("good")) / F.lit(good) + 1 - (F.lit(bad) - F.col("bad")) / F.lit(bad)
    return cuts.unionByName(zero).agg(F.max(F.struct(worth.alias("worth"), (-F.abs("cut")).alias("near"), "cut")).alias("best")).first().best.cut


def _judge_of(sent: Broadcast) -> Judge:
    """The judge of broadcast counts; a worker makes it once."""
    if _JUDGES.get("of") != sent.value["name"]:
        _JUDGES.clear()
        grams, allow, block = (sent.value["counts"].column(c).to_pylist() for c in ("gram", "allow", "block"))
        _JUDGES.update(of=sent.value["name"], judge=Judge(*({g: n for g, n in zip(grams, counts) if n} for counts in (allow, block))))
    return _JUDGES["judge"]


_JUDGES: dict = {}


def learn(known: DataFrame) -> tuple[Broadcast, float]:
    """Counts and threshold from all of known(text, says), distinct."""
    known = keep(known)
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {"allow": Counter(), "block": Counter()}
        for batch in batches:
            for kind, counts in found.items():
                counts.update(count_grams(batch.filter(pc.equal(batch.column("says"), kind)).column("text").to_pylist()))
        for kind, counts in found.items():
            yield pa.record_batch([pa.array([kind] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["says", "gram", "n"])

    counted = known.where(~held).mapInArrow(count, "says string, gram string, n long")
    times = [F.coalesce(F.sum(F.when(F.col("says") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in ("allow", "block")]
    sent = known.sparkSession.sparkContext.broadcast({"name": uuid.uuid4().hex, "counts": counted.groupBy("gram").agg(*times).toArrow()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _judge_of(sent)
        for batch in batches:
            yield pa.record_batch([pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("says")], ["score", "says"])

    # -0.0 and 0.0 are one score
    scored = known.where(held).mapInArrow(score, "score double, says string").select((F.col("score") + 0.0).alias("score"), "says")
    return sent, threshold_of(scored.groupBy("score").agg(*[F.count(F.when(F.col("says") == kind, 1)).alias(name) for kind, name in (("allow", "good"), ("block", "bad"))]))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row; score is null where a rule decides."""
    reach(pages.sparkSession)
    host, path, rest = split_url(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", F.regexp_replace("rest", r"(?s)\A[^/?#]*", "").alias("tail"), rule.alias("rule"), says.alias("says"))
    text = F.concat("host", "tail")

    sent, threshold = learn(ruled.where(F.col("says").isNotNull()).select(text.alias("text"), "says").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _judge_of(sent)
        for batch in batches:
            scores = [None if says.is_valid else model.score(t.as_py()) for t, says in zip(batch.column("text"), batch.column("says"))]
            verdicts = [says.as_py() if says.is_valid else "allow" if score >= threshold else "block" for says, score in zip(batch.column("says"), scores)]
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return ruled.select("page_id", "host", "path", "rule", "says", text.alias("text")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
