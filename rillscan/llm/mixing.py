"""Mixing documents so that domains get target shares of the tokens.

Domains are classes of a labelled table (here: good, low quality, toxic). A softmax
classifier, fitted on a bounded sample of labelled documents, gives each document a
probability of each domain, so membership is soft. Each document gets a rate, how often
it is used on average. Rates lie between bounds and make the expected tokens of the
domains as near to the targets as can be: projected gradient steps on the least
squares ``(A r - b)' W (A r - b)``, A holding tokens times probability, W the inverse of
the domains' token Gram matrix with a ridge, under which a full step never overshoots.
The ridge bounds the pull of a domain that has next to no tokens: where the bounds on
rates leave its target out of reach, the others don't move away from theirs. A step is
one aggregate of as many sums as there are domains, and a document's rate follows from
its probabilities and the steps, so rates are never stored or collected.

Column expressions and aggregates only. The driver sees the labelled sample
(``SAMPLE`` rows of a few numbers), at most ``LEXICON`` words, and the sums.

Null text counts as empty: no tokens, the probabilities of an empty text, a rate like
any other. Without labelled documents all probabilities are equal. Repeated rows get
rates each; of several texts under one labelled doc_id the classifier learns from the one
of the least hash. A tie of labels goes to the worse. A null doc_id is never labelled. An
empty table gives no rows. Other columns are kept by ``copies``, whatever their names, and
not read by ``rates``. Whole copies meet the targets on average: a coin decides a
document's last copy whatever its size, so few large documents leave more scatter.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

DOMAINS = ["good", "low", "toxic"]
#: Labelled documents that the classifier is fitted on, those of the least hashes.
SAMPLE = 4000
#: Words that speak for a domain.
LEXICON = 24
FEATURES = ["size", "symbols", "uppers", "exclaims", "gaps", "breaks", "telling"]
ROUNDS = 30
#: Ridge of the metric, as a share of the Gram matrix's largest eigenvalue.
RIDGE = 0.01


def unused(taken: list[str], name: str) -> str:
    """A column name like ``name`` that is not taken, in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one row for each labelled document, the worst label where there are several."""
    toxic, quality = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(1))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0).alias("domain")).where("doc_id is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _measured(text: Column, lexicon: list[str]) -> dict[str, Column]:
    """The features; each is a share or a logarithm, so long texts don't stand out."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    each = lambda letter: (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) / n
    any_of = lambda letters: F.regexp_count(text, F.lit(letters)) / n
    if lexicon:
        # looking at the first letter alone spares most places the list of words
        firsts = "".join(sorted({w[0] for w in lexicon}))
        telling = F.regexp_count(text, F.lit(rf"(?i)\b(?=[{firsts}])(?:{'|'.join(lexicon)})\b")).cast("double") / n
    else:
        telling = F.lit(0.0)
    return {"size": F.log1p(n) / 10, "symbols": 5 * any_of(r"[#*$%&|<>]"), "uppers": 2 * any_of("[A-Z]"), "exclaims": 10 * each("!"), "gaps": each(" "), "breaks": 10 * each("\n"), "telling": F.least(100 * telling, F.lit(3.0))}


def _telling_words(sample: DataFrame) -> list[str]:
    """Words that occur in many documents of one domain and in few of the others."""
    words = sample.select("domain", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\p{L}{4,20}\b"), 0))).alias("word"))
    counted = words.groupBy("word").agg(F.sum((F.col("domain") == 2).cast("int")).alias("inside"), F.sum((F.col("domain") != 2).cast("int")).alias("outside"))
    ratio = (F.col("inside") + 0.1) / (F.col("outside") + 1.0)
    return [r.word for r in counted.where("inside >= 3").where(ratio > 2).orderBy(F.desc("inside"), "word").limit(LEXICON).collect()]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 600) -> np.ndarray:
    """Weights (features + 1, domains) of a softmax classifier, by gradient descent with momentum."""
    k = len(DOMAINS)
    w = np.zeros((x.shape[1] + 1, k))
    if not len(x):
        return w
    one = np.hstack([x, np.ones((len(x), 1))])
    target, speed = np.eye(k)[y], np.zeros_like(w)
    for _ in range(steps):
        z = one @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.8 * (one.T @ (p - target) / len(x) + 1e-4 * w)
        w += speed
    return w


def members(docs: DataFrame, labels: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """The columns in ``keep`` and tokens and domain probabilities under ``names`` (1 + domains)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    labelled = cut(one.select("doc_id", "domain", "least.text"))  # at most SAMPLE rows
    lexicon = _telling_words(labelled)
    rows = labelled.select("doc_id", "domain", *[c.alias(n) for n, c in _measured(F.col("text"), lexicon).items()]).orderBy("doc_id").collect()
    w = fit(np.array([[r[f] for f in FEATURES] for r in rows]).reshape(-1, len(FEATURES)), np.array([r.domain for r in rows], int))
    features = unused([*keep, *names], "_features")
    scores = unused([*keep, *names, features], "_scores")
    measured = docs.select(*[F.col(f"`{c}`") for c in keep], _tokens(text).alias(names[0]), F.struct(*[c.alias(n) for n, c in _measured(text, lexicon).items()]).alias(features))
    logits = [reduce(lambda a, b: a + b, [F.col(f"`{features}`.{f}") * float(w[i, k]) for i, f in enumerate(FEATURES)]) + float(w[-1, k]) for k in range(len(DOMAINS))]
    scored = measured.withColumn(scores, F.array(*logits))
    z = F.col(f"`{scores}`")
    top = F.array_max(z)
    total = reduce(lambda a, b: a + b, [F.exp(z[k] - top) for k in range(len(DOMAINS))])
    return scored.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{names[0]}`"), *[(F.exp(z[k] - top) / total).alias(names[1 + k]) for k in range(len(DOMAINS))])


def rate_of(names: list[str], start: float, moves: list[list[float]], low: float, high: float) -> Column:
    """A document's rate after the steps, from its probabilities alone."""
    rate = F.lit(float(start))
    for move in moves:
        change = reduce(lambda a, b: a + b, [F.col(f"`{n}`") * float(v) for n, v in zip(names[1:], move)])
        rate = F.greatest(F.least(rate - change, F.lit(float(high))), F.lit(float(low)))
    return rate


def solve(table: DataFrame, names: list[str], weights: list[float], budget: float, low: float, high: float) -> tuple[float, list[list[float]]]:
    """The first rate and the steps from it. budget: tokens wanted, as a share of all."""
    k = len(DOMAINS)
    t, p = F.col(f"`{names[0]}`"), [F.col(f"`{n}`") for n in names[1:]]
    gram = table.agg(F.sum(t).alias("all"), *[F.sum(t * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(k)]).first()
    tokens = float(gram["all"] or 0)
    start, moves, best = min(max(budget, low), high), [], (np.inf, 0)
    if not tokens:
        return start, moves
    shares = np.array([[gram[f"g{i}{j}"] for j in range(k)] for i in range(k)]) / tokens
    step = np.linalg.inv(shares + RIDGE * np.linalg.eigvalsh(shares).max() * np.eye(k))
    want = np.array(weights) / sum(weights) * budget
    for _ in range(ROUNDS):
        sums = table.agg(*[F.sum(rate_of(names, start, moves, low, high) * t * p[i]).alias(f"s{i}") for i in range(k)]).first()
        miss = np.array([sums[f"s{i}"] for i in range(k)]) / tokens - want
        size = float(np.sqrt(miss @ step @ miss))
        if best[0] - size < 1e-6:
            break
        best = (size, len(moves))
        if size < 1e-5:
            break
        moves = [*moves, [round(float(v), 12) for v in step @ miss]]
    else:
        warnings.warn(f"rates still move after {ROUNDS} rounds; the domains miss their targets by {best[0]:.3g}")
    return start, moves[: best[1]]


def whole(rate: Column, key: Column) -> Column:
    """A whole number of copies whose mean is the rate, decided by the key's hash."""
    return (F.floor(rate) + (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < (rate - F.floor(rate)) * 1_000_000).cast("long")).cast("long")


def rates(docs: DataFrame, labels: DataFrame, weights: list[float], budget: float, low: float = 0.0, high: float = 4.0) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_low, p_toxic, rate, copies) for each row of docs."""
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    table = cut(members(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, ["doc_id"], names))
    start, moves = solve(table, names, weights, budget, low, high)
    out = table.withColumn("rate", F.round(rate_of(names, start, moves, low, high), 6))
    return out.select("doc_id", "n_tokens", *[F.round(n, 6).alias(n) for n in names[1:]], "rate", whole(F.col("rate"), F.col("doc_id")).alias("copies"))


def copies(docs: DataFrame, labels: DataFrame, free: list[str], weights: list[float], budget: float, low: float, high: float) -> DataFrame:
    """Every row of docs as often as its rate says, with its columns; free: five column names that docs has not."""
    names = free[:4]
    table = members(docs, labels, docs.columns, names)
    start, moves = solve(cut(table.select(*[F.col(f"`{n}`") for n in names])), names, weights, budget, low, high)
    number = whole(F.round(rate_of(names, start, moves, low, high), 6), F.col("doc_id"))
    # the partition's number is no fixed function of the row, which keeps filters on the copies from being moved
    # below this projection, where every use of a rate would be written out in full
    barrier = unused([*docs.columns, *free], "_at")
    counted = table.select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(free[4]), F.spark_partition_id().alias(barrier))
    n = F.col(f"`{free[4]}`")
    return counted.withColumn(barrier, F.explode(F.array_repeat(F.col(f"`{barrier}`"), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
