"""Language-model scores by masked pseudo-likelihood.

A small network sees the two words before and the two words after a place, not the word
itself, and predicts the word in two steps: one of GROUPS groups, then one of the group's
WORDS most common words or, as one more outcome, the group's other words. The most common
words of the corpus are dealt to the groups by rank, the others by hash. Among a group's
other words each one that the corpus holds more than once has the probability of its own
count; words that occur once share theirs by their bytes' frequencies. The score of a text
is the sum of its words' conditional log-probabilities.

The table of words grows with the corpus. Tasks look up its ``KNOWN`` most common rows;
for all other words scoring writes a row for each text and word, and a join gives it
its log-probability.

Words and bytes are counted over all documents. The network starts from these counts and is
trained in numpy: texts become sequences of word numbers, dealt by their hashes to shards of
about SHARD words; each shard makes gradient steps on the windows of all its texts, each
window in one round of ``ROUNDS``, and the shards' parameters are averaged by weight after
each. Shards and the order in them follow from the texts, and averages are sums of whole
numbers, so that the model does not depend on how the table is split into partitions.

Null and empty texts have no words and a score of 0; their mean is null. Repeated rows are
scored each. A null doc_id stays null. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, flat, span_hashes, words
from ..session import cut, keep, reach

#: Groups of words, and outcomes in a group: its other words, then its common ones.
GROUPS, WORDS = 32, 31
OUTCOMES = WORDS + 1
COMMON = GROUPS * WORDS
#: Number of a place outside the text.
OUTSIDE = GROUPS * OUTCOMES
SIDES = (-2, -1, 1, 2)
HIDDEN = 16
#: Rounds of training; a window's place in its text decides the round that it is trained on in.
ROUNDS = 2
#: Windows of a step: a few steps of FIRST_BATCH, as many of twice that, and so on up to BATCH. The rate is that of the largest.
FIRST_BATCH, EACH, BATCH, RATE = 256, 8, 4096, 1.2
#: Words that one model is trained on before models are averaged.
SHARD = 1 << 21
#: Distinct words counted in a task before they are written out.
COUNTED_AT_ONCE = 300_000
#: Words that tasks look up by themselves; all others are joined.
KNOWN = 1 << 17
#: Parameters that are summed in one place.
BLOCK = 1 << 13


def _keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(1)).astype(np.int64)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat(part.column("text"))
    starts, ends, docs = words(data, offsets)
    return data, starts, ends, docs, span_hashes(data, starts, ends, lower=True)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, times): 64-bit hashes of all words of all texts. Rows of word -256 .. -1 count bytes in words instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        octets = np.zeros(256, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        def out(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(times)], ["word", "times"])

        for part in chunks(batches):
            data, starts, ends, _, hashes = _tokens(part)
            held.append(np.unique(_keys(hashes), return_counts=True))
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            octets += np.bincount(data[np.cumsum(inside[:-1]) > 0], minlength=256)
            if sum(len(k) for k, _ in held) >= COUNTED_AT_ONCE:
                held = [merged()]
                if len(held[0][0]) >= COUNTED_AT_ONCE // 2:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*merged())
        yield out(-1 - np.arange(256), octets)

    return docs.mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


class Corpus:
    """Numbers of words, log-probabilities of bytes, and those of the most common words among their group's others."""

    def __init__(self, common: np.ndarray, octets: np.ndarray, known: np.ndarray, inside: np.ndarray):
        p = (octets + 1.0) / (octets.sum() + 256.0)
        self.octet = np.log(p)
        # one table for both: common words by their outcome, known ones as others of their group
        every = np.concatenate([common, known])
        rank = np.arange(len(common))
        numbers = np.concatenate([rank % GROUPS * OUTCOMES + 1 + rank // GROUPS, known % GROUPS * OUTCOMES])
        order = np.argsort(every)
        self.words, self.number, self.logs = every[order], numbers[order], np.concatenate([np.zeros(len(common)), inside])[order]

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """group * OUTCOMES + outcome of each word, its log-probability among its outcome's words, and where that has to be joined."""
        other = key % GROUPS * OUTCOMES
        if not len(self.words):
            return other, np.zeros(len(key)), np.ones(len(key), bool)
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        found = self.words[at] == key
        return np.where(found, self.number[at], other), np.where(found, self.logs[at], 0.0), ~found

    def spelled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each word by its bytes, among the words of a group."""
        sums = np.concatenate([[0.0], np.cumsum(self.octet[data])])
        return sums[ends] - sums[starts] + np.log(GROUPS)


_SHAPES = {"side": (len(SIDES), OUTSIDE + 1, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_prior": (GROUPS,), "word": (GROUPS, HIDDEN, OUTCOMES), "word_prior": (GROUPS, OUTCOMES)}


def first_parameters(times: np.ndarray) -> np.ndarray:
    """Parameters under which every outcome has the share of its times (GROUPS * OUTCOMES numbers) whatever the neighbours."""
    rng = np.random.default_rng(5)
    logs = np.log(times.reshape(GROUPS, OUTCOMES) + 0.5)
    totals = np.log(np.exp(logs).sum(1))
    own = {"group_prior": totals - totals.max(), "word_prior": logs - totals[:, None], "bias": np.zeros(HIDDEN)}
    return np.concatenate([np.ravel(own[k] if k in own else rng.normal(0, 0.1, shape)) for k, shape in _SHAPES.items()]).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column; outcomes stand in rows, which sums over them read as whole lines."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


class Network:
    """A word's number from its neighbours' numbers."""

    def __init__(self, parameters: np.ndarray):
        self.all = parameters.astype(np.float32).copy()
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.all[at : at + size].reshape(shape))
            at += size
        # no exponent can reach this bound; where it is small the greatest need not be found first
        bound = max(float(np.abs(self.group).sum(0).max() + np.abs(self.group_prior).max()), float((np.abs(self.word).sum(1) + np.abs(self.word_prior)).max()))
        self.small = bound < 80
        #: Squared gradients so far, which slow the steps of often moved parameters.
        self.moved = np.full((len(SIDES), OUTSIDE + 1, 1), 1e-6, np.float32)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        z = self.side[0][context[0]]
        for k in range(1, len(SIDES)):
            z += self.side[k][context[k]]
        z += self.bias
        return np.tanh(z, out=z)

    def _by_group(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group = (number // OUTCOMES).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group = group[order]
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        return order, firsts, np.append(firsts[1:], len(group)), group[firsts]

    def _logs(self, z: np.ndarray, picked: np.ndarray) -> np.ndarray:
        if not self.small:
            z -= z.max(0)
        own = z[picked, np.arange(z.shape[1])]
        return own - np.log(np.exp(z, out=z).sum(0))

    def log_probabilities(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        order, firsts, ends, groups = self._by_group(number)
        h = np.ascontiguousarray(self.hidden(context[:, order]).T)
        number = number[order]
        outcome = number % OUTCOMES
        logs = self._logs(self.group.T @ h + self.group_prior[:, None], number // OUTCOMES)
        for a, b, g in zip(firsts.tolist(), ends.tolist(), groups.tolist()):
            logs[a:b] += self._logs(self.word[g].T @ h[:, a:b] + self.word_prior[g][:, None], outcome[a:b])
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def step(self, context: np.ndarray, number: np.ndarray, rate: float) -> None:
        n = len(number)
        order, firsts, ends, groups = self._by_group(number)
        context, number = context[:, order], number[order]
        h = np.ascontiguousarray(self.hidden(context).T)
        p = _softmax(self.group.T @ h + self.group_prior[:, None])
        p[number // OUTCOMES, np.arange(n)] -= 1
        back = self.group @ p
        outcome = number % OUTCOMES
        for a, b, g in zip(firsts.tolist(), ends.tolist(), groups.tolist()):
            q = _softmax(self.word[g].T @ h[:, a:b] + self.word_prior[g][:, None])
            q[outcome[a:b], np.arange(b - a)] -= 1
            back[:, a:b] += self.word[g] @ q
            # a group's own steps go by its own windows
            q *= rate / (b - a) ** 0.5 / n**0.5
            self.word[g] -= h[:, a:b] @ q.T
            self.word_prior[g] -= q.sum(1)
        back *= 1 - h * h
        self.group -= h @ p.T * (rate / n)
        self.group_prior -= p.sum(1) * (rate / n)
        self.bias -= back.sum(1) * (rate / n)
        back = np.ascontiguousarray(back.T)
        for k in range(len(SIDES)):
            by = np.argsort(context[k], kind="stable")
            places = context[k][by]
            starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            sums = np.add.reduceat(back[by], starts, axis=0)
            rows = places[starts]
            self.moved[k][rows] += (sums * sums).mean(1, keepdims=True)
            self.side[k][rows] -= rate * sums / np.sqrt(self.moved[k][rows])


def contexts(number: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Numbers of the neighbours of each place, by side; outside the text a number of its own."""
    out = np.full((len(SIDES), len(number)), OUTSIDE, np.uint16)  # numbers of 16 bits are sorted by digits
    number = number.astype(np.uint16)
    for k, side in enumerate(SIDES):
        a, b = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
        if abs(side) < len(number):
            out[k][a] = np.where(docs[a] == docs[b], number[b], OUTSIDE)
    return out


def windows(docs: np.ndarray, turn: int) -> np.ndarray:
    """Places whose windows a round trains on."""
    return np.flatnonzero((np.arange(len(docs)) - np.searchsorted(docs, docs)) % ROUNDS == turn)


def sequences(docs: DataFrame, corpus: Corpus, shards: int) -> DataFrame:
    """(shard, key, numbers): each text of docs(text, key) with a word as its words' numbers, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, _, _, where, hashes = _tokens(part)
            number = corpus.look_up(_keys(hashes))[0].astype("<u2")
            edges = np.searchsorted(where, np.arange(part.num_rows + 1))
            some = np.flatnonzero(np.diff(edges))
            key = part.column("key").to_numpy()[some]
            yield pa.record_batch([pa.array(key % shards), pa.array(key), pa.array([number[a:b].tobytes() for a, b in zip(edges[some], edges[some + 1])], pa.binary())], ["shard", "key", "numbers"])

    return docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(run, "shard long, key long, numbers binary")


def _learn(network: Network, batches: Iterator[list[np.ndarray]], turn: int, rate: float) -> int:
    """Steps on the windows of all sequences, in their order; returns how many windows."""
    seen, steps, held, waiting = 0, 0, [], 0
    for texts in batches:
        number, where = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = windows(where, turn)
        held.append((contexts(number, where)[:, at], number[at]))
        waiting += len(at)
        if waiting >= (size := min(BATCH, FIRST_BATCH << steps // EACH)):
            context, target = np.concatenate([c for c, _ in held], axis=1), np.concatenate([k for _, k in held])
            a = 0
            while a + size <= len(target):
                network.step(context[:, a : a + size], target[a : a + size], rate * (size / BATCH) ** 0.5)
                a, steps = a + size, steps + 1
                size = min(BATCH, FIRST_BATCH << steps // EACH)
            seen += a
            held, waiting = [(context[:, a:], target[a:])], len(target) - a
    for context, target in held:
        if len(target):
            network.step(context, target, rate * (len(target) / BATCH) ** 0.5)
            seen += len(target)
    return seen


def train(texts: DataFrame, first: np.ndarray, total: int) -> np.ndarray:
    """Parameters after ROUNDS rounds of steps in the shards of texts(shard, key, numbers) and averaging."""
    parameters = first
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sums of whole numbers are the same in any order; their scale leaves room for all words
    scale = float(1 << min(20, 55 - int(total).bit_length()))
    for turn in range(ROUNDS):
        start, rate = parameters, RATE / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, weight = np.zeros(len(start), np.int64), 0
            for texts in _shards(batches):
                network = Network(start)
                seen = _learn(network, texts, turn, rate)
                sums += np.rint(network.all.astype(np.float64) * scale * seen).astype(np.int64)
                weight += seen
            if weight:
                blocks = range(0, len(sums), BLOCK)
                yield pa.record_batch([pa.array(range(len(blocks)), pa.int64()), pa.array([sums[a : a + BLOCK].tobytes() for a in blocks], pa.binary()), pa.array([weight] * len(blocks), pa.int64())], ["block", "sums", "weight"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[np.ndarray, int]] = {}
            for batch in batches:
                for block, sums, weight in zip(*(batch.column(c).to_pylist() for c in ("block", "sums", "weight"))):
                    have, before = found.get(block, (0, 0))
                    found[block] = have + np.frombuffer(sums, np.int64), before + weight
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x, _ in found.values()], pa.binary()), pa.array([w for _, w in found.values()], pa.int64())], ["block", "sums", "weight"])

        schema = "block long, sums binary, weight long"
        learnt = texts.repartition(partitions, "shard").sortWithinPartitions("shard", "key", "numbers").mapInArrow(run, schema)
        rows = sorted(learnt.repartition("block").mapInArrow(add, schema).collect())  # a row for each BLOCK parameters
        if rows:
            parameters = (np.concatenate([np.frombuffer(r["sums"], np.int64) / r["weight"] for r in rows]) / scale).astype(np.float32)
    return parameters


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[list[np.ndarray]]]:
    """Of each shard in turn its sequences, some at a time; rows come sorted by shard."""
    pending: list[tuple[int, list[np.ndarray]]] = []

    def pieces() -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            texts = [np.frombuffer(x, "<u2") for x in batch.column("numbers").to_pylist()]
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                for at in range(a, b, 64):
                    yield int(shard[a]), texts[at : min(at + 64, b)]

    source = pieces()

    def own(first: tuple[int, list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        yield first[1]
        for shard, texts in source:
            if shard != first[0]:
                pending.append((shard, texts))
                return
            yield texts

    for begun in source:
        pending.append(begun)
        while pending:
            yield own(pending.pop())


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for each row of docs."""
    reach(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.select("text")
    counts = cut(count_words(texts))
    rare = counts.where("word >= 0")
    # only words of the least frequency class that is needed, and above, are sorted
    level = F.floor(F.log2("times") * 16)
    reach_, least = 0, 0
    for r in sorted(rare.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        reach_, least = reach_ + r["n"], r["level"]
        if reach_ >= COMMON + KNOWN:
            break
    top = rare.where(level >= least).orderBy(F.desc("times"), "word").limit(COMMON + KNOWN).collect()
    octets = np.zeros(256)
    for r in counts.where("word < 0").collect():
        octets[-1 - r["word"]] = r["times"]
    common, known = top[:COMMON], [r for r in top[COMMON:] if r["times"] > 1]
    # other words of each group, and those of them that occur once
    size, once = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in rare.groupBy(F.expr(f"word % {GROUPS}").alias("group")).agg(F.sum("times").alias("n"), F.sum((F.col("times") == 1).cast("long")).alias("once")).collect():
        size[r["group"]], once[r["group"]] = r["n"], r["once"]
    total, times = int(size.sum()), np.zeros((GROUPS, OUTCOMES))
    for rank, r in enumerate(common):
        size[r["word"] % GROUPS] -= r["times"]
        once[r["word"] % GROUPS] -= r["times"] == 1
        times[rank % GROUPS, 1 + rank // GROUPS] = r["times"]
    times[:, 0] = size
    size, once = np.log(np.maximum(size, 1)), np.log(np.maximum(once, 1))
    keys, often = np.array([r["word"] for r in known], np.int64), np.array([r["times"] for r in known], float)
    corpus = Corpus(np.array([r["word"] for r in common], np.int64), octets, keys, np.log(often) - size[keys % GROUPS])
    shards = 1 << max(0, (total // SHARD).bit_length())
    parameters = train(keep(sequences(texts, corpus, shards)), first_parameters(times), total)
    names = ["row", "word", "times", "value", "doc_id", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, row = Network(parameters), TaskContext.get().partitionId() << 40
        for part in chunks(batches):
            data, starts, ends, where, hashes = _tokens(part)
            key = _keys(hashes)
            number, logs, joined = corpus.look_up(key)
            context = contexts(number, where)
            for a in range(0, len(number), 16384):
                logs[a : a + 16384] += network.log_probabilities(context[:, a : a + 16384], number[a : a + 16384])
            own, n = row + np.arange(part.num_rows), np.bincount(where, minlength=part.num_rows)
            # a text's own row has a word below 0 to itself, so that the join spreads these rows
            sums = np.bincount(where, logs, minlength=part.num_rows).astype(np.float64)
            yield pa.record_batch([pa.array(own), pa.array(-1 - own), pa.array(np.zeros(len(own), np.int64)), pa.array(sums), part.column("doc_id"), pa.array(n, pa.int64())], names)
            at = np.flatnonzero(joined)
            if len(at):
                at = at[np.lexsort((key[at], where[at]))]
                first = np.flatnonzero(np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (where[at[1:]] != where[at[:-1]])]))
                repeats = np.diff(np.append(first, len(at)))
                at = at[first]
                value = np.where(repeats == 1, corpus.spelled(data, starts, ends)[at].astype(np.float32), 0).astype(np.float64)
                none = pa.nulls(len(at), pa.int64())
                yield pa.record_batch([pa.array(row + where[at]), pa.array(key[at]), pa.array(repeats), pa.array(value), none, none], names)
            row += part.num_rows

    found = docs.mapInArrow(run, "row long, word long, times long, value double, doc_id long, n_words long")
    of = lambda logs: F.element_at(F.array(*[F.lit(float(v)) for v in logs]), F.expr(f"int(pmod(word, {GROUPS})) + 1"))
    priced = rare.select("word", (F.col("times") == 1).alias("once"), (F.when(F.col("times") == 1, of(once)).otherwise(F.log("times")) - of(size)).alias("inside"))
    share = F.when(F.col("word") < 0, F.col("value")).otherwise(F.col("times") * F.col("inside") + F.when(F.col("once"), F.col("value")).otherwise(0.0))
    summed = found.join(priced, "word", "left").select("row", "doc_id", "n_words", share.alias("share")).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("share").alias("total"))
    return summed.select("doc_id", "n_words", F.round("total", 4).alias("log_likelihood"), F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 6)).alias("mean_log_likelihood"))
