"""Token counts without token ids.

Every text falls into pre-tokens; a text is the table of its distinct pre-tokens and how
often each occurs. Pieces are counted once for each distinct pre-token of the whole table,
giving (pre-token, pieces); joining both on the pre-token and summing frequency times
pieces counts the text. No ids are made for texts.

The frequencies are kept for some documents at a time, pre-tokens as numbers of a list of
the distinct ones among them. Only these lists are shuffled to meet the pieces, and the
pieces come back as one list for each, so the shuffle holds a word once for up to
``DOCUMENTS_AT_ONCE`` documents however often they use it.

Special strings inside a text are one token each, as the library has it by default.
Null counts as empty: no bytes, no tokens. A null doc_id stays null. Repeated rows give
repeated rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep, reach

#: Documents, and distinct pre-tokens in documents, that are packed into a row together.
DOCUMENTS_AT_ONCE, COUNTED_AT_ONCE = 50_000, 1 << 21
#: Bits of a row's number in its task, and of a pre-token's number in its row.
ROW_BITS, CODE_BITS = 12, 28


def read_vocabulary(path: str) -> str:
    """The tokenizer's file as text; it must split by the byte-level pattern and know no other normalisation."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    parts = json.loads(text)
    split = parts["pre_tokenizer"] or {}
    if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or parts["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
        raise ValueError("not a plain byte-level tokenizer")
    return text


class Splitter:
    """Pre-tokens of a text, and the special strings between them."""

    def __init__(self, vocabulary: str, pattern: str):
        special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(pattern).findall

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of a text with their frequencies, and how many special strings stand between them."""
        if self.special is None or not self.special.search(text):
            return Counter(self.split(text)), 0
        parts = self.special.split(text)
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.split(part))
        return counts, len(parts) - 1


def _frequencies(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row for some documents at once: their frequencies as numbers of the row's own list of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary, pattern)
        codes: dict[str, int] = {}
        rows: list[list] = [[] for _ in range(4)]
        which, times = array("I"), array("I")
        number = 0

        def packed() -> pa.RecordBatch:
            part = pa.array([TaskContext.get().partitionId() << ROW_BITS | number], pa.int64())
            lists = [pa.array([x], pa.list_(t)) for x, t in zip((*rows, list(codes)), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))]
            # sorted within each document, so that differences are small
            sizes = np.array(rows[3])
            key = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | np.frombuffer(which, np.uint32)
            order = np.argsort(key)
            code = (key[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            steps = np.diff(code, prepend=0)
            firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[firsts] = code[firsts]
            blobs = [pa.array([x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()) for x in (steps, np.frombuffer(times, np.uint32)[order])]
            return pa.record_batch([part, *lists, *blobs], ["part", "doc_ids", "n_bytes", "specials", "distinct", "words", "which", "times"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                counts, specials = splitter.frequencies(text)
                if rows[0] and (len(rows[0]) >= DOCUMENTS_AT_ONCE or len(which) + len(counts) > COUNTED_AT_ONCE):
                    yield packed()
                    codes, rows, which, times, number = {}, [[] for _ in range(4)], array("I"), array("I"), number + 1
                for column, value in zip(rows, (doc, len(text.encode()), specials, len(counts))):
                    column.append(value)
                for word, n in counts.items():
                    which.append(codes.setdefault(word, len(codes)))
                    times.append(n)
        if rows[0]:
            yield packed()

    return docs.mapInArrow(run, "part long, doc_ids array<long>, n_bytes array<long>, specials array<int>, distinct array<int>, words array<string>, which binary, times binary")


def _pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """(part, coded) for words(ref, word): each distinct pre-token goes to one task, which tokenizes it once.

    ref: a row's part and the word's number in it; coded: that number, and the pieces in the lower 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        last, before = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("word"))
            distinct, ends = runs.values.to_pylist(), np.asarray(runs.run_ends)
            known = 1 if distinct and distinct[0] == last else 0
            pieces = [before] * known + [len(c) for c in tokenizer.encode_batch_fast(distinct[known:], add_special_tokens=False)]
            if distinct:
                last, before = distinct[-1], pieces[-1]
            ref = batch.column("ref").to_numpy()
            coded = (ref & (1 << CODE_BITS) - 1) << 32 | np.repeat(np.array(pieces, np.int64), np.diff(ends, prepend=0))
            yield pa.record_batch([pa.array(ref >> CODE_BITS), pa.array(coded)], ["part", "coded"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "part long, coded long")


def _sums(rows: DataFrame, limit: int) -> DataFrame:
    """Sums of frequency times pieces for each document of rows that know their words' pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, specials, distinct, known = (batch.column(c)[k].values for c in ("doc_ids", "n_bytes", "specials", "distinct", "known"))
                pieces = np.zeros(len(known), np.int64)
                if len(known):
                    coded = known.to_numpy()
                    pieces[coded >> 32] = coded & 0xFFFFFFFF
                steps, times = (np.ascontiguousarray(np.frombuffer(batch.column(c)[k].as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for c in ("which", "times"))
                number = distinct.to_numpy()
                ends, summed = np.cumsum(number), np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                which = summed[1:] - np.repeat(summed[ends - number], number)
                total = np.concatenate([[0], np.cumsum(pieces[which] * times)])
                counts = total[ends] - total[ends - number] + specials.to_numpy()
                yield pa.record_batch([ids, sizes, pa.array(counts, pa.int64()), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    reach(docs.sparkSession)
    vocabulary = read_vocabulary(vocabulary_path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(_frequencies(docs, vocabulary, pattern))
    # a word stands once in a row of documents at most, so no word has a large share of these rows
    words = rows.select("part", F.posexplode("words").alias("code", "word")).select(F.shiftleft("part", CODE_BITS).bitwiseOR(F.col("code").cast("long")).alias("ref"), "word")
    known = _pieces(words, vocabulary).groupBy("part").agg(F.collect_list("coded").alias("known"))
    full = rows.where(F.size("words") > 0).drop("words").join(known, "part")
    empty = rows.where(F.size("words") == 0).drop("words").withColumn("known", F.array().cast(known.schema["known"].dataType))
    return _sums(full.unionByName(empty), limit)
