"""Removal of byte strings that occur more than once, by suffix sorting in buckets.

A string of ``LENGTH`` bytes is removed wherever it also starts anywhere else. The
suffixes of the corpus are dealt into buckets by an anchor: of the 32-byte grams in a
suffix's first LENGTH bytes, the one with the least hash (the leftmost of equals).
Equal strings have equal anchors at equal distances, so they meet in one bucket, and
inside a bucket only suffixes of the same distance from the anchor can be equal.
Neighbouring suffixes of one anchor make a run, and a row stands for a run.

1. Runs of equal content are counted, known by 128-bit hashes and pre-aggregated before
   the shuffle. A run that occurs twice is all repeated; a bucket with one run in all is done.
2. The texts of the other runs, one of each content, go to their buckets. There the
   suffixes are sorted one bucket at a time: the ranks of the suffixes at the positions
   of a difference cover modulo 31 are made first, by doubling; any suffix is then
   compared by at most 12 bytes at either end and three such ranks, however long the
   tie. Anchors lie at multiples of 31, so suffixes at one distance share the cover's
   offset. Memory is bounded by a block of texts.
3. A bucket of more than ``MOST_RUNS`` different runs is dealt into smaller ones: its runs
   are cut into slices of 64 distances, and a slice's bucket is named by the bytes that all
   suffixes of the slice share, too. Slices are runs like any other and go through steps 1
   and 2, if need be cut again into 8 distances and then 1. So hashes settle which contents
   are equal and which cannot be, and sorting decides about all others at every size.

Texts travel only for documents that a fixed-size Bloom filter lets through; it loses
effect, never rows, when it fills up.

Null text counts as empty. Rows may repeat, doc_id included: equal rows are two places
for the same strings. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, flat, mix, powers
from ..session import cut, keep, reach

LENGTH = 400
GRAM = 32
#: Different runs that one bucket may hold in a task.
MOST_RUNS = 4000
#: Bytes of run texts that are sorted together, a larger bucket apart.
BLOCK_BYTES = 1 << 20
#: Bytes of texts whose suffixes are hashed at once, and rows that are counted before they are dealt out.
HASHED_AT_ONCE = 1 << 20
COUNTED_AT_ONCE = 200_000
#: Rows of texts that a worker turns into Python objects at once.
ROWS_AT_ONCE = 128
#: Starting suffixes a text is cut into at most, so that positions fit the packing below.
SEGMENT = 1 << 22
#: A perfect difference cover: any two residues modulo 31 have a common distance to it.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BLOOM_BITS = 1 << 23

_random = np.random.default_rng(99)
_HASHERS = [(_random.integers(0, 2**64, 256, dtype=np.uint64), base, pow(base, -1, 2**64)) for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
#: What a run is: its anchor, two hashes of its bytes, and packed in one number its least and greatest distance to the anchor (9 bits each).
RUN = ["anchor", "content1", "content2", "shape"]
_SPAN = 9
#: Distances of the slices that a bucket of too many runs is cut into, one after the other.
SLICES = (64, 8, 1)
_RUN_TYPES = "anchor long, content1 long, content2 long, shape long"


def _near_far():
    return _near_far_of("")


def _near_far_of(prefix: str):
    return F.expr(f"({prefix}shape >> {_SPAN}) & {(1 << _SPAN) - 1}"), F.expr(f"{prefix}shape & {(1 << _SPAN) - 1}")


class _Hasher:
    """Hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray, which: int):
        table, base, self.inverse = _HASHERS[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(base, len(data)), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(self.inverse, len(self.sums))[starts] + (ends - starts).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * powers(self.inverse, len(self.sums))[: len(self.sums) - n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def find_runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of suffixes with one anchor: text number, first suffix, anchor hash, distances to the anchor, content hashes."""
    if len(data) < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", *RUN)}
    first, second = _Hasher(data, 0), _Hasher(data, 1)
    grams = first.grams(GRAM)
    keys = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (_least(keys, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int64)  # which suffixes have LENGTH bytes in their own text
    long = np.diff(offsets) >= LENGTH
    room[offsets[:-1][long]] += 1
    np.subtract.at(room, offsets[1:][long] - LENGTH + 1, 1)
    inside = np.cumsum(room)[: len(least)] > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(inside & fresh)
    edge = np.ones(len(least), bool)
    edge[:-1] = fresh[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & edge)
    anchors = least[starts]
    text = np.searchsorted(offsets, starts, side="right") - 1
    signed = lambda x: x.view(np.int64)
    shape = (anchors - ends) << _SPAN | (anchors - starts)
    return {"text": text, "start": starts - offsets[text], "anchor": signed(grams[anchors]), "content1": signed(first.spans(starts, ends + LENGTH)), "content2": signed(second.spans(starts, ends + LENGTH)), "shape": shape}


def _segments(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row numbers and places in the row: long texts in overlapping segments, each suffix in one of them."""
    data, offsets = flat(part.column("text"))
    if len(data) <= SEGMENT + LENGTH:
        yield data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, max(b - LENGTH + 1, a + 1), SEGMENT):
            end = min(b, at + SEGMENT + LENGTH - 1)
            yield data[at:end], np.array([0, end - at]), np.array([row]), np.array([at - a])


def runs(docs: DataFrame) -> DataFrame:
    """A row for each run of suffixes: where it lies and what it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=HASHED_AT_ONCE):
            for data, offsets, rows, places in _segments(part):
                found = find_runs(data, offsets)
                row = rows[found["text"]]
                where = pa.array(row, pa.int64())
                yield pa.record_batch([part.column("doc_id").take(where), part.column("key").take(where), pa.array(found["start"] + places[found["text"]], pa.int64()), *(pa.array(found[c], pa.int64()) for c in RUN)], ["doc_id", "key", "start", *RUN])

    return docs.mapInArrow(run, f"doc_id long, key long, start long, {_RUN_TYPES}")


def _cover_offsets() -> np.ndarray:
    """For each residue, how far on the next position of the cover is."""
    return np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows by their columns, the first the most significant."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def repeated_suffixes(texts: list[bytes], groups: np.ndarray, far: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Which suffixes of each run occur in another run of its group.

    texts: the runs; far: the anchor's place in each; counts: suffixes of each run.
    """
    sizes = np.array([len(t) for t in texts])
    bases = np.empty(len(texts), np.int64)
    at = 0
    for k in range(len(texts)):  # anchors at multiples of the period
        at += -(at + int(far[k])) % PERIOD
        bases[k] = at
        at += int(sizes[k])
    text = np.zeros(at + LENGTH + 8 * PERIOD, np.uint8)
    inside = np.repeat(bases - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text[inside] = np.frombuffer(b"".join(texts), np.uint8)

    def eight(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | text[places + k]
        return out

    residues = np.arange(len(text) - 8 * PERIOD) % PERIOD
    sample = np.flatnonzero(np.isin(residues, COVER))
    where = np.zeros(len(text), np.int64)
    rank = {PERIOD: _dense([eight(sample), eight(sample + 8), eight(sample + 16), eight(sample + PERIOD - 8)])}
    where[sample] = np.arange(len(sample))
    for size in (PERIOD, 2 * PERIOD, 4 * PERIOD):
        further = np.minimum(sample + size, sample[-1])
        rank[2 * size] = np.unique(rank[size] * (len(sample) + 1) + np.where(sample + size <= sample[-1], rank[size][where[further]], 0), return_inverse=True)[1]
    on = _cover_offsets()
    back = np.array([min((r - c) % PERIOD for c in COVER) for r in range(PERIOD)])

    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = bases[owner] + nth
    distance = far[owner] - nth
    marked = np.zeros(len(suffix), bool)
    by_distance = np.argsort(distance, kind="stable")
    bounds = np.searchsorted(distance[by_distance], np.arange(distance.min(), distance.max() + 2)) if len(distance) else [0]
    # one suffix bucket at a time: those of equal distance to their anchors share a residue
    for a, b in zip(bounds[:-1], bounds[1:]):
        mine = by_distance[a:b]
        if len(mine) < 2:
            continue
        i = suffix[mine]
        head = int(on[i[0] % PERIOD])
        whole = i + head
        rest = whole + 8 * PERIOD
        last = i + LENGTH - PERIOD
        spare = int(back[last[0] % PERIOD])
        keep = lambda places, n: (eight(places) >> np.uint64(64 - 8 * min(n, 8)) if n else np.zeros(len(places), np.uint64))
        ranks = (rank[8 * PERIOD][where[whole]] << 42) | (rank[4 * PERIOD][where[rest]] << 21) | rank[PERIOD][where[last - spare]]
        columns = [groups[owner[mine]], ranks, keep(i, head), keep(i + 8, head - 8) if head > 8 else None, keep(last - spare + PERIOD, spare), keep(last - spare + PERIOD + 8, spare - 8) if spare > 8 else None]
        columns = [c for c in columns if c is not None]
        order = np.lexsort(columns)
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            s = c[order]
            same &= s[1:] == s[:-1]
        marked[mine[order[1:][same]]] = True
        marked[mine[order[:-1][same]]] = True
    return np.split(marked, np.cumsum(counts)[:-1])


def _stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every stretch of marks."""
    edges = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _sort_buckets(texts: DataFrame) -> DataFrame:
    """(run, first, last): stretches of repeated suffixes of each run of texts(run, content), bucket by bucket."""

    def solve(block: list[tuple]) -> pa.RecordBatch:
        shape = np.array([r[3] for r in block])
        far, near = shape & (1 << _SPAN) - 1, shape >> _SPAN
        _, groups = np.unique(np.array([r[0] for r in block]), return_inverse=True)
        rows: list[list] = [[] for _ in range(len(RUN) + 2)]
        for r, marks in zip(block, repeated_suffixes([r[4] for r in block], groups, far, far - near + 1)):
            for a, b in zip(*_stretches(marks)):
                for column, value in zip(rows, (*r[:4], int(a), int(b))):
                    column.append(value)
        return pa.record_batch([pa.array(c, pa.int64()) for c in rows], [*RUN, "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in [*RUN, "content"])):
                if size >= BLOCK_BYTES and block[-1][0] != r[0]:
                    yield solve(block)
                    block, size = [], 0
                block.append(r)
                size += len(r[4])
        if block:
            yield solve(block)

    return texts.select(*RUN, "content").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"{_RUN_TYPES}, first long, last long")


def _slices(texts: DataFrame, width: int) -> DataFrame:
    """(run, of_.., content): each run cut where its distances pass a multiple of ``width``; of_.. is the run that it was cut from.

    A slice's anchor is a hash of the run's, the slice's number, and the bytes that suffixes at all its distances share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows: list[tuple] = []
            for anchor, content1, content2, shape, content in zip(*(batch.column(c).to_pylist() for c in [*RUN, "content"])):
                near, far = shape >> _SPAN, shape & (1 << _SPAN) - 1
                place = np.arange(near // width, far // width + 1)
                low, high = np.maximum(near, place * width), np.minimum(far, place * width + width - 1)
                data = np.frombuffer(content, np.uint8)
                one, two = _Hasher(data, 0), _Hasher(data, 1)
                core = one.spans(far - place * width, far - place * width - width + 1 + LENGTH)
                name = mix(mix(core + np.uint64(anchor & (1 << 64) - 1)) + place.astype(np.uint64)).view(np.int64)
                starts, ends = far - high, far - low + LENGTH
                hashes = one.spans(starts, ends).view(np.int64), two.spans(starts, ends).view(np.int64)
                for k in range(len(place)):
                    rows.append((int(name[k]), int(hashes[0][k]), int(hashes[1][k]), int(low[k]) << _SPAN | int(high[k]), anchor, content1, content2, shape, content[starts[k] : ends[k]]))
            yield pa.record_batch([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(8)), pa.array([r[8] for r in rows], pa.binary())], [*RUN, *(f"of_{c}" for c in RUN), "content"])

    return texts.select(*RUN, "content").mapInArrow(run, f"{_RUN_TYPES}, of_anchor long, of_content1 long, of_content2 long, of_shape long, content binary")


def _whole(kinds: DataFrame) -> DataFrame:
    near, far = _near_far()
    return kinds.where("times > 1").select(*RUN, F.lit(0).cast("long").alias("first"), (far - near).alias("last"))


def _decide(texts: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(run, first, last) for texts(run, kinds, content), one of each content: small buckets are sorted, larger ones cut into slices first."""
    if not widths:
        return _sort_buckets(texts)
    small = _sort_buckets(texts.where(F.col("kinds") <= MOST_RUNS))
    large = texts.where(F.col("kinds") > MOST_RUNS)
    if not large.take(1):
        return small
    parts = keep(_slices(large, widths[0]))
    kinds = keep(parts.groupBy(*RUN).agg(F.count("*").alias("times"), F.first("content").alias("content")))
    buckets = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = keep(kinds.join(buckets, "anchor").select(*RUN, "kinds", "content"))
    found = _whole(kinds).unionByName(_decide(mixed, widths[1:]))
    shift = _near_far_of("of_")[1] - _near_far()[1]
    back = parts.drop("content").join(found, RUN).select(*[F.col(f"of_{c}").alias(c) for c in RUN], (F.col("first") + shift).alias("first"), (F.col("last") + shift).alias("last"))
    return small.unionByName(back)


class Bloom:
    """A set of documents in a fixed number of bits: never a false no."""

    def __init__(self, documents: DataFrame):
        place = F.pmod(F.xxhash64("doc_id", "key"), F.lit(BLOOM_BITS))
        parts = documents.select(F.expr("0 + 1L").alias("one"), place.alias("place")).groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")).collect()
        self.parts = {r.bucket: bytes(r.bits) for r in parts}

    def of(self, docs: DataFrame, inside: bool) -> DataFrame:
        """The rows of docs that may be in the set, or the others."""
        parts = self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(BLOOM_BITS // 8 + 8192, np.uint8)
            for bucket, part in parts.items():
                bits[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = np.frombuffer(part, np.uint8)
            for batch in _pieces(batches):
                at = batch.column("place").to_numpy()
                has = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array(has == inside)).drop_columns(["place"])

        return docs.withColumn("place", F.pmod(F.xxhash64("doc_id", "key"), F.lit(BLOOM_BITS))).mapInArrow(run, "doc_id long, key long, text string")

    def flag(self, docs: DataFrame, doc_id: str, key: str, name: str, taken: str) -> DataFrame:
        """docs with a boolean column ``name``: whether a row may be in the set. All other columns stay; taken: a further free name."""
        rows = [(bucket, bytearray(part)) for bucket, part in self.parts.items()]
        bits = docs.sparkSession.createDataFrame(rows, f"{taken}_bucket long, {taken}_bits binary")  # BLOOM_BITS in all
        place = f"pmod(xxhash64({doc_id}, {key}), {BLOOM_BITS}L)"
        octet = f"conv(hex(substring({taken}_bits, int({place} % 32768 / 8) + 1, 1)), 16, 10)"
        joined = docs.join(F.broadcast(bits), F.expr(f"bigint({place} / 32768) + 1 = {taken}_bucket"), "left")
        return joined.withColumn(name, F.expr(f"coalesce((shiftright(int({octet}), int({place} % 8)) & 1) = 1, false)")).drop(f"{taken}_bucket", f"{taken}_bits")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one run of each kind that is wanted."""
    asked = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", *RUN, "kinds")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            columns: list[list] = [[] for _ in range(len(RUN) + 2)]
            for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist()):
                data = text.as_py().encode()
                for r in asked:
                    near, far = r["shape"] >> _SPAN, r["shape"] & (1 << _SPAN) - 1
                    content = data[r["start"] : r["start"] + far - near + LENGTH]
                    for column, value in zip(columns, (*(r[c] for c in RUN), r["kinds"], content)):
                        column.append(value)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], [*RUN, "kinds", "content"])

    holders = Bloom(wanted).of(docs, True).dropDuplicates(["doc_id", "key"])
    return holders.join(asked, (holders.doc_id.eqNullSafe(asked.doc_id)) & (holders.key == asked.key)).select("text", "asked").mapInArrow(run, f"{_RUN_TYPES}, kinds long, content binary")


def _digest(docs: DataFrame) -> DataFrame:
    """What is left of each text, given the byte ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sizes, removed, spans, hashes = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                data = text.as_py().encode()
                kept, gone, at, count = [], 0, 0, 0
                reach = -1
                for r in sorted(ranges or [], key=lambda r: (r["a"], r["b"])):
                    if r["a"] > reach:
                        count += 1
                        kept.append(data[max(reach, 0) : r["a"]])
                        gone += r["b"] - r["a"]
                        reach = r["b"]
                    elif r["b"] > reach:
                        gone += r["b"] - reach
                        reach = r["b"]
                kept.append(data[max(reach, 0) :])
                sizes.append(len(data))
                removed.append(gone)
                spans.append(count)
                hashes.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _count_early(every: DataFrame) -> DataFrame:
    """Runs counted within each task, so that a common run is few rows when runs are dealt out."""
    names = ["doc_id", "key", "start", *RUN]

    def merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(c).to_numpy() for c in RUN]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        firsts = np.flatnonzero(new)
        times = np.diff(np.append(firsts, len(order)))
        picked = table.take(pa.array(order[firsts]))
        return pa.record_batch([*(picked.column(c).combine_chunks() for c in names), pa.array(times, pa.int64())], [*names, "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= COUNTED_AT_ONCE:
                yield merge(held)
                held = []
        if held:
            yield merge(held)

    return every.select(*names).mapInArrow(run, f"doc_id long, key long, start long, {_RUN_TYPES}, times long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, key, a, b), distinct: byte ranges of docs(doc_id, key, text) whose strings occur elsewhere too."""
    every = cut(runs(docs))
    kinds = cut(_count_early(every).repartition(*RUN).groupBy(*RUN).agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "key", "start")).alias("one")))
    # counted apart and joined, as one anchor may have a large share of all runs
    buckets = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = cut(kinds.join(buckets, "anchor").select("one.*", *RUN, "kinds"))
    contexts = _contexts(docs, mixed)
    if mixed.where(F.col("kinds") > MOST_RUNS).take(1):
        contexts = keep(contexts)
        found = _decide(contexts, SLICES)
    else:
        found = _sort_buckets(contexts)
    found = _whole(kinds).unionByName(found)
    return every.join(found, RUN).select("doc_id", "key", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LENGTH).alias("b")).distinct()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    reach(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    ranges = cut(repeated_ranges(docs).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    bloom = Bloom(ranges)
    held = bloom.of(docs, True)
    hit = held.join(ranges, held.doc_id.eqNullSafe(ranges.doc_id) & (held.key == ranges.key), "left").select(held.doc_id, "text", "ranges")
    rest = bloom.of(docs, False).withColumn("ranges", F.lit(None).cast(hit.schema["ranges"].dataType))
    return _digest(hit).unionByName(_digest(rest))
