"""Exact Jaccard self-join of the documents' word n-gram sets, and its components.

Two sets of similarity t or more share a shingle among the first ``n - ceil(t n) + 1`` of
either, in any order common to all sets. The order here is by the number of sets that
hold a shingle, rarest first, counted over all of them. A shingle that one set alone
holds needs no list, but it takes a position.

Relations between sets are used twice, as in set-relation skipping:

* Index lists are skipped in blocks by position. An entry at position p of a set of n
  shingles, met first, leaves an overlap of n - p at most, so it can only answer sets of
  up to ((1 + t) (n - p) / t - n) shingles. A list is cut into blocks by set size; an
  entry looks only into the blocks between t n and that limit, so the later it stands the
  fewer it reads, and an entry of the index side whose limit is below its own size is in no
  block at all. Skipping is part of the join's key: skipped pairs are never made.
* Answers come from a highly similar set's answers. Equal sets are one set. Each set is
  first compared with one leader, the set of its lists with the fewest rare shingles
  before them; the overlap is kept. Sets linked to a leader have its component, and only
  pairs that lie in two components are looked at again. For a pair compared with the same
  leader, the two known overlaps bound its own from below and above; sets are compared
  themselves only where these bounds leave it open.

How often a shingle is held is counted without a row for each: a task sends, for each
range of hashes, one packed array of its sets' shingles, and gets back those that occur
elsewhere too. Verification sends each set once for each pair to the other set's task,
where it is compared as it streams by.

A shingle is known by a 64-bit hash of its words (in lists by the upper 32 bits and those
that name the range, which only makes candidates), a set by a 128-bit hash of its shingles.

Null and empty texts, and texts without words, have no shingle and no link. Texts of
fewer than n words have their whole sequence as the one shingle. Rows may repeat; each
row of the input gives a row. A null doc_id takes part and is never a component's name
unless nothing else is in it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .suffixes import Bloom
from .text import chunks, flat, mix, run_hashes, span_hashes, words
from ..session import cut, hot_join, keep, reach

#: Bytes of texts that are cut into shingles at once.
HASHED_AT_ONCE = 1 << 20
#: Shingles and sets that a task packs together.
PACKED_AT_ONCE, SETS_AT_ONCE = 1 << 20, 1 << 14
#: Ranges of shingle hashes for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 1 << 15
#: Sets that are compared with one leader in one place; a larger group is split.
GROUP = 256
#: Size blocks for each step of the similarity's ratio.
FINE = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a flat batch: hashes, sorted by text and hash, and where each text's begin."""
    starts, ends, docs = words(data, offsets)
    hashes = span_hashes(data, starts, ends, lower=True)
    texts = len(offsets) - 1
    per = np.bincount(docs, minlength=texts)
    whole = run_hashes(hashes, n)
    same = np.flatnonzero(docs[: len(whole)] == docs[n - 1 :]) if len(whole) else np.zeros(0, np.int64)
    shingles, owners = [whole[same]], [docs[same]]
    first = np.concatenate([[0], np.cumsum(per)])
    for text in np.flatnonzero((per > 0) & (per < n)).tolist():
        shingles.append(run_hashes(hashes[first[text] : first[text + 1]], int(per[text])))
        owners.append(np.full(1, text))
    shingle, owner = np.concatenate(shingles), np.concatenate(owners)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    return shingle, np.searchsorted(owner, np.arange(texts + 1))


def set_ids(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles ^ np.uint64(seed)), out=sums[1:])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _pack(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte of the number so that the high ones compress."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint32)


def _split(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _join(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()


_SURVEY = "part int, chunk long, slot int, doc_id long, key long, hi long, lo long, size long, keys binary, owners binary, holders binary"
_SETS = ["doc_id", "key", "hi", "lo", "size"]


def _rows(part, chunk, slot=None, sets: pa.RecordBatch | None = None, blobs: list[list[bytes]] | None = None) -> pa.RecordBatch:
    n = len(part)
    nothing = pa.nulls(n, pa.int64())
    columns = [pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.nulls(n, pa.int32()) if slot is None else pa.array(slot, pa.int32())]
    columns += [sets.column(c) for c in _SETS] if sets is not None else [nothing] * 5
    columns += [pa.array(b, pa.binary()) for b in blobs] if blobs is not None else [pa.nulls(n, pa.binary())] * 3
    return pa.record_batch(columns, ["part", "chunk", "slot", *_SETS, "keys", "owners", "holders"])


def _deal(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows of each document's set, and for each range of hashes the packed shingles of many sets."""

    def pack(number: int, sets: pa.RecordBatch, shingles: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        hi, lo = sets.column("hi").to_numpy(), sets.column("lo").to_numpy()
        seed = np.array([TaskContext.get().partitionId() << 32 | number], np.int64)
        chunk = int(mix(np.concatenate([seed, hi, lo]).view(np.uint64) * np.arange(1, 2 * len(hi) + 2, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        nth = np.empty(len(order), np.int64)
        nth[order] = np.cumsum(new) - 1
        firsts = order[new]
        # a set's slot follows from its hash where it is free, so that copies have the same slot in most chunks
        slots, taken = np.empty(len(firsts), np.int64), set()
        for k, slot in enumerate((lo[firsts] & 0xFFFF).tolist()):
            while slot in taken:
                slot = slot + 1 & 0xFFFF
            taken.add(slot)
            slots[k] = slot
        yield _rows((chunk + np.arange(len(hi))) % (1 << bits), np.full(len(hi), chunk), slots[nth], sets)
        sizes = np.diff(offsets)
        mine = np.zeros(len(hi), bool)
        mine[firsts] = True
        inside = np.repeat(mine, sizes)
        keys, owners = shingles[inside], np.repeat(slots[nth], sizes)[inside]
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        filled = np.flatnonzero(np.diff(edges))
        low = (keys >> np.uint64(32 - bits)).astype(np.uint32)
        blobs = [[_pack(low[a:b]) for a, b in zip(edges[filled], edges[filled + 1])], [_split(owners[a:b]) for a, b in zip(edges[filled], edges[filled + 1])], [None] * len(filled)]
        yield _rows(filled, np.full(len(filled), chunk), blobs=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        number = 0

        def packed() -> Iterator[pa.RecordBatch]:
            sets = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            return pack(number, sets, np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(sizes)]))

        for part in chunks(batches, most=HASHED_AT_ONCE):
            for at in range(0, part.num_rows, SETS_AT_ONCE):
                piece = part.slice(at, SETS_AT_ONCE)
                shingles, offsets = shingle_sets(*flat(piece.column("text")), n)
                hi, lo = set_ids(shingles, offsets)
                if held and (sum(len(h[1]) for h in held) + len(shingles) > PACKED_AT_ONCE or sum(h[0].num_rows for h in held) + len(hi) > SETS_AT_ONCE):
                    yield from packed()
                    held, number = [], number + 1
                held.append((pa.record_batch([piece.column("doc_id"), piece.column("key"), pa.array(hi), pa.array(lo), pa.array(np.diff(offsets), pa.int64())], _SETS), shingles, offsets))
        if held:
            yield from packed()

    return docs.mapInArrow(run, _SURVEY)


def _count(dealt: DataFrame, partitions: int) -> DataFrame:
    """The rows of sets as they are, and for each chunk and range the shingles that occur in other sets too, with how many hold them."""

    def count(part: int, chunk: np.ndarray, keys: list[bytes], owners: list[bytes]) -> pa.RecordBatch:
        each = [_unpack(k) for k in keys]
        key, owner, whose = np.concatenate(each), np.concatenate([_join(o) for o in owners]), np.repeat(np.arange(len(each)), [len(k) for k in each])
        order = np.argsort(key.astype(np.uint64) << np.uint64(16) | owner, kind="stable")
        k, o = key[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        other = new.copy()
        other[1:] |= o[1:] != o[:-1]
        group = np.cumsum(new) - 1
        times, sets = np.bincount(group), np.bincount(group, other).astype(np.int64)
        # 1: perhaps copies of one set in many chunks
        holders = np.empty(len(k), np.int64)
        holders[order] = np.where(times > 1, np.minimum(sets, 65535), 0)[group]
        shared = np.flatnonzero(holders)
        edges = np.searchsorted(whose[shared], np.arange(len(each) + 1))
        some = np.flatnonzero(np.diff(edges))
        pieces = [shared[edges[c] : edges[c + 1]] for c in some]
        return _rows(np.full(len(some), part), chunk[some], blobs=[[_pack(key[p]) for p in pieces], [_split(owner[p]) for p in pieces], [_split(holders[p]) for p in pieces]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def counted() -> pa.RecordBatch:
            chunk = np.concatenate([h.column("chunk").to_numpy() for h in held])
            return count(now, chunk, [x for h in held for x in h.column("keys").to_pylist()], [x for h in held for x in h.column("owners").to_pylist()])

        for batch in batches:
            blob = batch.column("keys").is_valid().to_numpy(zero_copy_only=False)
            if not blob.all():
                yield batch.filter(pa.array(~blob))
            batch = batch.filter(pa.array(blob))
            part = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if now is not None and part[a] != now:
                    yield counted()
                    held = []
                now = int(part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield counted()

    return dealt.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, _SURVEY)


def _entries(survey: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, size, place): the entries of each set's prefix that other sets may hold too."""

    def entries(ids: np.ndarray, sizes: np.ndarray, slots: np.ndarray, owner: np.ndarray, holders: np.ndarray, shingle: np.ndarray) -> pa.RecordBatch:
        nth = np.full(1 << 16, -1)
        nth[slots] = np.arange(len(slots))
        mine = nth[owner]
        held = mine >= 0
        mine, holders, shingle = mine[held], holders[held], shingle[held]
        order = np.lexsort((shingle, holders, mine))
        mine, shingle = mine[order], shingle[order]
        number = np.bincount(mine, minlength=len(ids))
        place = np.arange(len(mine)) - np.repeat(np.cumsum(number) - number, number) + (sizes - number)[mine]
        prefix = sizes - -(-percent * sizes // 100) + 1
        inside = np.flatnonzero(place < prefix[mine])
        who = mine[inside]
        return pa.record_batch([pa.array(shingle[inside]), pa.array(ids[who]), pa.array(sizes[who], pa.int64()), pa.array(place[inside], pa.int64())], ["shingle", "id", "size", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def solved() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            blob = table.column("keys").is_valid()
            sets, replies = table.filter(pa.compute.invert(blob)), table.filter(blob)
            if not sets.num_rows or not replies.num_rows:
                return
            keys = [_unpack(x) for x in replies.column("keys").to_pylist()]
            part = np.repeat(replies.column("part").to_numpy().astype(np.int64), [len(k) for k in keys])
            shingle = part << 32 | np.concatenate(keys).astype(np.int64)
            owner, holders = (np.concatenate([_join(x) for x in replies.column(c).to_pylist()]).astype(np.int64) for c in ("owners", "holders"))
            yield entries(*(sets.column(c).to_numpy().astype(np.int64) for c in ("id", "size", "slot")), owner, holders, shingle)

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if now is not None and chunk[a] != now:
                    yield from solved()
                    held = []
                now = chunk[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solved()

    replies = survey.where("keys is not null").select("chunk", "part", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("size"), "keys", "owners", "holders")
    nothing = F.lit(None).cast("binary")
    sets = own.where("size > 0").select("chunk", F.lit(None).cast("int").alias("part"), "slot", "id", "size", nothing.alias("keys"), nothing.alias("owners"), nothing.alias("holders"))
    return replies.unionByName(sets).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "shingle long, id long, size long, place long")


def verify(docs: DataFrame, holders: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, overlap, size_a, size_b) of the pairs(a, b) of sets. holders(id, doc_id, key): a document of each set."""
    # b leads a group, split by a's hash so that no group is large; a set says in which groups it is compared
    pairs = keep(pairs.select("a", "b"))
    per = pairs.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP).alias("parts"))
    parts = hot_join(pairs, per, ["b"], "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    roles = parts.select(F.col("a").alias("id"), F.col("b").alias("group"), "part", F.lit(1).alias("role")).unionByName(
        per.select(F.col("b").alias("id"), F.col("b").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")))
    # at most GROUP roles travel with one copy of a text
    packed = roles.withColumn("share", F.pmod(F.xxhash64("group", "part"), F.lit(16)))
    asked = cut(packed.groupBy("id", "share").agg(F.collect_list(F.struct("group", "part", "role")).alias("roles")).join(holders, "id").select("id", "doc_id", "key", "roles"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch]), most=HASHED_AT_ONCE):
                shingles, offsets = shingle_sets(*flat(part.column("text")), n)
                columns: list[list] = [[] for _ in range(5)]
                size = 0
                for k, (one, roles) in enumerate(zip(part.column("id").to_pylist(), part.column("roles").to_pylist())):
                    content = shingles[offsets[k] : offsets[k + 1]].tobytes()
                    for r in roles:
                        for column, value in zip(columns, (r["group"], r["part"], r["role"], one, content)):
                            column.append(value)
                        size += len(content)
                        if size > 8 * HASHED_AT_ONCE:
                            yield _contents(columns)
                            columns, size = [[] for _ in range(5)], 0
                yield _contents(columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, against = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows: list[tuple] = []
            for group, part, role, one, content in zip(*(batch.column(c) for c in ("group", "part", "role", "id", "content"))):
                key = (group.as_py(), part.as_py())
                mine = np.frombuffer(content.as_py(), np.uint64)
                if role.as_py() == 0:
                    leader, against = key, mine
                    continue
                if leader != key:
                    raise RuntimeError("a group without its leader")
                at = np.minimum(np.searchsorted(against, mine), len(against) - 1)
                rows.append((one.as_py(), key[0], int((against[at] == mine).sum()), len(mine), len(against)))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["a", "b", "overlap", "size_a", "size_b"])

    held = Bloom(asked).of(docs, True).dropDuplicates(["doc_id", "key"])
    texts = held.join(asked, held.doc_id.eqNullSafe(asked.doc_id) & (held.key == asked.key)).select("id", "text", "roles")
    sets = texts.mapInArrow(emit, "group long, part long, role long, id long, content binary")
    return sets.repartition("group", "part").sortWithinPartitions("group", "part", "role").mapInArrow(compare, "a long, b long, overlap long, size_a long, size_b long")


def _contents(columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["group", "part", "role", "id", "content"])


def _limit(percent: int, size: str, place: str):
    """The largest set that an entry can answer if it is the first one met."""
    return F.floor(((100 + percent) * (F.col(size) - F.col(place)) - percent * F.col(size)) / percent)


def _linked(percent: int, overlap, a: str = "size_a", b: str = "size_b"):
    return (100 + percent) * overlap >= percent * (F.col(a) + F.col(b))


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """For each set the leader it meets most often in lists(shingle, id, size, place, leader), if a link is possible."""
    flat_lists = lists.select("id", "size", "place", F.col("leader.id").alias("b"), F.col("leader.size").alias("size_b"), F.col("leader.place").alias("place_b"))
    fits = (F.col("size") <= _limit(percent, "size_b", "place_b")) & (F.col("size_b") <= _limit(percent, "size", "place")) & (F.col("id") != F.col("b"))
    met = flat_lists.where(fits).groupBy("id", "b").agg(F.count("*").alias("times"))
    return met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _rest_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, size_a, size_b): pairs of sets of different components that an entry finds in a block that it may read.

    a is the smaller set. Its entries stand in the block of its size, if they can answer a set
    as large as their own; b's entries read the blocks from t times its size to their limit.
    """
    block = lambda size: F.floor(F.log(size.cast("double")) / math.log(100 / percent) * FINE).cast("int")
    limit = _limit(percent, "size", "place")
    left = lists.where(limit >= F.col("size")).select("shingle", F.col("id").alias("a"), F.col("component").alias("component_a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), limit.alias("limit_a"), block(F.col("size")).alias("block"))
    lowest = F.greatest(F.ceil(percent * F.col("size") / 100), F.lit(1))
    highest = F.least(limit, F.col("size"))
    right = lists.where(highest >= lowest).select("shingle", F.col("id").alias("b"), F.col("component").alias("component_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), lowest.alias("lowest_b"), highest.alias("highest_b"), F.explode(F.sequence(block(lowest), block(highest))).alias("block"))
    fits = (F.col("component_a") != F.col("component_b")) & F.col("size_a").between(F.col("lowest_b"), F.col("highest_b")) & (F.col("size_b") <= F.col("limit_a")) & ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b")))
    met = left.join(right, ["shingle", "block"]).where(fits).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("met"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"))
    # shared shingles up to the last one met are all met; what follows it lies behind it in both sets
    most = F.col("met") + F.least(F.col("size_a") - F.col("place_a") - 1, F.col("size_b") - F.col("place_b") - 1)
    return met.where(_linked(percent, most)).select("a", "b", "size_a", "size_b")


def _derive(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """pairs with ``known``: true or false where the answers(a, b, overlap, size_b) of both to their leaders decide, else null."""
    one = answers.select(F.col("a"), F.col("b").alias("lead_a"), F.col("overlap").alias("with_a"), F.col("size_b").alias("size_lead"))
    two = answers.select(F.col("a").alias("b"), F.col("b").alias("lead_b"), F.col("overlap").alias("with_b"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    same = F.col("lead_a") == F.col("lead_b")
    least = F.col("with_a") + F.col("with_b") - F.col("size_lead")
    most = F.least("with_a", "with_b") + F.least(F.col("size_a") - F.col("with_a"), F.col("size_b") - F.col("with_b"))
    # a pair of a set and its own leader in two components was compared and is no link
    compared = F.coalesce(F.col("lead_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("lead_b") == F.col("a"), F.lit(False))
    known = F.when(compared, False).when(same & _linked(percent, least), True).when(same & ~_linked(percent, most), False)
    return both.select("a", "b", known.alias("known"))


def components_of(docs: DataFrame, n: int = 4, percent: int = 85, identity: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: components of links of similarity percent / 100 or more.

    identity: return (doc_id, key, n_shingles, component) instead, key a hash of the text.
    """
    spark = docs.sparkSession
    reach(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(RANGES * partitions, MOST_RANGES).bit_length()
    survey = keep(_count(_deal(docs, n, bits), partitions))
    sets = survey.where("keys is null").select("doc_id", "key", "chunk", "slot", "hi", "lo", "size")
    own = keep(sets.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "key", "chunk", "slot", "size")).alias("one"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).select("hi", "lo", "rows", "least_id", "one.*", F.monotonically_increasing_id().alias("id")))
    entries = keep(_entries(survey, own, percent))

    # index lists that hold at least two sets, each with its leader
    rank = F.floor(1024 * F.col("place") / F.col("size"))
    found = entries.groupBy("shingle").agg(F.count("*").alias("sets"), F.min(F.struct(rank.alias("rank"), "id", "size", "place")).alias("leader")).where("sets > 1")
    lists = keep(entries.join(found.select("shingle", "leader"), "shingle"))
    holders = own.select("id", "doc_id", "key")
    answers = keep(verify(docs, holders, _star_pairs(lists, percent), n))
    links = answers.where(_linked(percent, F.col("overlap"))).select("a", "b")
    known = components(links).withColumnRenamed("node", "id")

    placed = keep(lists.drop("leader").join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("shingle")
    rest = keep(_derive(_rest_pairs(placed.join(mixed, "shingle"), percent), answers, percent))
    if rest.where("known is null or known").take(1):
        more = verify(docs, holders, rest.where("known is null").select("a", "b"), n).where(_linked(percent, F.col("overlap"))).select("a", "b")
        links = links.unionByName(rest.where("known").select("a", "b")).unionByName(more)
        known = components(links).withColumnRenamed("node", "id")

    placed = keep(own.where("size > 0").join(known, "id", "left").select("hi", "lo", "rows", "least_id", F.coalesce("component", "id").alias("component")))
    groups = keep(placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("rows").alias("rows")))
    total = sets.count()
    named = hot_join(placed.select("hi", "lo", "rows", "component"), groups.select("component", "component_id", F.col("rows").alias("all")), ["component"], "all", total)
    out = hot_join(sets.where("size > 0").select("doc_id", "key", "hi", "lo", "size"), named, ["hi", "lo"], "rows", total)
    none = sets.where("size = 0")
    if identity:
        return out.select("doc_id", "key", F.col("size").alias("n_shingles"), "component").unionByName(none.select("doc_id", "key", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(none.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of docs without those that are not the first of their component, with all their columns.

    First is the row of the least (doc_id, text hash); of wholly equal ones any.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = keep(components_of(docs, n, percent, identity=True))
    order = F.struct("doc_id", "key")
    spare = keep(found.where("n_shingles > 0").groupBy("component").agg(F.min(F.when(F.col("doc_id").isNotNull(), order)).alias("named"), F.min(order).alias("any"), F.count("*").alias("rows")).where("rows > 1").select("component", "rows", F.coalesce("named", "any").alias("first")))
    groups = hot_join(found.where("n_shingles > 0"), spare, ["component"], "rows", found.count())
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))
    # rows to drop, and repeats of a row that stays; all others pass without a shuffle of their texts
    goes = keep(groups.groupBy("doc_id", "key", other.alias("other")).agg(F.count("*").alias("n")).where("other or n > 1").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("other").alias("_other")))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    flagged = Bloom(goes.select(F.col("_d").alias("doc_id"), F.col("_k").alias("key"))).flag(keyed, "_id", "_key", "_may", "_bloom")
    joined = flagged.where("_may").join(goes, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    stay = joined.where(F.col("_other").isNull())
    leaders = joined.where("_other = false").dropDuplicates(["_id", "_key"])
    return reduce(DataFrame.unionByName, [x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]) for x in (flagged.where("not _may"), stay, leaders)])
