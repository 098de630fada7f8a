"""FLAC media columns: texts stored as 8-bit mono FLAC, read back, and cut into PCM blocks.

The coder works on many frames at once: every field of every frame (sub-frame
header, warm-up samples, Rice parameter, Rice-coded residuals) is a value and a
number of bits, positions are running sums, and all bits are set together. The
decoder moves along all frames at once, a sample at each step, undoes the
predictors (fixed, or with coefficients that were fitted to the frame where those leave
less), and checks the CRC-8 of every header, the
CRC-16 of every frame and the MD5 of the samples. A seek point for each frame tells
where each block of samples lies.

A stream is one row's bytes; a row never depends on another, so a lost task is
simply run again. Null text counts as empty; payloads are padded with bytes 255 to a
positive multiple of 576. Equal texts give equal streams. Repeated rows give repeated
rows, and further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, flat
from ..session import reach

BLOCK = 576
#: Payload bytes coded at once.
CODED_AT_ONCE = 1 << 20
RATE = 8000
_CONSTANT, _VERBATIM, _FIXED, _LPC = 0, 1, 8, 32
#: Coefficients of the fixed predictors by order.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
#: Fitted predictors: order, bits of a coefficient, and its fraction's bits.
ORDER, PRECISION, SHIFT = 4, 7, 5


class CorruptStream(ValueError):
    """A checksum or a field of a stream is wrong."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ (polynomial if crc >> (bits - 1) else 0)
            crc &= (1 << bits) - 1
        table[byte] = crc
    return table


_CRC8 = _crc_table(0x07, 8)
_CRC16 = _crc_table(0x8005, 16)


@lru_cache(maxsize=4)
def _crc16_by_distance(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 of its frame, by its distance from the frame's end."""
    table = np.empty((n, 256), np.uint16)
    table[0] = _CRC16
    for k in range(1, n):
        before = table[k - 1]
        table[k] = _CRC16[before >> 8] ^ (before << 8)
    return table


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span; the spans are not empty."""
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    distance = np.repeat(ends, lengths) - 1 - at
    table = _crc16_by_distance(1 << int(lengths.max() - 1).bit_length() if lengths.max() > 1 else 1)
    return np.bitwise_xor.reduceat(table[distance, data[at]], np.concatenate([[0], np.cumsum(lengths)[:-1]]))


def crc8(header: bytes) -> int:
    crc = 0
    for byte in header:
        crc = int(_CRC8[crc ^ byte])
    return crc


@lru_cache(maxsize=1 << 14)
def frame_header(number: int) -> bytes:
    """Header of a 576-sample, 8-bit, mono frame."""
    if number < 0x80:
        coded = bytes([number])
    else:
        tail, rest = [], number
        while rest >= 1 << (6 - len(tail)):
            tail.insert(0, 0x80 | rest & 0x3F)
            rest >>= 6
        coded = bytes([(0xFF << (7 - len(tail))) & 0xFF | rest, *tail])
    header = b"\xff\xf8\x20\x02" + coded
    return header + bytes([crc8(header)])


def fitted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of each frame's linear predictor, and what it leaves from place ORDER on."""
    wide = x.astype(np.int64)
    lags = np.stack([(wide[:, k:] * wide[:, : BLOCK - k]).sum(1) for k in range(ORDER + 1)], 1).astype(float)
    lags[:, 0] += lags[:, 0] * 1e-4 + 1
    toeplitz = lags[:, np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))]
    exact = np.linalg.solve(toeplitz, lags[:, 1:, None])[:, :, 0]
    coefficients = np.clip(np.rint(exact * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    guess = sum(coefficients[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    return coefficients, x[:, ORDER:] - guess


def code_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of a (frames, 576) array, and where each starts (frames + 1 offsets)."""
    m = len(samples)
    x = samples.astype(np.int32)
    best = np.abs(x[:, 4:]).sum(1)
    order, residual, level = np.zeros(m, np.int64), x.copy(), x
    for k in range(1, 5):
        level = np.diff(level, axis=1)
        cost = np.abs(level[:, 4 - k :]).sum(1)
        better = cost < best
        best = np.where(better, cost, best)
        order[better] = k
        residual[better, k:] = level[better]
    coefficients, left = fitted(x)
    # halving what is left saves a bit for each sample; the coefficients take this many
    extra = 9 + ORDER * PRECISION + 8 * (ORDER - order)
    lpc = np.abs(left).sum(1) * 2.0 ** (extra / (BLOCK - ORDER)) < best
    order[lpc] = ORDER
    residual[lpc, ORDER:] = left[lpc]
    column = np.arange(BLOCK)
    tail = column >= order[:, None]
    folded = np.where(tail, (residual << 1) ^ (residual >> 31), 0)
    # unary parts over 15 bits would not fit the packing below: such parameters are not tried
    most = folded.max(1)
    size = np.stack([np.where(most >> k > 15, 1 << 30, (folded >> k).sum(1) + (k + 1) * (BLOCK - order)) for k in range(8)])
    rice = size.argmin(0)
    bits = size.min(0) + 18 + 8 * order + lpc * (9 + ORDER * PRECISION)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (bits >= 8 + 8 * BLOCK)
    coded = ~constant & ~verbatim
    lpc &= coded

    value = np.zeros((m, BLOCK + 3), np.int64)
    width = np.zeros((m, BLOCK + 3), np.int64)
    value[:, 0] = np.select([constant, verbatim, lpc], [_CONSTANT << 1, _VERBATIM << 1, (_LPC + order - 1) << 1], (_FIXED + order) << 1)
    width[:, 0] = 8
    # sample t stands in column t + 1 as a warm-up and in column t + 3 as a residual
    warm = (verbatim[:, None]) | (coded[:, None] & ~tail)
    warm[:, 0] |= constant
    value[:, 1 : BLOCK + 1] = np.where(warm, x & 255, 0)
    width[:, 1 : BLOCK + 1] = np.where(warm, 8, 0)
    rows = np.flatnonzero(coded)
    value[rows, order[rows] + 2] = rice[rows]
    width[rows, order[rows] + 2] = 10
    r, c = np.nonzero(coded[:, None] & tail)
    k, f = rice[r], folded[r, c]
    value[r, c + 3] = (1 << k) | (f & ((1 << k) - 1))
    width[r, c + 3] = (f >> k) + 1 + k
    some = np.flatnonzero(lpc)
    word = np.full(len(some), PRECISION - 1 << 5 | SHIFT, np.int64)
    for j in range(ORDER):
        word = word << PRECISION | coefficients[some, j] & (1 << PRECISION) - 1
    value[some, ORDER + 1], width[some, ORDER + 1] = word, 9 + ORDER * PRECISION

    headers = [frame_header(int(n)) for n in numbers]
    lengths = np.array([len(h) for h in headers])
    ends = np.cumsum(width, axis=1)
    bodies = (ends[:, -1] + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(lengths + bodies + 2)])
    last = ends + 8 * (starts[:-1] + lengths)[:, None]
    shifted = (value << (-last & 7)).ravel()
    at = ((last + 7) >> 3).ravel() - 1
    out = np.zeros(starts[-1] + 8)
    for k in range(6 if len(some) else 3):
        part = shifted >> (8 * k) & 255
        filled = np.flatnonzero(part)
        out += np.bincount(at[filled] - k, part[filled], minlength=len(out))
    out = out[: starts[-1]].astype(np.uint8)
    heads = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths)])
    out[heads] = np.frombuffer(b"".join(headers), np.uint8)
    crc = crc16(out, starts[:-1], starts[1:] - 2)
    out[starts[1:] - 2] = crc >> 8
    out[starts[1:] - 1] = crc & 255
    return out, starts


def wrap(frames: bytes, sizes: np.ndarray, samples: bytes) -> bytes:
    """A whole stream: marker, stream information with MD5, a seek point for each frame, the frames."""
    n = len(sizes)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(samples).digest()
    points = np.zeros((n, 18), np.uint8)
    points[:, 0:8] = (np.arange(n, dtype=np.uint64) * BLOCK).astype(">u8").view(np.uint8).reshape(n, 8)
    points[:, 8:16] = (np.cumsum(sizes) - sizes).astype(">u8").view(np.uint8).reshape(n, 8)
    points[:, 16:18] = np.frombuffer(struct.pack(">H", BLOCK), np.uint8)
    # a block of metadata holds under 2 ** 24 bytes; longer streams go without the rest of the points
    seek = points[: ((1 << 24) - 1) // 18].tobytes()
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A stream for each text of a flat batch."""
    lengths = np.diff(offsets)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.full(first[-1] * BLOCK, 255, np.uint8)
    padded[np.repeat(first[:-1] * BLOCK - offsets[:-1], lengths) + np.arange(offsets[-1])] = data
    samples = (padded ^ 128).view(np.int8)
    frames, starts = code_frames(samples.reshape(-1, BLOCK), np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    sizes = np.diff(starts)
    return [wrap(frames[starts[a] : starts[b]].tobytes(), sizes[a:b], samples[a * BLOCK : b * BLOCK].tobytes()) for a, b in zip(first[:-1], first[1:])]


_ZEROS = np.full(1 << 16, 16, np.int64)
for _k in range(16):
    _ZEROS[1 << (15 - _k) : 1 << (16 - _k)] = _k


class _Bits:
    """Reads bits at any place of a byte array, at many places at once."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.window = wide[:-4] << np.uint64(32) | wide[1:-3] << np.uint64(24) | wide[2:-2] << np.uint64(16) | wide[3:-1] << np.uint64(8) | wide[4:]
        self.end = 8 * len(data)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits from each place on."""
        if at.size and at.max() > self.end:
            raise CorruptStream("a frame runs past the end")
        return self.window[at >> 3] >> (8 - (at & 7)).astype(np.uint64) & np.uint64(0xFFFFFFFF)

    def take(self, at: np.ndarray, n: int, signed: bool = False) -> np.ndarray:
        found = (self.peek(at) >> np.uint64(32 - n)).astype(np.int64) if n else np.zeros(len(at), np.int64)
        at += n
        return np.where(found >> (n - 1) & 1, found - (1 << n), found) if signed and n else found

    def rice(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The Rice-coded numbers at each place, unfolded; the places move on."""
        word = self.peek(at)
        zeros = _ZEROS[word >> np.uint64(16)]
        if (long := zeros == 16).any():
            for lane in np.flatnonzero(long):  # a long unary part: count on bit by bit
                n = 0
                place = at[lane : lane + 1].copy()
                while not self.take(place, 1)[0]:
                    n += 1
                zeros[lane] = n
            at += zeros + 1
            low = np.zeros(len(at), np.int64)
            for width in np.unique(k):
                if width:
                    some = k == width
                    place = at[some]
                    low[some] = self.take(place, int(width))
            at += k
        else:
            low = ((word << (zeros + 1).astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> (32 - k).astype(np.uint64)).astype(np.int64)
            at += zeros + 1 + k
        folded = zeros << k | low
        return folded >> 1 ^ -(folded & 1)


def _block_sizes(bits: _Bits, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.where(code == 1, 192, np.where(code <= 5, 144 << np.clip(code, 2, 5), 1 << np.clip(code, 8, 15)))
    for c, n in ((6, 8), (7, 16)):
        if (some := code == c).any():
            place = at[some]
            size[some] = bits.take(place, n) + 1
            at[some] = place
    if (code == 0).any():
        raise CorruptStream("reserved block size")
    return size


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples of the frame at each start, each frame's number, and where it ends. Checks both checksums."""
    bits = _Bits(data)
    at = starts.astype(np.int64) * 8
    if (bits.take(at, 16) & 0xFFFE != 0xFFF8).any():
        raise CorruptStream("no frame starts here")
    size_code, rate, channels, width = bits.take(at, 4), bits.take(at, 4), bits.take(at, 4), bits.take(at, 4)
    if channels.any() or (width != 2).any() or (rate >= 12).any():
        raise CorruptStream("not 8-bit mono")
    lead = bits.take(at, 8)
    number = np.where(lead < 0x80, lead, 0)
    for extra in range(1, 7):
        some = np.flatnonzero((lead >= 256 - (1 << (7 - extra))) & (lead < 256 - (1 << (6 - extra))))
        if len(some):
            place, n = at[some], lead[some] & ((1 << (6 - extra)) - 1)
            for _ in range(extra):
                n = n << 6 | bits.take(place, 8) & 0x3F
            at[some], number[some] = place, n
    sizes = _block_sizes(bits, size_code, at)
    header_ends = at >> 3
    at += 8
    for start, end in zip(starts.tolist(), header_ends.tolist()):
        if _header_crc(data[start:end].tobytes()) != data[end]:
            raise CorruptStream("header checksum")
    kind = bits.take(at, 8)
    if (kind & 0x81).any():
        raise CorruptStream("wasted bits or a broken sub-frame")
    kind >>= 1
    samples: list[np.ndarray] = [np.zeros(0)] * len(starts)
    for which, size in sorted(set(zip(kind.tolist(), sizes.tolist()))):
        rows = np.flatnonzero((kind == which) & (sizes == size))
        place = at[rows]
        found = _sub_frames(bits, place, which, size)
        at[rows] = place
        for row, x in zip(rows.tolist(), found):
            samples[row] = x
    ends = (at + 7) >> 3
    if ends.max() + 2 > len(data):
        raise CorruptStream("a frame runs past the end")
    if (crc16(data, starts, ends) != (data[ends].astype(np.uint16) << 8 | data[ends + 1])).any():
        raise CorruptStream("frame checksum")
    return samples, number, ends + 2


@lru_cache(maxsize=1 << 14)
def _header_crc(header: bytes) -> int:
    return crc8(header)


def _sub_frames(bits: _Bits, at: np.ndarray, kind: int, size: int) -> np.ndarray:
    """Samples of sub-frames that are all of one kind, order and size; the places move on."""
    n = len(at)
    if kind == _CONSTANT:
        return np.repeat(bits.take(at, 8, signed=True)[:, None], size, axis=1)
    if kind == _VERBATIM:
        return np.stack([bits.take(at, 8, signed=True) for _ in range(size)], axis=1)
    if not (_FIXED <= kind <= _FIXED + 4 or kind >= _LPC):
        raise CorruptStream("reserved sub-frame")
    order = kind - _LPC + 1 if kind >= _LPC else kind - _FIXED
    if order > size:
        raise CorruptStream("predictor longer than the block")
    out = np.zeros((size, n), np.int64)
    for t in range(order):
        out[t] = bits.take(at, 8, signed=True)
    coefficients = shift = None
    if kind >= _LPC:
        precision, shift = bits.take(at, 4) + 1, bits.take(at, 5, signed=True)
        if (precision == 16).any() or (shift < 0).any():
            raise CorruptStream("bad predictor")
        coefficients = np.zeros((order, n), np.int64)
        for width in np.unique(precision):
            some = precision == width
            place = at[some]
            for j in range(order):
                coefficients[j, some] = bits.take(place, int(width), signed=True)
            at[some] = place
    method, partitions = bits.take(at, 2), bits.take(at, 4)
    if (method > 1).any():
        raise CorruptStream("reserved residual coding")
    for how, fold in sorted(set(zip(method.tolist(), partitions.tolist()))):
        some = np.flatnonzero((method == how) & (partitions == fold))
        place, length = at[some], size >> fold
        if size % (1 << fold) or length < order:
            raise CorruptStream("bad partitions")
        rice = np.zeros(len(some), np.int64)
        for t in range(order, size):
            if t == order or t % length == 0:
                rice = bits.take(place, 5 if how else 4)
                if escaped := (rice == (31 if how else 15)).any():
                    raw = np.where(rice == (31 if how else 15), bits.take(p := place.copy(), 5), -1)
                    place[raw >= 0] = p[raw >= 0]
            if escaped:
                for width in np.unique(raw):
                    lanes = np.flatnonzero(raw == width)
                    p = place[lanes]
                    out[t, some[lanes]] = bits.rice(p, rice[lanes]) if width < 0 else bits.take(p, int(width), signed=True)
                    place[lanes] = p
            else:
                out[t, some] = bits.rice(place, rice)
        at[some] = place
    if coefficients is not None:
        for t in range(order, size):
            out[t] += (coefficients * out[t - order : t][::-1]).sum(0) >> shift
    else:  # undo the differences one after the other, each from its first value on
        for level in range(order - 1, -1, -1):
            head = np.diff(out[: level + 1], n=level, axis=0)[0] if level else out[0].copy()
            out[level] = head
            np.cumsum(out[level:], axis=0, out=out[level:])
    return out.T


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each stream the samples, and for each frame its first sample and its byte offset. Checks everything."""
    joined = np.frombuffer(b"".join(streams), np.uint8)
    bases = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    infos, pending = [], []
    for k, stream in enumerate(streams):
        if stream[:4] != b"fLaC":
            raise CorruptStream("no FLAC stream")
        at, last, info, points = 4, False, None, np.zeros(0, np.int64)
        while not last:
            last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
            body = stream[at + 4 : at + 4 + size]
            if kind == 0:
                info = (int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34])
            elif kind == 3:
                points = np.frombuffer(body, np.uint8).reshape(-1, 18)[:, 8:16].copy().view(">u8").ravel().astype(np.int64)
            at += 4 + size
        if info is None:
            raise CorruptStream("no stream information")
        infos.append((at, *info))
        first = points if len(points) and points[0] == 0 else np.zeros(1, np.int64)
        pending += [(k, int(p)) for p in first]
    frames: list[dict[int, tuple[np.ndarray, int]]] = [{} for _ in streams]
    while pending:
        starts = np.array([bases[k] + infos[k][0] + p for k, p in pending])
        samples, _, ends = decode_frames(joined, starts)
        following = []
        for (k, p), x, end in zip(pending, samples, ends.tolist()):
            frames[k][p] = (x, end - int(bases[k]) - infos[k][0])
        for k, p in pending:
            end = frames[k][p][1]
            if end not in frames[k] and end + infos[k][0] < bases[k + 1] - bases[k]:
                following.append((k, end))
        pending = following
    out = []
    for (_, total, digest), found in zip(infos, frames):
        offsets = np.array(sorted(found))
        samples = np.concatenate([found[p][0] for p in offsets.tolist()])
        if len(samples) != total or hashlib.md5(samples.astype(np.int8).tobytes()).digest() != digest:
            raise CorruptStream("samples do not match the stream information")
        firsts = np.cumsum([0, *(len(found[p][0]) for p in offsets.tolist())])[:-1]
        out.append((samples, np.stack([firsts, offsets], axis=1)))
    return out


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream."""
    reach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=CODED_AT_ONCE):
            data, offsets = flat(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(encode_payloads(data, offsets), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _media_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        start, held, size = 0, [], 0
        for k, media in enumerate(batch.column("media")):
            held.append(media.as_py())
            size += len(held[-1])
            if size >= CODED_AT_ONCE or k + 1 == batch.num_rows:
                yield batch.slice(start, len(held)), held
                start, held, size = k + 1, [], 0


def decode(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, sample_offsets, byte_offsets, pcm): each stream's PCM blocks, in order, and where each can be sought."""
    reach(stored.sparkSession)
    kept = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, streams in _media_chunks(batches):
            samples, places, pcm = [], [], []
            for whole, table in decode_streams(streams):
                bounds = [*table[:, 0].tolist(), len(whole)]
                octets = whole.astype(np.int8).tobytes()
                pcm.append([octets[a:b] for a, b in zip(bounds, bounds[1:])])
                samples.append(bounds[:-1])
                places.append(table[:, 1].tolist())
            yield pa.record_batch([*(part.column(c) for c in kept), pa.array(samples, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array(pcm, pa.list_(pa.binary()))], [*kept, "sample_offsets", "byte_offsets", "pcm"])

    sized = stored.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, sample_offsets array<long>, byte_offsets array<long>, pcm array<binary>")


def digest(decoded: DataFrame) -> DataFrame:
    """Digests of each stream's payload, made from its PCM blocks, and a feature of the samples.

    feature: samples, sum, energy, sign changes and peak of the signal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blocks in batch.column("pcm"):
                small = np.frombuffer(b"".join(blocks.values.to_pylist()), np.int8)
                payload, samples = (small.view(np.uint8) ^ 128).tobytes(), small.astype(np.int64)
                feature = f"{len(samples)}:{samples.sum()}:{(samples * samples).sum()}:{((small[1:] < 0) != (small[:-1] < 0)).sum()}:{np.abs(samples).max()}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_bytes")), *columns[:3], *(batch.column(c) for c in ("media_bytes", "media_sha256")), columns[3]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return decoded.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, pcm): a row for each PCM block."""
    zipped = F.arrays_zip("sample_offsets", "byte_offsets", "pcm")
    return decode(stored).select("doc_id", F.posexplode(zipped).alias("block", "b")).select("doc_id", F.col("block").cast("long").alias("block"), F.col("b.sample_offsets").alias("sample_offset"), F.col("b.byte_offsets").alias("byte_offset"), F.col("b.pcm").alias("pcm"))
