"""Word shingles, MinHash samples and odd sketches of whole texts, in NumPy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):  # A-Z as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Entry i: the polynomial sum over data[:i]; differences times a falling power hash any substring."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


#: Strings over so many bytes are named by xxhash: polynomial sums modulo 2**64 collide for whole families of
#: strings of a thousand bytes, whatever the base.
LONG, _SEED = 256, 0x5EED


def string_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit names of the byte strings [start, end), A-Z as a-z where total is of prefix_hash(data)."""
    _, down = powers(len(data))
    out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG):
        raw = data[start[i] : end[i]]
        out[i] = xxhash.xxh3_64_intdigest((raw + 32 * ((raw >= 65) & (raw <= 90)) if lower else raw).astype(np.uint8).tobytes(), _SEED)
    return out


def pieces(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, row after the last, bytes, text offsets in them. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ends are the texts' offsets. Words never cross texts."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate([[False], solid[:-1]])
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def _order(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Order by group, then by value: one sort of 64 bits, unless different values of a group begin with the same 40."""
    if len(of) and int(of.max()) < 1 << 24:
        key = (of.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))
        order = np.argsort(key)
        key, ordered = key[order], value[order]
        if not ((key[1:] == key[:-1]) & (ordered[1:] != ordered[:-1])).any():
            return order
    return np.lexsort((value, of))


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another, and their offsets.

    Words are compared with A-Z lower-cased. A text of fewer words than `size` has its whole sequence as one
    shingle, a text without words has none.
    """
    n = len(ends) - 1
    start, end, owner = words(data, ends)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = string_names(data, start, end, prefix_hash(data))
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    acc = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
    for j in range(size):
        acc += word[j : j + len(acc)] * _STEP[j]
    acc = mix(acc)
    inside = owner[: len(acc)] == owner[size - 1 : size - 1 + len(acc)]
    if len(word) < 200 * n:  # many small texts: all at once
        short = np.flatnonzero((count > 0) & (count < size))
        lone = np.array([int(mix((word[first[i] : first[i + 1]] * _STEP[8 : 8 + count[i]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count[i]))[0]) for i in short], dtype=np.uint64)
        value = np.concatenate([acc[inside], lone])
        of = np.concatenate([owner[: len(acc)][inside], short])
        order = _order(value, of)
        value, of = value[order], of[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        return value[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))]).astype(np.int64)
    out, offsets = [], np.zeros(n + 1, dtype=np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(acc[a : b - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mix((word[a:b] * _STEP[8 : 8 + b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            own = acc[:0]
        out.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return np.concatenate(out), offsets


class Sketcher:
    """MinHash samples (one multiply-shift function each) and their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def samples(self, sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per non-empty set one row of 64-bit minima; sets must all be non-empty."""
        at = offsets[:-1]
        out = np.empty((len(at), len(self.a)), dtype=np.uint64)
        for j in range(len(self.a)):
            out[:, j] = np.minimum.reduceat(sets * self.a[j] + self.b[j], at)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        s = mix(samples).reshape(len(samples), self.bands, self.rows)
        return mix((s * _STEP[: self.rows]).sum(axis=2, dtype=np.uint64)).view(np.int64)

#: Bins of the one-permutation MinHash samples and bits of the odd sketch that they are folded into.
BITS = 1024
#: Sets with fewer samples are kept whole; against larger ones they are screened by size alone.
SMALL = 48


def odd_sketches(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Of each non-empty sorted set: its size and number of samples, then the parity bitmap of its samples.

    A sample is the least hash of one of BITS equal ranges (one-permutation MinHash); every sample flips the
    bit that it is folded to. The XOR of two bitmaps is the odd sketch of the samples that only one set has.
    Sets with under SMALL samples have their hashes instead of a bitmap.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    cell = owner * BITS + (sets >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(sets), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    samples = np.bincount(owner[first], minlength=n)
    head = np.stack([np.diff(offsets), samples], axis=1).astype("<i8").tobytes()
    large = samples >= SMALL
    rank = np.cumsum(large) - 1
    use = first & large[owner]
    place = rank[owner[use]] * BITS + (mix(sets[use] + _STEP[40]) & np.uint64(BITS - 1)).astype(np.int64)
    parity = (np.bincount(place, minlength=int(large.sum()) * BITS) & 1).astype(np.uint8)
    bitmap, raw, wide = np.packbits(parity.reshape(-1, BITS), axis=1).tobytes(), sets.tobytes(), BITS // 8
    at, rank, large = (8 * offsets).tolist(), rank.tolist(), large.tolist()
    return [head[16 * i : 16 * i + 16] + (bitmap[rank[i] * wide : rank[i] * wide + wide] if large[i] else raw[at[i] : at[i + 1]]) for i in range(n)]


def open_sketches(odd: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Sizes, sample counts, bitmaps (as 64-bit words; zeros for small sets) and the hashes of small sets."""
    head = np.frombuffer(b"".join(x[:16] for x in odd), dtype="<i8").reshape(len(odd), 2)
    blank = bytes(BITS // 8)
    small = (head[:, 1] < SMALL).tolist()
    bits = np.frombuffer(b"".join(blank if s else x[16:] for s, x in zip(small, odd, strict=True)), dtype=np.uint64)
    hashes = [np.frombuffer(x, dtype=np.uint64, offset=16) if s else None for s, x in zip(small, odd, strict=True)]
    return head[:, 0].astype(np.float64), head[:, 1].astype(np.float64), bits.reshape(len(odd), BITS // 64), hashes


def similar_small(least: float, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which of all pairs of small sets reach the similarity: a matrix."""
    out = np.zeros((len(x), len(y)), dtype=bool)
    if not len(x) or not len(y):
        return out
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    value = np.unique(np.concatenate([*x, *y]), return_inverse=True)[1]
    width = int(value.max()) + 1
    a, b = np.zeros((len(x), width), dtype=np.float32), np.zeros((len(y), width), dtype=np.float32)
    a[np.repeat(np.arange(len(x)), nx), value[: nx.sum()]] = 1
    b[np.repeat(np.arange(len(y)), ny), value[nx.sum() :]] = 1
    common = a @ b.T
    return common >= least * (nx[:, None] + ny[None, :] - common) - 1e-6


def may_reach(least: float, differ: np.ndarray, na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """False where two sets surely have a similarity under `least`: by their sizes, or by the odd sketch.

    The bits in which the bitmaps differ give the number of samples that only one set has. At similarity
    `least` its expectation follows from the sizes of the sets and the numbers of their samples. What is
    found may exceed it by 4.5 standard deviations of the sampling (little where most of a set is sampled)
    and of the folding. Small sets pass.
    """
    occupied = lambda m: BITS * -np.expm1(m * np.log1p(-1 / BITS))
    union = (na + nb) / (1 + least)
    used = occupied(union)
    expected = (sa + sb) * (1 - 2 * least * used / np.maximum(occupied(na) + occupied(nb), 1))
    apart = -BITS / 2 * np.log(np.maximum(1 - 2 * differ / BITS, 1e-3))
    load = np.clip(expected / BITS, 0, 4)
    folding = BITS / 4 * (1 - np.exp(-4 * load) * (1 + 4 * load)) * np.exp(4 * load)
    sampling = 4 * used * least * (1 - least) * np.maximum(0.02, 1 - used / union)
    near = np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9
    return near & ((np.minimum(sa, sb) < SMALL) | (apart <= expected + 4.5 * np.sqrt(sampling + folding) + 2))


def set_names(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits that name each non-empty set, as two columns of integers."""
    count = np.diff(offsets).astype(np.uint64)
    a = np.add.reduceat(mix(sets), offsets[:-1]) ^ (count * np.uint64(_BASE))
    b = np.add.reduceat(mix(sets * _STEP[20] + _STEP[21]), offsets[:-1])
    return np.stack([a, b], axis=1).view(np.int64)
