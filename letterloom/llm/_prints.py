"""Fingerprints of spans, content-defined anchors, words: the arithmetic that deduplication shares.

There are two kinds. *Prints* (:func:`join` and what is built on it) are cheap and public: whoever knows them can build texts that share one, so they
only choose anchors and bring together what is then compared. What decides that two texts are the same is the bytes themselves, or
:func:`digests` and :func:`word_prints`, which hash the bytes under a key that is drawn for each run (or index) and is not known beforehand.
"""

from __future__ import annotations

import os

import numpy as np
import xxhash

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32  # A-Z folded to a-z
#: Which bytes separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What keeps the first n of eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: The first 56 bytes of the secret of XXH3, as numbers.
SECRET = [0xBE4BA423396CFEB8, 0x1CAD21F72C81017C, 0xDB979083E96DD4DE, 0x1F67B3B7A4A44072, 0x78E5C0CC4EE679CB, 0x2172FFCC7DD05A82, 0x8E2443F7744608B8]


#: A digest of 128 bits; compares as a whole, zeros at the end included.
DIGEST = np.dtype("S16")


def new_key() -> int:
    return int.from_bytes(os.urandom(8))


def digests(text: bytes, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """The keyed 128-bit hashes of the bytes of spans, as two columns of 64 bits each."""
    digest = xxhash.xxh3_128_digest
    out = b"".join([digest(text[a:b], key) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, ">u8").astype(U).reshape(-1, 2)


def word_prints(text: bytes, offsets: np.ndarray, key: int) -> np.ndarray:
    """The keyed 64-bit hashes of all words, document by document: joins of these can't be steered by whoever does not know the key."""
    data = np.frombuffer(text, np.uint8)
    return prints_of(data, *words(data, offsets)[:2], key)


def prints_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """The 64-bit XXH3 under the seed ``key`` of all spans; those of up to 16 bytes by arithmetic on whole arrays, as nearly all words are so short."""
    n = end - start
    out, eight, flip = np.zeros(len(n), U), Eights(data), [U(x % (1 << 64)) for x in flips(key)]
    some = np.flatnonzero((n >= 1) & (n <= 3))
    a, length = start[some], n[some]
    x = data[a].astype(U) << U(16) | data[a + length // 2].astype(U) << U(24) | data[a + length - 1].astype(U) | length.astype(U) << U(8)
    x ^= flip[0]
    out[some] = shifted(shifted(shifted(x, 33) * U(0xC2B2AE3D27D4EB4F), 29) * U(0x165667B19E3779F9), 32)
    some = np.flatnonzero((n >= 4) & (n <= 8))
    a, length, low = start[some], n[some], U(0xFFFFFFFF)
    first = eight[a]
    x = (first & low) << U(32)
    x += first >> (U(8) * (length.astype(U) - U(4))) & low
    x ^= flip[1]
    x ^= (x << U(49) | x >> U(15)) ^ (x << U(24) | x >> U(40))
    x *= U(0x9FB21C651E98DF25)
    x ^= (x >> U(35)) + length.astype(U)
    x *= U(0x9FB21C651E98DF25)
    out[some] = shifted(x, 28)
    some = np.flatnonzero((n >= 9) & (n <= 16))
    a, length = start[some], n[some]
    x = eight[a] ^ flip[2]
    y = eight[a + length - 8] ^ flip[3]
    mixed = length.astype(U) + x.byteswap() + y + (x * y ^ high(x, y))
    out[some] = shifted(shifted(mixed, 37) * U(0x165667919E3779F9), 32)
    some, digest = np.flatnonzero(n > 16), xxhash.xxh3_64_digest
    if len(some):
        text = data.tobytes()
        out[some] = np.frombuffer(b"".join([digest(text[a:b], key) for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]), ">u8")
    return out


def flips(key: int) -> list[int]:
    """What XXH3 lays over spans of up to 3, 8 and 16 bytes (two numbers) under a seed."""
    s, swapped = SECRET, int.from_bytes((key & 0xFFFFFFFF).to_bytes(4), "little")
    return [(s[0] & 0xFFFFFFFF ^ s[0] >> 32) + key, (s[1] ^ s[2]) - (key ^ swapped << 32), (s[3] ^ s[4]) + key, (s[5] ^ s[6]) - key]


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    return x ^ x >> U(by)


def high(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper 64 bits of the products."""
    half, low = U(32), U(0xFFFFFFFF)
    a, b, c, d = x >> half, x & low, y >> half, y & low
    middle = (b * d >> half) + (a * d & low) + b * c
    return a * c + (a * d >> half) + (middle >> half)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a >> U(32)
    x ^= a
    x *= ODD
    x += b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros stand beyond the end."""
    n = len(data)
    held = np.zeros(n + 16, np.uint8)
    held[:n] = data
    out = np.empty(n, U)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(held, U, len(range(k, n, 8)), k)
    return out


class Eights:
    """What :func:`eights` gives, put together only where it is asked for."""

    def __init__(self, data: np.ndarray):
        self.n, self.view = len(data), np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.view[at].view(U).ravel()


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in their order: a plain sort, which is faster here than :func:`numpy.unique`."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every k consecutive symbols, by doubling and one overlapping join."""
    if len(symbols) < k:
        return symbols[:0]
    h, m = symbols, 1
    while 2 * m <= k:
        h, m = join(h[:-m], h[m:]), 2 * m
    h = join(h[: len(h) - (k - m)], h[k - m :]) if m < k else h
    return h if k > 1 else join(h, np.ones_like(h))


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """The same for bytes, k a multiple of eight: begins with eight bytes at once."""
    h, m = eights(data), 8
    if len(h) < k:
        return h[:0]
    h = h[: len(h) - 7]
    while 2 * m <= k:
        h, m = join(h[:-m], h[m:]), 2 * m
    return join(h[: len(h) - (k - m)], h[k - m :]) if m < k else h


def spans(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans ``[start, end)``, from :func:`eights`; up to eight bytes they are one to one at each length."""
    n = end - start
    out = np.zeros(len(n), U)
    some = np.flatnonzero(n > 0)
    out[some] = eight[start[some]] & FIRST[np.minimum(n[some], 8)]
    out = join(out, n.astype(U))
    left, at = np.flatnonzero(n > 8), 8
    while len(left):
        # The last step may overlap the one before it.
        out[left] = join(out[left], eight[np.minimum(start[left] + at, end[left] - 8)])
        at += 8
        left = left[n[left] > at]
    return out


def unequal(eight: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans differ from their ``other`` (a place in the same arrays), byte by byte."""
    n = end - start
    out = n != n[other]
    short = FIRST[np.minimum(n, 8)]
    out |= (eight[np.minimum(start, len(eight) - 1)] ^ eight[np.minimum(start[other], len(eight) - 1)]) & short != 0 if len(eight) else False
    left, at = np.flatnonzero((n > 8) & ~out), 8
    while len(left):
        step = np.minimum(at, n[left] - 8)
        out[left] = eight[start[left] + step] != eight[start[other[left]] + step]
        at += 8
        left = left[(n[left] > at) & ~out[left]]
    return out


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct spans in the order of their prints: prints, one place of each, and of every span the number of the one that it equals.

    Prints only find what may be equal: every span is compared with the one that stands for it, byte by byte.
    """
    eight = Eights(data)
    prints = spans(eight, start, end)
    held, some, number = np.unique(prints, return_index=True, return_inverse=True)
    odd = np.flatnonzero(unequal(eight, start, end, some[number]))
    if len(odd):  # one print, several texts: these get numbers of their own
        new: dict[bytes, int] = {}
        for i in odd.tolist():
            number[i] = len(some) + new.setdefault(data[start[i] : end[i]].tobytes(), len(new))
        some = np.r_[some, odd[np.unique(number[odd], return_index=True)[1]]]
        order = np.argsort(prints[some], kind="stable")
        held, some, number = prints[some][order], some[order], np.argsort(order)[number]
    return held, some, number


def stretches(gram: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of spans of k symbols and more, from those of every k; the last may overlap the one before it."""
    out = join((end - start).astype(U), gram[start])
    left, at = np.flatnonzero(end - start > k), k
    while len(left):
        out[left] = join(out[left], gram[np.minimum(start[left] + at, end[left] - k)])
        at += k
        left = left[(end - start)[left] > at]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima in both directions."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, U)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored(gram: np.ndarray, k: int, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``window`` symbols that lie in one document, as runs that share an anchor.

    ``gram`` has the fingerprints of every k symbols. The anchor of a window is the least of its grams (leftmost on ties), so equal windows
    have equal anchors at equal distances, wherever they stand. Returns for each run its first and last window start and the
    place of its anchor. About 2 runs begin in each window's length.
    """
    none = np.zeros(0, np.int64)
    if len(gram) < window - k + 1:
        return none, none, none
    at = sliding_min((gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U), window - k + 1)
    at = (at & U(0xFFFFFFFF)).astype(np.int64)
    step = np.zeros(len(at) + 1, np.int32)
    a, b = offsets[:-1], offsets[1:] - window + 1
    ok = b > a
    np.add.at(step, a[ok], 1)
    np.add.at(step, b[ok], -1)
    starts = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    if not len(starts):
        return none, none, none
    anchor = at[starts]
    cut = np.flatnonzero((starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])) + 1
    return starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]], anchor[np.r_[0, cut]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes of some documents, and each document's first word (``n + 1`` positions)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a stretch of ``length`` that begins at one of ``starts`` (distinct)."""
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    np.subtract.at(step, np.minimum(starts + length, n), 1)
    return np.cumsum(step[:n]) > 0


def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``[a, b)``, one after another."""
    n = b - a
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
