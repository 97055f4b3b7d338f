"""Wide SimHash fingerprints and their anchors, for texts that are merely alike.

At a Jaccard similarity of 0.8 some 15 % of the bits of two SimHash fingerprints
differ. A code whose anchors cover all pairs that far apart would need thousands
of copies of each fingerprint, so here the anchors are the codewords of products
of biorthogonal codes (first-order Reed-Muller codes, 2 * ``LENGTH`` words each,
the nearest found by a Hadamard transform), in ``TABLES`` rotations. A
fingerprint is copied to its nearest anchor in each rotation, and to the second
nearest. By simulation, texts at 0.8 then meet at one anchor or more with a
probability of 0.98, from 0.83 on above 0.99; texts that have nothing in common
meet in one of 2^15 cases. ``PARTS`` should grow with the logarithm of the
number of texts (4 from about 10^8 on), so that such meetings stay rare.

Rotations work on the counts behind the bits (how many more shingles set a bit
than not), which say more than the bits. Fingerprints that meet are compared on
all ``WIDE`` bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bits of a fingerprint.
WIDE = 512
#: Length of one biorthogonal code, codes in an anchor, rotations.
LENGTH, PARTS, TABLES = 64, 3, 16
#: Groups at one anchor up to SMALL are compared pair by pair; over SPLIT they are divided by further rotations first.
SMALL, SPLIT, FURTHER = 24, 2048, 8
SEED = 42
#: What makes further 64-bit hashes of one.
LANES = (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def bits_at(similarity: float) -> int:
    """Bits up to which fingerprints link: those that differ on average at this Jaccard similarity of equally long texts, and one standard deviation more."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(WIDE * p + math.sqrt(WIDE * p * (1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counts(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """(128-bit hash of the words, counts): by bit, how many more distinct shingles set it than not.

    Words are runs without the six ASCII blanks, A-Z in lower case; fewer words
    than a shingle are one shingle, no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    whole = xxhash.xxh3_128_digest(line, SEED)
    if not words:
        return whole, np.zeros(WIDE, np.int32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh3_64_intdigest
    n = min(shingle, len(words))
    h = np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=False)), np.uint64))
    ones = np.zeros(WIDE, np.int32)
    for i in range(0, len(h), 255):
        lanes = _mix(h[i : i + 255, None] + LANES).astype("<u8", copy=False).view(np.uint8)
        # At most 255 ones a bit, which a byte holds.
        ones += np.add.reduce(np.unpackbits(lanes, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return whole, 2 * ones - len(h)


def bits_of(ones: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of ``WIDE`` / 64 longs) of rows of counts."""
    return np.packbits(ones > 0, axis=1, bitorder="little").view("<u8")


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x


def nearest(vectors: np.ndarray, codes: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``codes`` biorthogonal codes: nearest word, second nearest, and by how much the first is nearer."""
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (codes * LENGTH // WIDE + 1, 2, WIDE))
    made, rows = 0, np.arange(len(vectors))
    for first, second in signs:
        turned = _hadamard(_hadamard(vectors * first) * second)
        for b in range(WIDE // LENGTH):
            if made == codes:
                return
            x = turned[:, b * LENGTH : (b + 1) * LENGTH]
            a = np.abs(x)
            one = a.argmax(axis=1)
            most = a[rows, one].copy()
            a[rows, one] = -1
            two = a.argmax(axis=1)
            yield 2 * one + (x[rows, one] > 0), 2 * two + (x[rows, two] > 0), most - a[rows, two]
            made += 1


def anchors(ones: np.ndarray) -> np.ndarray:
    """For rows of counts, 2 * ``TABLES`` anchors each: the nearest in each rotation, and the second nearest."""
    vectors = ones.astype(np.float32)
    found = list(nearest(vectors, TABLES * PARTS, SEED))
    out = np.zeros((len(ones), 2 * TABLES), np.int64)
    for t in range(TABLES):
        first, second, margin = (np.stack(x, axis=1) for x in zip(*found[t * PARTS : (t + 1) * PARTS], strict=True))
        weak = margin.argmin(axis=1)
        other = first.copy()
        other[np.arange(len(ones)), weak] = second[np.arange(len(ones)), weak]
        for k, words in enumerate((first, other)):
            anchor = np.full(len(ones), t, np.int64)
            for part in words.T:
                anchor = anchor * (2 * LENGTH) + part
            out[:, 2 * t + k] = anchor
    return out


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= bits


def spanning(node: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all links within one anchor's group connect.

    Breadth-first from a seed: each row is compared with those not yet reached,
    so at most one link a row comes out. Groups over ``SPLIT`` are first divided
    by the nearest codewords of ``FURTHER`` rotations of their bits.
    """
    if len(node) > SPLIT:
        signs = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        for first, second, _ in nearest(signs, FURTHER, SEED + 1):
            key, at = np.concatenate([first, second]), np.tile(np.arange(len(node)), 2)
            order = np.argsort(key, kind="stable")
            for group in np.split(at[order], np.flatnonzero(np.diff(key[order])) + 1):
                yield from _reach(node[group], fps[group], bits)
        return
    yield from _reach(node, fps, bits)


def _reach(node: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    left = np.arange(len(node))
    while len(left) > 1:
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            x = seeds.pop()
            hit = near(fps[left], fps[x], bits)
            if hit.any():
                found = left[hit]
                yield np.full(len(found), node[x]), node[found]
                seeds += list(found)
                left = left[~hit]


def links_at_anchors(anchor: np.ndarray, node: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows in order of anchor; groups are whole."""
    n = len(anchor)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    size = end - begin
    for g in np.flatnonzero(size > SMALL):
        yield from spanning(node[begin[g] : end[g]], fps[begin[g] : end[g]], bits)
    small = np.repeat(size <= SMALL, size)
    anchor, node, fps = anchor[small], node[small], fps[small]
    k, at = 1, np.arange(max(0, len(anchor) - 1))
    while len(at):
        at = at[at + k < len(anchor)]
        at = at[anchor[at] == anchor[at + k]]
        hit = at[near(fps[at], fps[at + k], bits)]
        if len(hit):
            yield node[hit], node[hit + k]
        k += 1
