"""Two-stage suffix sorting: suffixes smaller than their successors are sorted, the others follow from bucket scans."""

from __future__ import annotations

import numpy as np
import xxhash

#: Parts are followed by GAP: 0xFF stands in no UTF-8 text, and 0x00 before a part or END is smaller than its successor.
GAP, END = b"\xff\x00", b"\xff\x00\x01"
#: Bytes of the longest strings that are compared in suffix order.
DEPTH = 4096


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next position's; the last one counts as larger."""
    out = np.zeros(len(t), dtype=bool)
    np.less(t[:-1], t[1:], out=out[:-1])
    same = np.flatnonzero(t[:-1] == t[1:])
    if len(same):
        # in a run of equal bytes the byte after the run decides
        last = np.flatnonzero(np.concatenate([np.diff(same) > 1, [True]]))
        out[same] = np.repeat(out[same[last] + 1], np.diff(np.concatenate([[-1], last])))
    return out


def _sorted_directly(text: bytes, t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """at in the order of the suffixes' first depth bytes; one bucket of equal first two bytes is spelled out at a time."""
    pair = t[at].astype(np.uint16) << np.uint16(8) | t[at + 1]
    at = at[np.argsort(pair, kind="stable")]
    pair.sort()
    cuts = np.flatnonzero(np.diff(pair)) + 1
    out = []
    for bucket in np.split(at, cuts):
        if len(bucket) > 1:
            own = bucket.tolist()
            # latin-1 strings compare as their bytes do
            keys = [text[i + 2 : i + depth].decode("latin-1") for i in own]
            bucket = bucket[np.array(sorted(range(len(own)), key=keys.__getitem__), dtype=np.int32)]
        out.append(bucket)
    return np.concatenate(out) if out else at


def two_stage_order(text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``wanted`` (a mask), sorted by their suffixes' first ``depth`` bytes at least.

    Direct sorting covers the wanted suffixes that are smaller than their successors, and the first such position after each run of other wanted ones; a larger suffix stands in its first byte's bucket before all smaller ones, in the order in which the scan of the finished buckets meets its successor.
    """
    t = np.frombuffer(text, np.uint8)
    small = smaller_than_next(t)
    need = wanted.copy()
    # a larger suffix is induced by its successor, up to the next smaller one
    edge = np.flatnonzero(need[:-1] & ~small[:-1] & ~need[1:]) + 1
    while len(edge):
        need[edge] = True
        edge = edge[~small[edge] & (edge + 1 < len(t))] + 1
        edge = edge[~need[edge]]
    direct = _sorted_directly(text, t, np.flatnonzero(need & small).astype(np.int32), depth)
    first = t[direct]
    bounds = np.searchsorted(first, np.arange(257))
    fed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = []
        new = np.concatenate(fed[c]) if fed[c] else np.zeros(0, dtype=np.int32)
        while len(new):  # equal bytes in a row: the bucket feeds itself
            parts.append(new)
            before = new[new > 0] - 1
            new = before[need[before] & ~small[before] & (t[before] == c)]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        fed[c] = []
        out.append(bucket[wanted[bucket]])
        before = bucket[bucket > 0] - 1
        before = before[need[before] & ~small[before] & (t[before] > c)]
        if len(before):
            head = t[before]
            order = np.argsort(head, kind="stable")
            before, head = before[order], head[order]
            cuts = np.flatnonzero(np.diff(head)) + 1
            for piece in np.split(before, cuts):
                fed[t[piece[0]]].append(piece)
    return np.concatenate(out)


def repeated(text: bytes, size: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Mask of the positions whose string (size bytes there, 0: none is looked for) stands at another such position too, by the common prefixes of neighbours in suffix order.

    Equal strings are neighbours if they all have the same length, or if each is followed by a byte that is smaller than any within it can be at its place. Strings of more than ``depth`` bytes are compared by 128-bit hashes among themselves, so that no key of the sort is longer than that.
    """
    hit = np.zeros(len(text), dtype=bool)
    order = two_stage_order(text, (size > 0) & (size <= depth), min(depth, int(size.max(initial=0))) + 1)
    for k in range(0, len(order) - 1, 100_000):
        part = order[k : k + 100_001]
        at, n = part.tolist(), size[part]
        same = n[1:] == n[:-1]
        same[same] = [text[at[i] : at[i] + m] == text[at[i + 1] : at[i + 1] + m] for i, m in zip(np.flatnonzero(same).tolist(), n[1:][same].tolist(), strict=True)]
        hit[part[:-1][same]] = True
        hit[part[1:][same]] = True
    long: dict[bytes, list[int]] = {}
    for p in np.flatnonzero(size > depth).tolist():
        long.setdefault(xxhash.xxh3_128_digest(text[p : p + int(size[p])]), []).append(p)
    for places in long.values():
        if len(places) > 1:
            hit[places] = True
    return hit
