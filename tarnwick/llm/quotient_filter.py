"""Counting quotient filters in numpy: packed, sorted, mergeable without loss.

A 64-bit fingerprint is split into a quotient (its high bits, which pick the canonical slot) and a remainder.
A filter stores, in slot order,

* ``occupied``: one bit for each quotient of its range, set where the quotient has a run,
* ``run_end``: one bit for each stored remainder, set on the last of its run,
* the remainders, ascending within a run, in as many bytes as they need,
* a counter for each remainder, one byte with an escape list for counts of 255 and above.

Since runs are in quotient order and remainders ascend in a run, two filters merge as two sorted lists do; counters
of equal remainders add up.  Nothing is approximate here but that a fingerprint stands for a text.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQIII")


def counted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their summed counts."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
    return fingerprints[first], np.add.reduceat(counts, first)


def pack(fingerprints: np.ndarray, counts: np.ndarray, low: int, span_bits: int) -> bytes:
    """A filter for sorted distinct fingerprints in ``[low, low + 2**span_bits)``; about one quotient a fingerprint."""
    n = len(fingerprints)
    quotient_bits = min(span_bits, max(1, int(n - 1).bit_length()))
    remainder_bits = span_bits - quotient_bits
    offset = fingerprints - np.uint64(low)
    quotient = (offset >> np.uint64(remainder_bits)) if remainder_bits < 64 else np.zeros(n, np.uint64)
    remainder = offset & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient.astype(np.int64)] = True
    run_end = np.r_[quotient[1:] != quotient[:-1], np.ones(min(n, 1), bool)]
    width = max(1, -(-remainder_bits // 8))
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    large = np.flatnonzero(counts >= 255)
    return b"".join(
        (
            _HEAD.pack(low, n, span_bits, quotient_bits, len(large)),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            np.ascontiguousarray(slots).tobytes(),
            np.minimum(counts, 255).astype(np.uint8).tobytes(),
            large.astype("<u8").tobytes(),
            counts[large].astype("<u8").tobytes(),
        )
    )


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    low, n, span_bits, quotient_bits, n_large = _HEAD.unpack_from(block)
    remainder_bits, at = span_bits - quotient_bits, _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(block, np.uint8, size, at)
        at += size
        return part

    occupied = np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits)
    run_end = np.unpackbits(take(-(-n // 8)), count=n)
    width = max(1, -(-remainder_bits // 8))
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = take(n * width).reshape(n, width)
    counts = take(n).astype(np.int64)
    large = take(8 * n_large).copy().view("<u8").astype(np.int64)
    counts[large] = take(8 * n_large).copy().view("<u8").astype(np.int64)
    run = np.cumsum(np.r_[0, run_end[:-1]]) if n else np.zeros(0, np.int64)
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    high = quotient << np.uint64(remainder_bits) if remainder_bits < 64 else quotient * np.uint64(0)
    return high + slots.view("<u8").reshape(n).astype(np.uint64) + np.uint64(low), counts


def merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Merge filters of one range by their sorted remainders, two by two."""
    parts = [unpack(b) for b in blocks]
    while len(parts) > 1:
        paired = [counted(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(parts[::2], parts[1::2])]
        parts = paired + (parts[-1:] if len(parts) % 2 else [])
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
