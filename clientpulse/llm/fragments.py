"""Hashed items dealt to fragments of the hash space.

A task packs what it has gathered, one row per fragment of the items' range, so that a
shuffle moves a few large rows in place of one small row per item. An item counts once
per pack however often the pack holds it, so a frequent item adds at most one entry per
pack to its fragment, and fragments are of even size whatever the items are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Items that a fragment is meant to hold.
FRAGMENT_ITEMS = 1 << 20
#: Items of one pack.
PACK_ITEMS = 1 << 20
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 20


def fragment_count(items: int) -> int:
    return max(1, -(-int(items) // FRAGMENT_ITEMS))


def fragment_of(items: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are ranges: sorted items are in the order of their fragments."""
    return ((items >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def slices_of(fragment: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(fragment, first, end) of each run of a sorted array."""
    if len(fragment):
        edges = np.flatnonzero(np.diff(fragment)) + 1
        for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(fragment)]):
            yield int(fragment[first]), first, end


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def chunks_of(raw: bytes, is_break: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts of about ``size`` that end behind a break; a run without
    breaks stays whole."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            window = data[end : end + size]
            found = np.flatnonzero(is_break[window])
            if len(found):
                end += int(found[0]) + 1
                break
            end += len(window)
        yield at, data[at:end]
        at = end
