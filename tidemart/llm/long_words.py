"""Merging of very long words, where searching a whole list for every merge would be quadratic."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush
from typing import Any


def merge_by_heap(parts: list, join: Callable[[Any, Any], tuple[int, Any] | None]) -> list:
    """Join adjacent parts in the order of their ranks, the leftmost first among equal ranks.

    ``join(a, b)`` gives the rank and the joined part of a pair, or None. Parts form a linked list; the heap
    holds pairs with the parts they were made of, so that a pair that is gone is known by its parts.
    """
    parts = list(parts)
    left, right = [*range(-1, len(parts) - 1)], [*range(1, len(parts)), -1]
    heap = []
    for i in range(len(parts) - 1):
        found = join(parts[i], parts[i + 1])
        if found:
            heap.append((found[0], i, found[1], parts[i], parts[i + 1]))
    heapify(heap)
    while heap:
        _, i, joined, a, b = heappop(heap)
        j = right[i]
        if parts[i] is not a or j < 0 or parts[j] is not b:
            continue
        parts[i], parts[j] = joined, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] >= 0:
                found = join(parts[k], parts[right[k]])
                if found:
                    heappush(heap, (found[0], k, found[1], parts[k], parts[right[k]]))
    return [p for p in parts if p is not None]
