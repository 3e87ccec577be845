"""Tries over sorted keys in range shards: which nodes neighbouring shards share.

Sorted keys (strings, or lists of ids) are cut into shards.  A prefix that stands in two shards
stands in all between them, is a prefix of the last key of each but the last, and of the
first key of each but the first.  So the first and last key of every shard tell which nodes are shared
and which shard has each of them first, before any shard is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

# Nodes of a shard are numbered below 2^40.
PLACES = 40


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # a[:low] == b[:low], a[:n] != b[:n]
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


@dataclass
class Border:
    """What a shard shares: ``before`` with the one before it, ``after`` with the next.

    Each is the shared prefix; ``owners`` has for each of its depths (from 1) the shard that has it first.
    ``first`` and ``final`` tell that no shard comes before, or after.
    """

    before: Sequence = ()
    before_owners: list[int] = field(default_factory=list)
    after: Sequence = ()
    after_owners: list[int] = field(default_factory=list)
    first: bool = True
    final: bool = True


def borders(ends: Iterable[tuple[int, Sequence, Sequence]]) -> dict[int, Border]:
    """Borders of shards, given (shard, first key, last key) in the order of the shards."""
    found: dict[int, Border] = {}
    known = None
    for shard, first, last in ends:
        own = found[shard] = Border()
        if known:
            left, left_first, left_last = known
            size = common(left_last, first)
            same = common(left_first, left_last)
            left_own = found[left]
            inherited = min(same, len(left_own.before_owners), size)
            left_own.after = own.before = first[:size]
            left_own.after_owners = left_own.before_owners[:inherited] + [left] * (size - inherited)
            own.before_owners = left_own.after_owners
            own.first = left_own.final = False
        known = shard, first, last
    return found


def shared_node(owner: int, depth: int) -> int:
    """The number of a node that several shards have; only one shared node has its owner and depth."""
    return -((owner << PLACES) + depth)
