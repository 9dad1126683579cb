"""Merging sorted shards of strings by interleave refinement.

Every shard holds its strings (suffixes that begin at marked places) in sorted
order. What is merged is the interleave alone: for each place of the merged
order, the shard whose next string stands there. It starts from the groups of the
strings and is refined one symbol at a time. Inside a block of strings that agree
so far, places are dealt stably by the symbol that their string has next, and
where a block splits, the common prefix of the neighbours is known. Which string
a place holds follows from the shard's own order, so no shard is sorted anew, and
shards that aren't sorted give a wrong order. Blocks of one string are settled
and not touched again.
"""

from __future__ import annotations

import numpy as np


def merge(shard: np.ndarray, group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows in merged order, and each one's common prefix with the one before.

    Rows lie shard after shard (``shard`` ascending), each shard's rows sorted by
    (group, string). ``common`` is -1 where a group begins and the strings' width
    where neighbours are equal.
    """
    n, width = strings.shape
    lanes = np.cumsum(np.concatenate([[0], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
    lanes = lanes.astype(np.int16 if n < 1 << 15 else np.int32)
    z = lanes[np.argsort(group, kind="stable")]

    def held() -> np.ndarray:
        """The row at each place: a shard's k-th place holds its k-th row."""
        out = np.empty(n, np.int64)
        out[np.argsort(z, kind="stable")] = np.arange(n)
        return out

    order = held()
    g = group[order]
    first = np.ones(n, bool)
    first[1:] = g[1:] != g[:-1]
    common = np.where(first, -1, width)
    block = np.cumsum(first)
    at = np.arange(n)
    for depth in range(width):
        # settled blocks leave
        alone = np.ones(len(at), bool)
        alone[1:] &= block[1:] != block[:-1]
        alone[:-1] &= block[:-1] != block[1:]
        at, block = at[~alone], block[~alone]
        if not len(at):
            break
        key = block * 256 + strings[order[at], depth]
        if (key[1:] < key[:-1]).any():
            deal = np.argsort(key, kind="stable")
            z[at] = z[at][deal]
            order, key = held(), key[deal]
        split = np.zeros(len(at), bool)
        split[1:] = (key[1:] != key[:-1]) & (block[1:] == block[:-1])
        common[at[split]] = depth
        change = np.ones(len(at), bool)
        change[1:] = key[1:] != key[:-1]
        block = np.cumsum(change)
    return order, common


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row a number that is equal for rows of a group that agree in their first ``depth`` symbols."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out
