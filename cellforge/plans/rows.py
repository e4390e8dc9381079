"""The automaton of connected placements, one step per row of the board.

A node says which cells of the last row are filled and which of them hang together through the rows above. It is
built in plain Python on the driver, since its size depends on the board's width alone (a few hundred nodes at width 7), and
goes to the cluster as a table of edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

#: A node: for every cell of the row 0 or the number of its group, groups numbered from the left; or one of the two ends.
Node = tuple[int, ...]
BEFORE, AFTER = (-1,), (-2,)


@dataclass(frozen=True)
class Edge:
    src: int
    row: int  # the row's cells as bits
    dst: int
    dchi: int  # what the row adds to corners - edges + cells


@dataclass(frozen=True)
class Automaton:
    width: int
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    start: int
    done: tuple[int, ...]  # nodes with exactly one group, or after the shape


def _groups(last: Node, row: int, width: int) -> Node | None:
    """The node that follows, or None where a group would be cut off."""
    filled = [bool(row >> c & 1) for c in range(width)]
    if last in (BEFORE, AFTER):
        last = (0,) * width
    parent = list(range(width + max(last, default=0) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for c in range(width):
        if filled[c] and c and filled[c - 1]:
            parent[root(c)] = root(c - 1)
        if filled[c] and last[c]:
            parent[root(c)] = root(width + last[c])
    held = {root(c) for c in range(width) if filled[c]}
    if any(root(width + k) not in held for k in set(last) - {0}):
        return None
    numbers: dict[int, int] = {}
    return tuple(numbers.setdefault(root(c), len(numbers) + 1) if filled[c] else 0 for c in range(width))


def _added(last: int, row: int) -> int:
    """What a row adds to corners - edges + cells below a row with the cells ``last``."""
    corners, above = row | row << 1, last | last << 1
    new_corners = (corners & ~above).bit_count() + corners.bit_count()
    new_edges = (row & ~last).bit_count() + row.bit_count() + corners.bit_count()
    return new_corners - new_edges + row.bit_count()


@lru_cache(maxsize=None)
def automaton(width: int) -> Automaton:
    """All nodes that can be reached on a board of this width, and all rows that lead on from them."""
    if width < 1:
        raise ValueError("the width must be at least 1")
    numbers: dict[Node, int] = {BEFORE: 0, AFTER: 1}
    open_, edges = [BEFORE, AFTER], []
    while open_:
        node = open_.pop()
        bits = sum(1 << c for c, k in enumerate(node) if k > 0)
        for row in range(1 << width):
            if node == BEFORE:
                after = _groups(node, row, width) if row else BEFORE
            elif node == AFTER:
                after = None if row else AFTER
            elif row:
                after = _groups(node, row, width)
            else:
                after = AFTER if max(node) == 1 else None
            if after is None:
                continue
            if after not in numbers:
                numbers[after] = len(numbers)
                open_.append(after)
            edges.append(Edge(numbers[node], row, numbers[after], _added(bits, row)))
    nodes = tuple(sorted(numbers, key=numbers.__getitem__))
    done = tuple(i for i, n in enumerate(nodes) if n == AFTER or n != BEFORE and max(n) == 1)
    return Automaton(width, nodes, tuple(edges), 0, done)
