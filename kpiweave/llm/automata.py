"""Small byte regexes to minimal deterministic automata with transition arrays.

A pattern is compiled by the textbook way: syntax tree, automaton with empty moves,
subset construction, and minimisation by refining a partition. Patterns are ASCII:
literals, escapes, classes, groups, ``(?i:...)``, ``|`` and the quantifiers ``? * + {m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


@dataclass(frozen=True)
class Scanner:
    """Transitions ``step[state * width + kind_of[byte]]`` (states are premultiplied); state 0 is the start.

    ``accepts[state]`` has a bit for each rule that accepts; ``dead`` is the state without a way on, or -1.
    """

    kind_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    width: int
    dead: int

    @property
    def states(self) -> int:
        return len(self.accepts)


def parse(pattern: str):
    """Syntax tree of tuples: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""
    at = 0

    def escaped() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(pattern[at - 1], pattern[at - 1]))

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escaped()
        at += 1
        return ord(pattern[at - 1])

    def either_case(byte: int, fold: bool) -> frozenset[int]:
        return frozenset(map(ord, {chr(byte).lower(), chr(byte).upper()})) if fold and byte < 128 else frozenset((byte,))

    def atom(fold: bool):
        nonlocal at
        if pattern[at] == "(":
            at += 1
            if pattern.startswith("?i:", at):
                at, fold = at + 3, True
            elif pattern.startswith("?:", at):
                at += 2
            inner = union(fold)
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            negated = pattern[at] == "^"
            at += negated
            found: set[int] = set()
            while pattern[at] != "]":
                low = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    found.update(range(low, one() + 1))
                else:
                    found.add(low)
            at += 1
            return ("set", ANY - found if negated else frozenset(found))
        if pattern[at] == ".":
            at += 1
            return ("set", ANY - {10})
        return ("set", either_case(one(), fold))

    def series(fold: bool):
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom(fold)
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index("}", at)
                    least, _, most = pattern[at + 1 : end].partition(",")
                    bounds = (int(least), int(most) if most else None if "," in pattern[at:end] else int(least))
                    at = end
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
                part = ("rep", part, *bounds)
                at += 1
            parts.append(part)
        return ("cat", parts)

    def union(fold: bool):
        nonlocal at
        parts = [series(fold)]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(series(fold))
        return ("or", parts)

    tree = union(False)
    if at != len(pattern):
        raise ValueError(f"cannot read the pattern from {pattern[at:]!r}")
    return tree


def reverse(tree):
    """The tree of the mirrored texts."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return (tree[0], [reverse(x) for x in (tree[1][::-1] if tree[0] == "cat" else tree[1])])


class _Moves:
    """An automaton with empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def new(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, tree, start: int) -> int:
        """Moves for the tree from ``start``; the state where it ends."""
        if tree[0] == "set":
            end = self.new()
            self.on[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.new()
        if tree[0] == "or":
            for part in tree[1]:
                first = self.new()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.new()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(most - least):
                self.empty[start].append(end)
                start = self.add(part, start)
            self.empty[start].append(end)
        return end


def compile_rules(patterns: list[str], *, anywhere: bool, mirrored: bool = False) -> Scanner:
    """One automaton for all patterns; bit i of ``accepts`` is pattern i.

    ``anywhere``: a match may begin at each byte. ``mirrored``: for reading right to left.
    """
    moves = _Moves()
    root, ends = moves.new(), {}
    if anywhere:
        moves.on[root].append((ANY, root))
    for i, pattern in enumerate(patterns):
        tree = parse(pattern)
        first = moves.new()
        moves.empty[root].append(first)
        ends[moves.add(reverse(tree) if mirrored else tree, first)] = 1 << i

    # Bytes that no set tells apart are one kind.
    sets = sorted({s for on in moves.on for s, _ in on}, key=sorted)
    marks = np.zeros((256, len(sets)), bool)
    for k, s in enumerate(sets):
        marks[sorted(s), k] = True
    kinds, kind_of = np.unique(marks, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1).astype(np.uint8)
    column = {s: k for k, s in enumerate(sets)}

    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for x in moves.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closures[state] = frozenset(x for x in seen if moves.on[x] or x in ends)
        return closures[state]

    number = {closure(root): 0}
    todo, step = [closure(root)], []
    while len(step) < len(todo):
        here = todo[len(step)]
        targets: list[set[int]] = [set() for _ in range(len(kinds))]
        for state in here:
            for s, to in moves.on[state]:
                for kind in np.flatnonzero(kinds[:, column[s]]):
                    targets[kind] |= closure(to)
        row = []
        for target in map(frozenset, targets):
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
        step.append(row)
    accepts = np.array([sum({ends.get(x, 0) for x in here}) for here in todo], np.int64)
    return _minimal(np.array(step, np.int64), accepts, kind_of)


def _minimal(step: np.ndarray, accepts: np.ndarray, kind_of: np.ndarray) -> Scanner:
    """States that no continuation tells apart become one."""
    part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    order = np.argsort(first, kind="stable")  # the start stays 0
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    part, first = rank[part], first[order]
    small = part[step[first]]
    width = step.shape[1]
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (accepts[first] == 0))
    return Scanner(kind_of, (small * width).astype(np.int32).reshape(-1), accepts[first], width, int(dead[0]) if len(dead) else -1)


def states_after(scanner: Scanner, data: np.ndarray, ends: np.ndarray, *, leftward: bool = False, block: int = 1024) -> np.ndarray:
    """The premultiplied state after each byte of each text; ``ends``: where the texts of ``data`` end.

    Texts are cut into blocks that are read side by side. A block whose neighbour ends in
    another state than assumed is read again until it meets the states found before, so the
    cut changes nothing.
    """
    starts = np.concatenate([[0], ends[:-1]])
    count = -(-(ends - starts) // block)
    text = np.repeat(np.arange(len(ends)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # 0: read first
    way = -1 if leftward else 1
    begin = ends[text] - 1 - rank * block if leftward else starts[text] + rank * block
    length = np.minimum(block, ends[text] - starts[text] - rank * block)
    symbols = scanner.kind_of[data]
    found = np.zeros(len(data), np.int32)
    state = np.zeros(len(text), np.int32)
    follow = np.flatnonzero(rank > 0)
    lanes = np.argsort(-length, kind="stable")
    first = True
    while len(lanes):
        now, place, left = state[lanes], begin[lanes], length[lanes]
        if first:
            shrinks = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # blocks longer than j
            for j, k in enumerate(shrinks.tolist()):
                at = place[:k] + way * j
                now = scanner.step[now[:k] + symbols[at]]
                found[at] = now
        else:
            for j in range(int(left[0])):
                alive = left > j
                now, place, left = now[alive], place[alive], left[alive]
                at = place + way * j
                now = scanner.step[now + symbols[at]]
                fresh = found[at] != now
                if not fresh.any():
                    break
                now, place, left = now[fresh], place[fresh], left[fresh]
                found[at[fresh]] = now
        # Blocks that begin otherwise than assumed when they were read.
        first = False
        want = found[begin[follow] - way]
        wrong = want != state[follow]
        lanes = follow[wrong]
        state[lanes] = want[wrong]
        lanes = lanes[np.argsort(-length[lanes], kind="stable")]
    return found


def longest_from(scanner: Scanner, data: bytes, at: int) -> int:
    """End of the longest match that begins at ``at``, or -1."""
    state, best, dead = 0, -1, scanner.dead * scanner.width
    step, kind_of, accepts, width = scanner.step, scanner.kind_of, scanner.accepts, scanner.width
    for i in range(at, len(data)):
        state = step[state + kind_of[data[i]]]
        if state == dead:
            break
        if accepts[state // width]:
            best = i + 1
    return best
