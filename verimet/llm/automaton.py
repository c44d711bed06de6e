"""Many regular expressions as one minimal automaton over bytes.

Patterns know literals, classes ``[...]``, groups, ``|`` and ``? * + {m} {m,} {m,n}``.  A pattern
becomes a nondeterministic automaton by structural rules; subset construction and
partition refinement turn all of them together into one table of transitions.
"""

from __future__ import annotations

import numpy as np

#: Byte that never occurs in UTF-8; it stands between texts and leads back to the start.
BREAK = 0xFF


def tree(pattern: str):
    """Syntax tree: ("set", bytes), ("cat", parts), ("or", parts), ("many", part, least, most or None)."""
    at = 0

    def peek():
        return pattern[at] if at < len(pattern) else ""

    def take():
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped():
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def either():
        parts = [sequence()]
        while peek() == "|":
            take()
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def repeated():
        node = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                text = ""
                while peek() != "}":
                    text += take()
                take()
                low, comma, high = text.partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("many", node, least, most)
        return node

    def atom():
        c = take()
        if c == "(":
            node = either()
            take()
            return node
        if c == "[":
            return ("set", members())
        if c == "\\":
            return ("set", frozenset([escaped()]))
        return ("set", frozenset([ord(c)]))

    def members():
        inside, found = set(), []
        while peek() != "]":
            c = take()
            low = escaped() if c == "\\" else ord(c)
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                c = take()
                found.append((low, escaped() if c == "\\" else ord(c)))
            else:
                found.append((low, low))
        take()
        for low, high in found:
            inside.update(range(low, high + 1))
        return frozenset(inside)

    node = either()
    if at != len(pattern):
        raise ValueError(f"can't read {pattern!r} from place {at}")
    return node


def either_case(node):
    """The tree with both cases of every ASCII letter."""
    kind = node[0]
    if kind == "set":
        return ("set", frozenset(b for x in node[1] for b in {x, *(ord(c) for c in (chr(x).lower(), chr(x).upper()) if x < 128)}))
    if kind == "many":
        return ("many", either_case(node[1]), *node[2:])
    return (kind, [either_case(x) for x in node[1]])


def backwards(node):
    """The tree of the reversed strings."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "many":
        return ("many", backwards(node[1]), *node[2:])
    parts = [backwards(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class Parts:
    """States of the nondeterministic automaton: free moves and moves by a set of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.move.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Build `node` from state `start`; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            step = self.state()
            self.free[start].append(step)
            self.move[step] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            end = self.state()
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """`step[state * width + kind[byte]]` is the next state; `accepts[state]` a bit for each pattern.

    State 0 is the start.  An unanchored automaton starts anew at every byte, an anchored one gets to
    state `dead` when nothing can match any more.
    """

    def __init__(self, trees: list, anchored: bool) -> None:
        parts = Parts()
        start = parts.state()
        ends = {}
        for k, node in enumerate(trees):
            ends[parts.add(node, start)] = 1 << k
        sets = list({m[0] for m in parts.move if m})
        column = {}
        self.kind = np.zeros(256, np.int32)
        for b in range(256):
            key = (b == BREAK, *(b in s for s in sets))
            self.kind[b] = column.setdefault(key, len(column))
        self.width = len(column)
        some = {int(k): b for b, k in enumerate(self.kind)}
        first = parts.closed([start])
        known, rows, todo = {first: 0}, [], [first]
        while todo:
            now = todo.pop(0)
            row = []
            for k in range(self.width):
                if some[k] == BREAK:
                    to = frozenset() if anchored else first
                else:
                    moved = [parts.move[s][1] for s in now if parts.move[s] and some[k] in parts.move[s][0]]
                    to = parts.closed([*moved, *([] if anchored else [start])])
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            rows.append(row)
        accepts = [sum(ends.get(s, 0) for s in states) for states in known]
        self._minimal(np.array(rows, np.int32), np.array(accepts, np.int64))

    def _minimal(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Merge states that no input tells apart: split by acceptance, then by successors, until stable."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        for s in range(len(block)):  # state 0 stays first
            if order[block[s]] < 0:
                order[block[s]] = order.max() + 1
        name = order[block]
        n = name.max() + 1
        self.table = np.zeros((n, self.width), np.int32)
        self.table[name] = name[table]
        self.accepts = np.zeros(n, np.int64)
        self.accepts[name] = accepts
        loops = (self.table == np.arange(n)[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(loops)[0]) if loops.any() else -1
        self.step = (self.table * self.width).reshape(-1).astype(np.int32)
        self.flat_accepts = np.zeros(n * self.width, bool)
        self.flat_accepts[np.arange(n) * self.width] = self.accepts > 0

    def longest(self, data: bytes, start: int, end: int) -> int:
        """End of the longest match at `start`, or -1 (for an anchored automaton of one pattern)."""
        state, best = 0, -1
        for i in range(start, end):
            state = int(self.table[state, self.kind[data[i]]])
            if state == self.dead:
                break
            if self.accepts[state]:
                best = i + 1
        return best


def marks(machine: Automaton, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Places where the unanchored `machine` accepts after reading them, and the patterns' bits.

    The bytes are cut into lanes that all step at once.  A lane is taken to begin in
    the start state; lanes whose predecessor ended elsewhere are read again from there until
    none is left, so the states are those of one pass from the first byte to the last.
    """
    n = len(data)
    lanes = max(1, -(-n // lane))
    padded = np.full(lanes * lane, BREAK, np.uint8)
    padded[:n] = data
    kinds = np.ascontiguousarray(machine.kind[padded].reshape(lanes, lane).T)
    states = np.empty((lane, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for i in range(lane):
        now = machine.step[now + kinds[i]]
        states[i] = now
    begin = np.zeros(lanes, np.int32)
    while True:
        want = np.concatenate([np.zeros(1, np.int32), states[-1, :-1]])
        again = np.flatnonzero(want != begin)
        if not len(again):
            break
        begin[again] = want[again]
        now, open_ = want[again], again
        for i in range(lane):
            now = machine.step[now + kinds[i, open_]]
            changed = now != states[i, open_]
            if not changed.all():  # from here on as before
                now, open_ = now[changed], open_[changed]
                if not len(open_):
                    break
            states[i, open_] = now
    step, column = np.nonzero(machine.flat_accepts[states])
    place = column.astype(np.int64) * lane + step
    order = np.argsort(place, kind="stable")
    place = place[order]
    return place, machine.accepts[states[step[order], column[order]] // machine.width]
