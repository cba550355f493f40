"""Regular expressions over bytes to one minimal deterministic automaton, and lockstep scans with it.

Syntax: literals, ``\\xHH``, escaped characters, classes with ranges, groups, ``|``, ``? + *`` and
``{m}``, ``{m,}``, ``{m,n}``. No anchors, back references or lazy repeats.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent to a tree of ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced at {self.i}: {self.p}")
        return node

    def alternatives(self):
        nodes = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            nodes.append(self.sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    def sequence(self):
        nodes = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            nodes.append(self.repeat(self.atom()))
        return ("cat", nodes)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            return self.charclass()
        return ("set", self.folded({self.char()}))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c in string.ascii_letters + string.digits:
            raise ValueError(f"no such escape: \\{c}")
        return ord(c)

    def charclass(self):
        self.i += 1
        negate = self.p[self.i] == "^"
        self.i += negate
        out = set()
        while self.p[self.i] != "]":
            a = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(a, self.char() + 1))
            else:
                out.add(a)
        self.i += 1
        out = self.folded(out)
        return ("set", frozenset(range(256)) - out if negate else out)

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c) in string.ascii_letters}
        return frozenset(chars)

    def repeat(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
                self.i = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            node = ("rep", node, least, most)
        return node


class _Nfa:
    def __init__(self):
        self.silent: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.silent.append([])
        self.moves.append(None)
        return len(self.silent) - 1

    def build(self, node, at: int, backwards: bool) -> int:
        """Add the node's paths from state ``at``; returns the state they end in."""
        kind = node[0]
        if kind == "set":
            a, z = self.state(), self.state()
            self.silent[at].append(a)
            self.moves[a] = (node[1], z)
            return z
        if kind == "cat":
            for x in reversed(node[1]) if backwards else node[1]:
                at = self.build(x, at, backwards)
            return at
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                self.silent[self.build(x, at, backwards)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            at = self.build(inner, at, backwards)
        end = self.state()
        self.silent[at].append(end)
        if most is None:
            loop = self.state()
            self.silent[at].append(loop)
            back = self.build(inner, loop, backwards)
            self.silent[back] += [loop, end]
        for _ in range((most or least) - least):
            at = self.build(inner, at, backwards)
            self.silent[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.silent[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """``next[state * n_classes + classes[byte]]`` is the next state times ``n_classes``; ``accepts[state]`` a bit mask of rules."""

    classes: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    n_classes: int
    start: int
    dead: int

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """For walks in plain Python."""
        if not hasattr(self, "_rows"):
            self._rows = (self.classes.tolist(), self.next.tolist(), np.repeat(self.accepts, self.n_classes).tolist())
        return self._rows

    def ends(self, data: bytes, at: int, step: int, stop: int) -> list[int]:
        """Offsets at which a match that begins at ``at`` and goes on by ``step`` may end, in order."""
        classes, following, accepts = self.rows()
        state, out = self.start, []
        i = at if step > 0 else at - 1
        while i != stop:
            state = following[state + classes[data[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                out.append(i + 1 if step > 0 else i)
            i += step
        return out


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def compile_rules(patterns: list[tuple[str, bool]], search: bool = True, backwards: bool = False) -> Dfa:
    """Subset construction over all patterns (text, whether letters match in either case), then minimisation.

    With ``search`` a match may begin anywhere; else at the first byte only. With ``backwards`` the
    automaton reads matches from their last byte to their first.
    """
    nfa = _Nfa()
    root = nfa.state()
    final = {}
    for k, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.silent[root].append(first)
        final[nfa.build(_Parser(pattern, fold).parse(), first, backwards)] = k
    sets = {m[0] for m in nfa.moves if m}
    signatures: dict[tuple, int] = {}
    classes = np.array([signatures.setdefault(tuple(b in s for s in sets), len(signatures)) for b in range(256)], np.uint8)
    n = len(signatures)
    sample = [int(np.argmax(classes == c)) for c in range(n)]
    # Sets of states are integers, a bit for each state; a state's moves are kept with what they reach in silence.
    reach = [0] * len(nfa.silent)
    for z in {m[1] for m in nfa.moves if m}:
        reach[z] = sum(1 << x for x in nfa.closure([z]))
    on = {}
    for s, m in enumerate(nfa.moves):
        if m is not None:
            on[s] = (tuple(c for c in range(n) if sample[c] in m[0]), reach[m[1]])
    movers, ends = sum(1 << s for s in on), sum(1 << s for s in final)
    begin = sum(1 << x for x in nfa.closure([root]))
    again = begin if search else 0
    known, todo, table, masks = {begin: 0}, [begin], [], []
    for now in todo:
        masks.append(sum(1 << final[s] for s in _bits(now & ends)))
        row = [again] * n
        for s in _bits(now & movers):
            classes_on, reached = on[s]
            for c in classes_on:
                row[c] |= reached
        for c, reached in enumerate(row):
            if reached not in known:
                known[reached] = len(todo)
                todo.append(reached)
            row[c] = known[reached]
        table.append(row)
    table, masks = np.array(table), np.array(masks)
    block = np.unique(masks, return_inverse=True)[1]
    while True:  # refine until states of a block go to the same blocks
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    small = block[table[first]]
    dead = next((int(s) * n for s in range(len(first)) if masks[first[s]] == 0 and (small[s] == s).all()), -1)
    return Dfa(classes, (small * n).astype(np.int32).reshape(-1), masks[first].astype(np.int32), n, int(block[0]) * n, dead if not search else -1)


def scan(dfa: Dfa, stream: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after which some rule accepts, and their rule masks: every byte goes once through the arrays.

    The stream is cut into lanes that advance together. A lane first starts as if nothing came
    before it; where the lane before it ended in another state, it is run again until both runs
    are in the same state, so the result is that of one sequential run.
    """
    n = len(stream)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, dfa.classes[255], np.uint8)
    np.take(dfa.classes, stream, out=grid[:n])
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    states = np.empty((lane, lanes), np.int32)
    state = np.full(lanes, dfa.start, np.int32)
    for s in range(lane):
        state = dfa.next.take(state + grid[s])
        states[s] = state
    began = np.full(lanes, dfa.start, np.int32)
    while True:
        should = np.concatenate([[dfa.start], states[-1][:-1]]).astype(np.int32)
        redo = np.flatnonzero(should != began)
        if not len(redo):
            break
        began[redo] = should[redo]
        state = should[redo]
        for s in range(lane):
            state = dfa.next.take(state + grid[s, redo])
            apart = state != states[s, redo]
            if not apart.any():
                break
            redo, state = redo[apart], state[apart]
            states[s, redo] = state
    masks = np.repeat(dfa.accepts, dfa.n_classes)
    hit = (masks != 0).take(states)
    at, of = np.nonzero(hit)
    where = of * lane + at
    order = np.argsort(where, kind="stable")
    where, got = where[order], masks.take(states[at, of])[order]
    keep = where < n
    return where[keep] + 1, got[keep]
