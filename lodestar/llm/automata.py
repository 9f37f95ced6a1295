"""Regular expressions of several rules compiled into one minimal deterministic automaton over bytes, and its scan."""

from __future__ import annotations

import numpy as np


class Parser:
    """A small syntax: literals, escapes, classes, groups, (?i:...), alternation, and the counts ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern.encode("latin-1"), 0, False

    def parse(self):
        out = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected character at {self.i}")
        return out

    def peek(self) -> bytes:
        return self.p[self.i : self.i + 1]

    def take(self, n: int = 1) -> bytes:
        self.i += n
        return self.p[self.i - n : self.i]

    def either(self):
        options = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        out = []
        while self.peek() not in (b"", b"|", b")"):
            out.append(self.counted(self.atom()))
        return ("seq", out)

    def counted(self, x):
        c = self.peek()
        if c in (b"?", b"*", b"+"):
            self.take()
            return ("rep", x, {b"?": (0, 1), b"*": (0, None), b"+": (1, None)}[c])
        if c == b"{":
            end = self.p.index(b"}", self.i)
            low, _, high = self.p[self.i + 1 : end].decode().partition(",")
            bounds = (int(low), (int(high) if high else None) if b"," in self.p[self.i : end] else int(low))
            self.i = end + 1
            return ("rep", x, bounds)
        return x

    def one(self) -> int:
        c = self.take()
        if c != b"\\":
            return c[0]
        c = self.take()
        return int(self.take(2), 16) if c == b"x" else {b"n": 10, b"t": 9, b"r": 13}.get(c, c[0])

    def atom(self):
        c = self.peek()
        if c == b"(":
            self.take()
            was = self.fold
            if self.p[self.i : self.i + 3] == b"?i:":
                self.take(3)
                self.fold = True
            elif self.p[self.i : self.i + 2] == b"?:":
                self.take(2)
            out = self.either()
            if self.take() != b")":
                raise ValueError("unclosed group")
            self.fold = was
            return out
        if c == b"[":
            self.take()
            negated, chosen = self.peek() == b"^", set()
            if negated:
                self.take()
            while self.peek() != b"]":
                low = self.one()
                if self.peek() == b"-" and self.p[self.i + 1 : self.i + 2] != b"]":
                    self.take()
                    chosen.update(range(low, self.one() + 1))
                else:
                    chosen.add(low)
            self.take()
            return ("set", self.folded(set(range(256)) - chosen if negated else chosen))
        return ("set", self.folded({self.one()}))

    def folded(self, chosen: set[int]) -> frozenset[int]:
        if self.fold:
            chosen |= {ord(f(chr(b))) for b in chosen if b < 128 for f in (str.lower, str.upper)}
        return frozenset(chosen)


class Nondeterministic:
    """States with empty moves and moves by sets of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, x, start: int) -> int:
        """Adds an expression that begins in a state; returns the one it ends in."""
        if x[0] == "set":
            end = self.state()
            self.moves[start].append((x[1], end))
            return end
        if x[0] == "seq":
            for y in x[1]:
                start = self.add(y, start)
            return start
        if x[0] == "or":
            end = self.state()
            for y in x[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(y, first)].append(end)
            return end
        _, y, (low, high) = x
        for _ in range(low):
            start = self.add(y, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(y, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(y, start)
            self.empty[start].append(end)
        return end


def reversed_tree(x):
    """The expression of the same strings read backwards."""
    if x[0] == "set":
        return x
    if x[0] == "seq":
        return ("seq", [reversed_tree(y) for y in reversed(x[1])])
    if x[0] == "or":
        return ("or", [reversed_tree(y) for y in x[1]])
    return ("rep", reversed_tree(x[1]), x[2])


class Walk:
    """A minimal automaton of one expression from a fixed place, forwards or backwards; -1 is where no match can follow."""

    def __init__(self, pattern: str, backwards: bool = False):
        tree = Parser(pattern).parse()
        classes, moves, accepts = determined(reversed_tree(tree) if backwards else tree, 1, anywhere=False)
        dead = [bool(not accepts[s] and (moves[s] == s).all()) for s in range(len(moves))]
        self.step = -1 if backwards else 1
        self.classes = classes.tolist()
        self.moves = [[-1 if dead[t] else t for t in row] for row in moves.tolist()]
        self.accepts = accepts.tolist()

    def furthest(self, data: bytes, at: int, limit: int) -> int:
        """How far from a place the longest match reaches, between it and a limit; -1 without one. Backwards the place is its end."""
        state, last = 0, at if self.accepts[0] else -1
        while at != limit:
            state = self.moves[state][self.classes[data[at if self.step > 0 else at - 1]]]
            if state < 0:
                break
            at += self.step
            if self.accepts[state]:
                last = at
        return last


class Automaton:
    """A minimal automaton that finds where matches of each rule end, wherever they begin.

    ``classes`` maps bytes to columns of ``moves``; entries of ``moves`` are row offsets, so a step is one look-up.
    ``accepts`` has a bit for each rule by state; accepting states come last, from ``first_accepting`` on.
    """

    def __init__(self, patterns: list[str]):
        built = [determined(Parser(p).parse(), 1 << k) for k, p in enumerate(patterns)]
        marks = np.zeros(256, dtype=np.int64)
        for classes, _, _ in built:
            _, marks = np.unique(marks * (classes.max() + 1) + classes, return_inverse=True)
        sample = [int(np.argmax(marks == c)) for c in range(marks.max() + 1)]
        self.classes, self.width = marks.astype(np.uint8), len(sample)
        moves, accepts = np.zeros((1, self.width), dtype=np.int64), np.zeros(1, dtype=np.int64)
        for classes, more, bits in built:  # rule by rule: the states that both reach together, made minimal again
            moves, accepts = minimal(*together(moves, accepts, more[:, classes[sample]], bits))
        order = np.concatenate([[0], 1 + np.argsort(accepts[1:] != 0, kind="stable")])
        place = np.argsort(order)
        self.accepts, self.states = accepts[order], len(order)
        self.moves = (place[moves[order]] * self.width).astype(np.int32).ravel()
        self.first_accepting = int(np.argmax(self.accepts != 0)) * self.width

    def scan(self, data: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which some rule's match ends, and the rules' bits there.

        The bytes are dealt to lanes that step together. All lanes begin in the start state; a lane whose predecessor ended in
        another is walked again from there, until its states are the same as before.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-n // lane)
        columns = np.zeros(lanes * lane, dtype=np.uint8)
        columns[:n] = self.classes[data]
        columns = np.ascontiguousarray(columns.reshape(lanes, lane).T)
        states = np.empty((lane, lanes), dtype=np.int32)
        state = np.zeros(lanes, dtype=np.int32)
        for t in range(lane):
            state = self.moves.take(state + columns[t])
            states[t] = state
        entry = np.zeros(lanes, dtype=np.int32)
        while True:
            now = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
            which = np.nonzero(now != entry)[0]
            if not len(which):
                break
            entry, state = now, now[which]
            for t in range(lane):
                state = self.moves.take(state + columns[t, which])
                differ = states[t, which] != state
                if not differ.any():
                    break
                states[t, which] = state
        row, col = np.nonzero(states.T >= self.first_accepting)
        at = row * lane + col
        keep = at < n
        return at[keep] + 1, self.accepts[states[col[keep], row[keep]] // self.width]


def determined(tree, bit: int, anywhere: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Byte classes, moves by class, and accepted bits of one rule's minimal automaton; state 0 is the start.

    Subset construction; ``anywhere`` makes the start part of every set, so that matches begin anywhere.
    """
    nfa = Nondeterministic()
    start = nfa.state()
    end = nfa.add(tree, start)
    marks = np.zeros(256, dtype=np.int64)
    for chosen in {s for m in nfa.moves for s, _ in m}:
        one = np.zeros(256, dtype=np.int64)
        one[list(chosen)] = 1
        _, marks = np.unique(marks * 2 + one, return_inverse=True)
    sample = [int(np.argmax(marks == c)) for c in range(marks.max() + 1)]
    closure = []
    for s in range(len(nfa.empty)):
        seen, stack = {s}, [s]
        while stack:
            for t in nfa.empty[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        closure.append(sum(1 << t for t in seen))
    step = [[sum_or(closure[t] for chosen, t in moves if b in chosen) for b in sample] for moves in nfa.moves]
    moving = sum(1 << s for s, moves in enumerate(nfa.moves) if moves)
    begin = closure[start]
    number, sets, rows = {begin: 0}, [begin], []
    for current in sets:
        members, left = [], current & moving
        while left:
            low = left & -left
            members.append(step[low.bit_length() - 1])
            left ^= low
        row = []
        for c in range(len(sample)):
            to = begin if anywhere else 0
            for m in members:
                to |= m[c]
            if to not in number:
                number[to] = len(sets)
                sets.append(to)
            row.append(number[to])
        rows.append(row)
    return marks, *minimal(np.array(rows, dtype=np.int64), np.array([bit * (s >> end & 1) for s in sets], dtype=np.int64))


def minimal(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States stay together while they accept the same rules and move to the same groups; state 0 stays first."""
    label = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([label, label[moves]]), axis=0, return_inverse=True)
        if new.max() == label.max():
            break
        label = new.ravel()
    one = np.unique(label, return_index=True)[1]
    order = np.argsort(one)  # by first state, so the start is first
    place = np.argsort(order)
    return place[label[moves[one[order]]]], accepts[one[order]]


def together(a: np.ndarray, a_accepts: np.ndarray, b: np.ndarray, b_accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The automaton of the pairs of states that two automata reach together."""
    number, pairs, rows = {0: 0}, [0], []
    for pair in pairs:
        x, y = divmod(pair, len(b))
        row = []
        for to in (a[x] * len(b) + b[y]).tolist():
            if to not in number:
                number[to] = len(pairs)
                pairs.append(to)
            row.append(number[to])
        rows.append(row)
    which = np.array(pairs)
    return np.array(rows, dtype=np.int64), a_accepts[which // len(b)] | b_accepts[which % len(b)]


def sum_or(values) -> int:
    out = 0
    for v in values:
        out |= v
    return out
