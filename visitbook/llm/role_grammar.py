"""Generalised LR repair of a sequence of roles by weighted edits.

The grammar's LR(0) automaton drives stacks that share their lower parts and are interned, so a
stack is one node of a graph however it was reached. All stacks advance together, row by row:
a row is kept, deleted or given another role, and rows may be inserted. Where two ways lead to
an equal stack, the one with the smaller (cost, audit) is kept.

Keeping only the smaller is exact. Two ways of equal cost to one stack over the same rows have
audits of which neither begins with the other (the rest would be insertions, which cost), so
what follows cannot change their order.
"""

from __future__ import annotations

from collections.abc import Iterable

# Roles by their initials: conversations are (s?(ua)+)?.
PRODUCTIONS = [("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua")]
START = "C"
TERMINALS = "sua"
# What rows can be changed to, or inserted as.
SPOKEN = "ua"

# Costs of edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# A row as one letter: its role's initial and its fault.
INITIALS = "sua?"
SOUND, CUT_OFF, BLANK, REPEATED = range(4)

Ways = dict["Stack", tuple[int, str]]


def row_code(initial: str, fault: int) -> str:
    return chr(ord("A") + INITIALS.index(initial if initial and initial in TERMINALS else "?") * 4 + fault)


ROWS = {row_code(i, f): (i, f) for i in INITIALS for f in range(4)}

Item = tuple[int, int]  # production, symbols read


def closure(items: Iterable[Item]) -> frozenset[Item]:
    found = set(items)
    open_ = list(found)
    while open_:
        p, dot = open_.pop()
        for q, (left, _) in enumerate(PRODUCTIONS):
            if PRODUCTIONS[p][1][dot : dot + 1] == left and (q, 0) not in found:
                found.add((q, 0))
                open_.append((q, 0))
    return frozenset(found)


def after(state: frozenset[Item], symbol: str) -> frozenset[Item]:
    return closure((p, dot + 1) for p, dot in state if PRODUCTIONS[p][1][dot : dot + 1] == symbol)


class Stack:
    """A node of the graph: an automaton state on top of another node. Equal stacks are one object."""

    def __init__(self, state: frozenset[Item], below: Stack | None):
        self.state, self.below = state, below
        self._pushed: dict[str, Stack | None] = {}
        self._read: dict[str, list[Stack]] = {}

    def push(self, symbol: str) -> Stack | None:
        if symbol not in self._pushed:
            state = after(self.state, symbol)
            self._pushed[symbol] = Stack(state, self) if state else None
        return self._pushed[symbol]

    def reduced(self) -> list[Stack]:
        """The stacks after each reduction that the top allows; not that to the whole sentence."""
        out = []
        for p, dot in self.state:
            left, right = PRODUCTIONS[p]
            if dot == len(right) and left != START:
                base = self
                for _ in right:
                    base = base.below
                out.append(base.push(left))
        return out

    def read(self, terminal: str) -> list[Stack]:
        """All stacks after the next row's role that can still become a sentence."""
        if terminal not in self._read:
            top = self.push(terminal)
            open_, found = [top] if top else [], []
            while open_:
                stack = open_.pop()
                open_ += stack.reduced()
                if stack.complete() or any(stack.push(t) for t in TERMINALS):
                    found.append(stack)
            self._read[terminal] = found
        return self._read[terminal]

    def complete(self) -> bool:
        """Whether the rows so far are a sentence of the grammar."""
        return any(PRODUCTIONS[p][0] == START and dot == len(PRODUCTIONS[p][1]) for p, dot in self.state)


BOTTOM = Stack(closure((p, 0) for p, (left, _) in enumerate(PRODUCTIONS) if left == START), None)


def _reachable() -> list[Stack]:
    found, open_ = [BOTTOM], [BOTTOM]
    while open_:
        stack = open_.pop()
        fresh = [s for t in TERMINALS for s in stack.read(t) if s not in found]
        found += fresh
        open_ += fresh
    return found


# Every stack that rows can lead to: this grammar has few, since its list is built from the left.
STACKS = _reachable()


def _offer(ways: Ways, stack: Stack, way: tuple[int, str]) -> bool:
    if stack in ways and ways[stack] <= way:
        return False
    ways[stack] = way
    return True


def _insert(ways: Ways) -> None:
    """Add what insertions reach, until nothing gets better."""
    open_ = list(ways)
    while open_:
        stack = open_.pop()
        cost, audit = ways[stack]
        for role in SPOKEN:
            for to in stack.read(role):
                if _offer(ways, to, (cost + INSERT, audit + "I")):
                    open_.append(to)


def advance(ways: Ways, codes: str) -> Ways:
    """The cheapest way to every stack after some more rows."""
    for code in codes:
        initial, fault = ROWS[code]
        _insert(ways)
        to: Ways = {}
        for stack, (cost, audit) in ways.items():
            _offer(to, stack, (cost + DELETE, audit + "D"))
            if fault in (BLANK, REPEATED):
                continue
            stay = cost + (TRUNCATED if fault == CUT_OFF else 0)
            for kept in stack.read(initial) if initial in TERMINALS else ():
                _offer(to, kept, (stay, audit + "K"))
            for role in SPOKEN:
                for changed in stack.read(role):
                    _offer(to, changed, (stay + REROLE, audit + "R"))
        ways = to
    return ways


def finish(ways: Ways) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    _insert(ways)
    return min(way for stack, way in ways.items() if stack.complete())


def repair(codes: str) -> tuple[int, str]:
    return finish(advance({BOTTOM: (0, "")}, codes))


def transfers(codes: str) -> list[Ways]:
    """From every stack, the cheapest way to every stack: rows in the middle of a conversation."""
    return [advance({stack: (0, "")}, codes) for stack in STACKS]


def joined(ways: Ways, steps: list[dict[int, tuple[int, str]]]) -> Ways:
    """Ways over some rows followed by the transfers of the next, both by the stacks' numbers."""
    to: Ways = {}
    for stack, (cost, audit) in ways.items():
        for number, (more, added) in steps[STACKS.index(stack)].items():
            _offer(to, STACKS[number], (cost + more, audit + added))
    return to


def repaired_role(edit: str, role: str, before: str) -> str:
    """The role of a repaired row that follows one of role `before`."""
    return role if edit == "K" else "assistant" if before[:1] == "u" else "user"
