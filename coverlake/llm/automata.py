"""Probabilistic automata from examples by state merging (ALERGIA).

The examples form a prefix tree with counts; states are merged, in
breadth-first order, when the Hoeffding bound cannot tell their futures
apart, and the merged automaton stays deterministic by folding subtrees.
Of several states that a node is compatible with, it joins the one under
which its subtree is most likely: rare nodes pass every test, and the first
state that comes would spoil the start of the automaton.
"""

from __future__ import annotations

import math
from collections import deque

ALPHA = 0.05
"""Significance of the Hoeffding test."""
UNSEEN = math.log(1e-4)
"""Log-likelihood of a step that no example took."""


class Automaton:
    """``step[state][symbol] = (next state, log-probability)``."""

    def __init__(self, step: list[dict[str, tuple[int, float]]], stop: list[float]):
        self.step, self.stop = step, stop

    def score(self, text: str) -> float:
        """Mean log-likelihood of the symbols and of the end."""
        total, state = 0.0, 0
        for k, symbol in enumerate(text):
            move = self.step[state].get(symbol)
            if move is None:
                return (total + UNSEEN * (len(text) - k + 1)) / (len(text) + 1)
            state, p = move
            total += p
        return (total + self.stop[state]) / (len(text) + 1)


def learn(examples: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a bounded list of examples (order does not matter)."""
    arrive, stop, next_, taken = [0], [0], [{}], [{}]
    for text in sorted(examples):
        state = 0
        arrive[0] += 1
        for symbol in text:
            to = next_[state].get(symbol)
            if to is None:
                to = len(arrive)
                arrive.append(0), stop.append(0), next_.append({}), taken.append({})
                next_[state][symbol], taken[state][symbol] = to, 0
            taken[state][symbol] += 1
            state = to
            arrive[state] += 1
        stop[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n1, n2 = arrive[p], arrive[q]
            if differ(stop[p], n1, stop[q], n2):
                return False
            for symbol in next_[p].keys() | next_[q].keys():
                if differ(taken[p].get(symbol, 0), n1, taken[q].get(symbol, 0), n2):
                    return False
                if symbol in next_[p] and symbol in next_[q]:
                    todo.append((next_[p][symbol], next_[q][symbol]))
        return True

    def likelihood(a: int, b: int) -> float:
        total, todo = 0.0, [(a, b)]
        while todo:
            p, q = todo.pop()
            if stop[q]:
                total += stop[q] * (math.log(stop[p] / arrive[p]) if stop[p] else UNSEEN)
            for symbol, to in next_[q].items():
                if symbol in next_[p]:
                    total += taken[q][symbol] * math.log(taken[p][symbol] / arrive[p])
                    todo.append((next_[p][symbol], to))
                else:
                    total += taken[q][symbol] * UNSEEN
        return total

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            arrive[p] += arrive[q]
            stop[p] += stop[q]
            for symbol, to in next_[q].items():
                taken[p][symbol] = taken[p].get(symbol, 0) + taken[q][symbol]
                if symbol in next_[p]:
                    todo.append((next_[p][symbol], to))
                else:
                    next_[p][symbol] = to

    kept, edge = [0], deque((0, s) for s in sorted(next_[0]))
    inside = {0}
    while edge:
        source, symbol = edge.popleft()
        state = next_[source][symbol]
        if state in inside:
            continue
        match = max((r for r in kept if compatible(r, state)), key=lambda r: likelihood(r, state), default=None)
        if match is None:
            kept.append(state)
            inside.add(state)
            edge.extend((state, s) for s in sorted(next_[state]))
        else:
            next_[source][symbol] = match
            fold(match, state)
            edge.extend((r, s) for r in kept for s in sorted(next_[r]) if next_[r][s] not in inside)
    number = {s: k for k, s in enumerate(kept)}
    step = [{s: (number[to], math.log(taken[r][s] / arrive[r])) for s, to in next_[r].items()} for r in kept]
    return Automaton(step, [math.log(stop[r] / arrive[r]) if stop[r] else UNSEEN for r in kept])
