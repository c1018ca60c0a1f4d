"""Weighted finite-state transducers over the tropical semiring (min, +).

A weight is a cost: along a path costs are added, of several paths the cheapest counts, ``ONE`` is
free and ``ZERO`` is impossible. Three kinds of machine are enough here:

* ``Trie``: arcs are symbols; a state that ends an entry writes the entry's label at its weight and
  returns to the start (by an arc without a symbol), so the machine reads any chain of entries.
* ``Fallback``: one state that reads any single symbol and writes a label made from it.
* an acceptor of labels: a mapping from state (the label read last, -1 at first) to a mapping from
  the next label to its weight. Both may be made as they are asked for. ``FREE`` has one state.

``compose`` joins a text, which is a chain of states, one for each position, with these machines.
The result is expanded as it is walked: its states are (position, state of the acceptor), its arcs
the entries that begin at a position. ``shortest`` finds the cheapest path through it.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Mapping

ONE, ZERO = 0.0, float("inf")
#: Labels of single symbols that no entry covers lie above this.
LONE = 1 << 24
Arc = tuple[int, int, float]
Acceptor = Mapping[int, Mapping[int, float]]


class _Always(dict):
    """A mapping that gives one answer for every key."""

    def __init__(self, answer: object) -> None:
        self.answer = answer

    def __missing__(self, _key: int) -> object:
        return self.answer


#: The acceptor with one state: any label may follow any other.
FREE: Acceptor = _Always(_Always(ONE))


class Trie:
    """States are dictionaries from symbol to state; an entry's end holds (label, weight) under ``None``."""

    def __init__(self, entries: Iterable[tuple[Iterable[Hashable], int, float]] = ()) -> None:
        self.start: dict = {}
        for symbols, label, weight in entries:
            state = self.start
            for s in symbols:
                state = state.setdefault(s, {})
            state[None] = (label, weight)


class Fallback:
    """Reads one symbol and writes ``LONE`` and the symbol's number."""

    def __init__(self, weight: float) -> None:
        self.weight = weight

    def arc(self, symbol: str | int) -> tuple[int, float]:
        return LONE + (symbol if isinstance(symbol, int) else ord(symbol)), self.weight


class Composed:
    """A text composed with a trie, a fallback and an acceptor of labels."""

    def __init__(self, text: str | bytes, entries: Trie, fallback: Fallback, after: Acceptor) -> None:
        self.text, self.entries, self.fallback, self.after = text, entries, fallback, after

    def arcs(self, at: int) -> list[Arc]:
        """(position behind, label, weight) of what may be written from a position, shortest first."""
        text, state, out = self.text, self.entries.start, []
        for k in range(at, len(text)):
            state = state.get(text[k])
            if state is None:
                break
            end = state.get(None)
            if end is not None:
                out.append((k + 1, *end))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, *self.fallback.arc(text[at])))
        return out


def compose(text: str | bytes, entries: Trie, fallback: Fallback, after: Acceptor = FREE) -> Composed:
    return Composed(text, entries, fallback, after)


def shortest(machine: Composed) -> list[int]:
    """The labels on the cheapest path; on ties the entry that begins first.

    Positions are in topological order, so one pass settles every state. The acceptors in use leave
    one state a position that costs less than ``ZERO``: ``FREE`` has just one, and that of merges
    follows from what ``bpe`` proves. So a position keeps its cheapest state, and an arc whose cost
    cannot be lower than what a position already has needs no question to the acceptor.
    """
    text, n, start, after, lone = machine.text, len(machine.text), machine.entries.start, machine.after, machine.fallback.arc
    cost, label, begin = [ZERO] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    cost[0] = ONE
    for at in range(n):
        own = cost[at]
        if own == ZERO:
            continue
        weight, state, end = after[label[at]], start, at
        for symbol in text[at:] if n - at < 64 else _from(text, at):
            state = state.get(symbol)
            if state is None:
                break
            end += 1
            if None in state:
                entry = state[None]
                total = own + entry[1]
                if total < cost[end] and (total := total + weight[entry[0]]) < cost[end]:
                    cost[end], label[end], begin[end] = total, entry[0], at
        # a symbol that is no entry by itself
        first = start.get(text[at])
        if first is None or None not in first:
            alone, price = lone(text[at])
            if own + price < cost[at + 1] and (total := own + price + weight[alone]) < cost[at + 1]:
                cost[at + 1], label[at + 1], begin[at + 1] = total, alone, at
    out, at = [], n
    while at > 0:
        out.append(label[at])
        at = begin[at]
    out.reverse()
    return out


def _from(text: str | bytes, at: int) -> Iterator[str | int]:
    """The symbols of a long text from a position on, without a copy of the rest."""
    return (text[k] for k in range(at, len(text)))
