"""Byte-pair encodings as paths: which token may follow which.

A sequence of tokens is the encoding of its text exactly if every token encodes to itself and no
two neighbours, encoded together, would have merged across their border. (Take the first merge
that crosses a border: it needs nothing outside the two tokens, so it also happens to the pair
alone.) The encoding is therefore the one path through the lattice of tokens whose neighbours all
agree, every prefix of a text has just one last token, and a left-to-right table finds it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from deckframe.llm.wfst import LONE, ONE, ZERO, Trie


class _Row(dict):
    """label -> weight after one token, filled as it is asked for."""

    def __init__(self, owner: Neighbours, before: int) -> None:
        self.owner, self.before = owner, before

    def __missing__(self, label: int) -> float:
        self[label] = found = self.owner.judge(self.before, label)
        return found


class Neighbours(dict):
    """The acceptor of merges: the weight of token b after token a is ``ONE`` if merging leaves the pair alone, else ``ZERO``.

    Texts are str or bytes; answers are kept, up to ``most`` of them.
    """

    def __init__(self, tokens: Mapping, rank: Callable[[object], float | None], unit: Callable[[object], list], most: int = 500_000) -> None:
        """tokens: string -> id. rank: of a merged string, lower merges first, None if it is no token. unit: splits a string into the symbols that merging starts from."""
        self.rank, self.unit, self.most = rank, unit, most
        self.string = {i: s for s, i in tokens.items()}
        self.bytes = isinstance(next(iter(tokens), ""), bytes)
        self.answers = 0

    def merge(self, text: object) -> list:
        """The encoding of a short string, by merging the best neighbours first, leftmost on ties."""
        parts = self.unit(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, token: int) -> object:
        """The string of a token, or of a lone symbol."""
        if token < LONE:
            return self.string[token]
        return bytes([token - LONE]) if self.bytes else chr(token - LONE)

    def __missing__(self, before: int) -> _Row:
        self[before] = row = _Row(self, before)
        return row

    def judge(self, before: int, token: int) -> float:
        """The weight itself, by merging."""
        self.answers += 1
        if self.answers > self.most:
            self.clear()
            self.answers = 1
        b = self.name(token)
        if before < 0:
            return ONE if self.merge(b) == [b] else ZERO
        a = self.name(before)
        return ONE if self.merge(a + b) == [a, b] else ZERO


class Prefixes:
    """The table of counts at every prefix of a byte string, left to right."""

    def __init__(self, tokens: Mapping[bytes, int], after: Neighbours) -> None:
        self.after = after
        self.start = Trie((s, i, ONE) for s, i in tokens.items()).start

    def counts(self, text: bytes) -> list[int]:
        """How many tokens each prefix has. Every prefix has one encoding, so its last token is enough to go on."""
        n, start, after = len(text), self.start, self.after
        last, out = [-1] * (n + 1), [-1] * (n + 1)
        out[0] = 0
        for at in range(n):
            if out[at] < 0:
                raise ValueError("a byte is no token")
            weight, more, state = after[last[at]], out[at] + 1, start
            for k in range(at, n):
                state = state.get(text[k])
                if state is None:
                    break
                if out[k + 1] < 0 and None in state:
                    token = state[None][0]
                    if weight[token] == ONE:
                        last[k + 1], out[k + 1] = token, more
        return out
