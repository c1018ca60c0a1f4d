"""Token counts by prefix dynamic programming.

A byte-level BPE file is read into a table of tokens. A text is cut into the pre-tokens that the
tokenizer never merges across; inside a pre-token a left-to-right table over its bytes holds, for
every prefix, the last token and so the exact count (see ``bpe``). Running sums over the
pre-tokens give the count at every prefix of the text that ends with one. ``PrefixCounts`` answers
how many tokens any prefix has, and how much of a text fits a budget: sums answer for all
pre-tokens but the one in which the prefix ends, and that one's table of prefixes, made once and
kept for further questions, answers for the rest. Nothing is encoded again for another prefix.

Defined cases: a null text is empty and has no tokens; the strings of special tokens inside a text
count as one token, the library's default; repeated rows are all returned; an empty table gives an
empty result; a text of any length is counted whole, in time and memory that grow with its length,
also where it has no white space; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deckframe.llm.bpe import Neighbours, Prefixes
from deckframe.llm.common import rest

#: Fixed value: the pre-token pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: What the pattern takes for white space; Python's own notion has four separators (0x1C to 0x1F) more.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
#: Pre-tokens whose counts are kept, in each of two generations, and the characters that such a one has at most.
KEPT, KEPT_CHARS = 400_000, 48
ROWS = 2_000


def _letters() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts for one tokenizer file (byte-level BPE with the usual pre-tokens)."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normaliser or prefix space are supported")
        of = _letters()
        raw = lambda s: bytes(of[c] for c in s)
        special = {x["content"] for x in spec.get("added_tokens", ())}
        self.tokens = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [raw(a) + raw(b) for a, b in pairs]
        rank = {x: i for i, x in reversed(list(enumerate(merged)))}
        if len(rank) != len(merged):
            raise ValueError("two merges make the same token")
        halves = {x: (raw(a), raw(b)) for x, (a, b) in zip(merged, pairs, strict=True)}
        self.table = Prefixes(self.tokens, _Halves(self.tokens, rank, halves))
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.cut = regex.compile(PATTERN)
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.long: tuple[str, list[int]] = ("", [])

    def inner(self, pre_token: str) -> list[int]:
        """The count at every prefix of a pre-token's bytes. The last long one's are kept: total and budget ask for the same."""
        if len(pre_token) <= KEPT_CHARS:
            return self.table.counts(pre_token.encode())
        if self.long[0] != pre_token:
            self.long = pre_token, self.table.counts(pre_token.encode())
        return self.long[1]

    def by_character(self, pre_token: str) -> np.ndarray:
        """The count at every prefix of a pre-token's characters, the empty one included."""
        data = pre_token.encode()
        counts = np.array(self.inner(pre_token), np.int64)
        begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return counts[np.append(begins, len(data))]

    def of(self, pre_token: str) -> int:
        """The count of a pre-token. What a generation did not ask for again goes with it."""
        n = self.older.get(pre_token) or self.inner(pre_token)[-1]
        if len(pre_token) > KEPT_CHARS:
            return n
        if len(self.kept) >= KEPT:
            self.older, self.kept = self.kept, {}
        self.kept[pre_token] = n
        return n

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special token's string, the text) in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def cuts(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens of a text and the count of each."""
        kept, of, pieces, counts = self.kept.get, self.of, [], []
        for special, part in self.parts(text):
            own = [part] if special else self.cut.findall(part)
            pieces += own
            counts += [1] if special else [kept(p) or of(p) for p in own]
        return pieces, counts

    def ordinary(self, text: str) -> list[str]:
        """The pre-tokens of a text in which no special token is looked for."""
        return self.cut.findall(text)

    def prefixes(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


class _Halves(Neighbours):
    """Merges where a token has one way to be merged: the two halves must be those of the merge."""

    def __init__(self, tokens: dict[bytes, int], rank: dict[bytes, int], halves: dict[bytes, tuple[bytes, bytes]]) -> None:
        super().__init__(tokens, rank.get, lambda s: [s[i : i + 1] for i in range(len(s))])
        self.halves = halves

    def merge(self, text: bytes) -> list[bytes]:
        parts = self.unit(text)
        while len(parts) > 1:
            best, pair = None, None
            for a, b in zip(parts, parts[1:], strict=False):
                r = self.rank(a + b)
                if r is not None and (best is None or r < best) and self.halves[a + b] == (a, b):
                    best, pair = r, (a, b)
            if pair is None:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class PrefixCounts:
    """The exact token count at every prefix of one text: running sums over its pre-tokens, and inside one the table of its prefixes."""

    def __init__(self, counter: Counter, text: str, special: bool = True) -> None:
        self.counter, self.text = counter, text
        if special:
            self.pieces, counts = counter.cuts(text)
        else:
            self.pieces = counter.ordinary(text)
            counts = [counter.kept.get(p) or counter.of(p) for p in self.pieces]
        self.ends = np.fromiter(accumulate(map(len, self.pieces)), np.int64, len(self.pieces))
        self.sums = np.cumsum(np.array(counts, np.int64))
        self.special = special
        self._inside: tuple[int, int, np.ndarray] = (-1, 0, np.zeros(1, np.int64))

    @property
    def total(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def _before(self, k: int) -> tuple[int, int]:
        """(characters, tokens) of the first k pre-tokens."""
        return (int(self.ends[k - 1]), int(self.sums[k - 1])) if k else (0, 0)

    def _is_special(self, k: int) -> bool:
        return self.special and self.counter.special is not None and self.counter.special.fullmatch(self.pieces[k]) is not None

    def inside(self, k: int) -> tuple[int, np.ndarray]:
        """(start, counts): the count of every prefix of the text that ends in pre-token k, from ``start`` on.

        A prefix is cut like the whole text, but for its end: white space at its end is one
        pre-token, so ``start`` is where the white space before the pre-token begins; an apostrophe
        stands alone until its contraction is whole; and what begins a special token is ordinary
        text, which may go on the pre-token before it.
        """
        if self._inside[0] == k:
            return self._inside[1:]
        first = k
        if self._is_special(k) and first and not self._is_special(first - 1):
            first -= 1
        while first and not self.pieces[first - 1].strip(_BLANKS) and not self._is_special(first - 1):
            first -= 1
        start, before = self._before(first)
        run, c = "".join(self.pieces[first : k + 1]), self.counter
        if self._is_special(k):
            own = PrefixCounts(c, run, special=False)
            counts = np.concatenate([own.inside(j)[1][(0 if not j else int(own.ends[j - 1]) - own.inside(j)[0] + 1) :] for j in range(len(own.pieces))])
            counts[-1] = (self._before(k)[1] - before) + 1
        else:
            body = run.lstrip(_BLANKS)
            blank = len(run) - len(body)
            counts = c.by_character(run[:blank])
            if body:
                last = self.pieces[k]
                head, inner = self._before(k)[1] - before, c.by_character(last)
                if last[0] == "'" and len(last) > 1 and last[1].isalpha():
                    inner = np.array([0, *(sum(c.of(x) for x in c.ordinary(last[:n])) for n in range(1, len(last) + 1))])
                counts = np.concatenate([counts, head + inner[len(last) - len(body) + 1 :]])
        self._inside = (k, start, before + counts)
        return start, self._inside[2]

    def at(self, chars: int) -> int:
        """The number of tokens of the first ``chars`` characters, encoded on their own."""
        if chars <= 0:
            return 0
        if chars >= len(self.text):
            return self.total
        start, counts = self.inside(int(np.searchsorted(self.ends, chars)))
        return int(counts[chars - start])

    def fit(self, budget: int) -> int:
        """How many characters fit: the longest prefix within ``budget`` tokens that ends no later than the pre-token in which the sum passes it."""
        k = int(np.searchsorted(self.sums, budget, side="right"))
        if k == len(self.ends):
            return len(self.text)
        start, counts = self.inside(k)
        return start + int(np.flatnonzero(counts <= budget)[-1])


_counters: dict[int, Counter] = {}


def counter(content: str) -> Counter:
    """The compiled file, once for each Python process."""
    if (key := hash(content)) not in _counters:
        _counters[key] = Counter(content)
    return _counters[key]


def count(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars: the characters that fit ``limit`` tokens. Nothing is shuffled."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(docs[id_column], docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(content.value)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                size, tokens, over, fits = [], [], [], []
                for value in part.column(1):
                    t = value.as_py() or ""
                    size.append(len(t.encode()))
                    p = c.prefixes(t)
                    tokens.append(p.total)
                    over.append(p.total > limit)
                    fits.append(p.fit(limit) if p.total > limit else len(t))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fits, pa.int64())],
                    names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )
        c.older, c.long = {}, ("", [])  # a resting process keeps one generation
        rest()

    return rows.mapInArrow(run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
