"""SentencePiece encoding and decoding as a weighted transducer in the tropical semiring.

``Machine`` compiles a model file into transducers (see ``wfst``): the normaliser (the model's
character map, longest entry first; white space becomes the mark U+2581, a mark is put in front),
the pieces (a path for every piece, weight minus its score) and the byte fallback (a character that
no piece covers becomes the pieces of its UTF-8 bytes). An input is composed with them, and the
shortest path is the encoding.

The normaliser is sequential: of what could be rewritten at a place the longest entry is, so one
path is left when it is composed with a text, and that path's output is the next machine's input.
The character map's own double array is the machine: its states are places in the array.

A *unigram* model needs nothing else: states are positions. The pieces of a *BPE* model are not
chosen by summed scores but by merging, so its transducer is also composed with an acceptor whose
states are pieces: piece b may follow piece a (weight one of the semiring, 0) exactly if merging
would leave the pair alone, else the weight is the semiring's zero, infinity. Just one path is
left, and it is the library's encoding (see ``bpe``).

No piece spans two *segments* (the compiler proves that from the pieces before it relies on it), so
shortest paths are taken segment by segment and kept in a table of bounded size.

Defined cases: a null text is encoded as an empty one, to no pieces; decoding replaces invalid
UTF-8 from byte pieces by U+FFFD; repeated rows are all returned; an empty table gives an empty
result; a text of any length is encoded whole, in time and memory that grow with its length; other
columns are ignored by ``encode`` and carried by nothing.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deckframe.llm.bpe import Neighbours
from deckframe.llm.common import rest
from deckframe.llm.wfst import FREE, LONE, ONE, Fallback, Trie, compose, shortest

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A unigram character that no piece covers costs this more than the worst piece.
UNKNOWN_COST = 10.0
#: Segments whose pieces are kept, in each of two generations, and the characters that such a segment has at most.
KEPT, KEPT_CHARS = 200_000, 48
#: Bytes of text in one batch of results.
BATCH = 4 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message: varints as int, the rest as bytes."""
    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[i]
            x |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
            yield tag >> 3, value
            continue
        if kind == 2:
            n, i = varint(i)
        else:
            n = {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + n]
        i += n


class CharMap:
    """The first transducer: entries of characters, each with what it becomes.

    The bytes are a double array over UTF-8 (32-bit units) and the outputs, each ended by a zero.
    A state is the place from which its arcs are counted, and whether an entry ends there.
    """

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.outputs = blob[4 + size :]
        self.start = self._base(self.units[0]) if self.units else 0
        # characters that stay as they are whatever ASCII character comes next
        plain = [c for c in map(chr, range(0x21, 0x7F)) if not self._extends(c)]
        self.plain = re.compile(rf"[{re.escape(''.join(plain))}]+(?=[\x00-\x7f]|\Z)") if plain else None

    @staticmethod
    def _base(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def step(self, state: int, byte: int) -> tuple[int, bool] | None:
        """(state, whether an entry ends) behind a byte."""
        at = state ^ byte
        if at >= len(self.units) or (unit := self.units[at]) & 0x800000FF != byte:
            return None
        return at ^ self._base(unit), bool(unit >> 8 & 1)

    def _extends(self, c: str) -> bool:
        """Whether an entry is this ASCII character, or begins with it and another."""
        first = self.step(self.start, ord(c))
        return first is not None and (first[1] or any(self.step(first[0], b) for b in range(1, 128)))

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(position behind, output) of the longest entry that begins at a position."""
        state, found = self.start, None
        for k in range(at, len(text)):
            for byte in text[k].encode("utf-8", "surrogatepass"):
                behind = self.step(state, byte)
                if behind is None:
                    state = None
                    break
                state, ends = behind
            if state is None:
                break
            if ends:
                found = k + 1, self.units[state] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.outputs[found[1] : self.outputs.index(b"\0", found[1])].decode()

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """(what comes out, whether it was rewritten) along the one path of a text."""
        at = 0
        while at < len(text):
            if self.plain and (m := self.plain.match(text, at)):
                yield m.group(), False
                at = m.end()
            elif (entry := self.longest(text, at)) is not None:
                at, out = entry
                yield out, True
            else:
                yield text[at], False
                at += 1


class Machine:
    """A compiled model. ``encode`` and ``decode`` of single texts; ``ids`` of a segment."""

    def __init__(self, model: bytes) -> None:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.fallback = bool(trainer.get(35, 0))
        self.prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        if trainer.get(24) or not normaliser.get(5, 1) or any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("models with white space as suffix or unescaped, or with user-defined or unused pieces are not supported")
        self.map = CharMap(normaliser[2]) if normaliser.get(2) else None
        self.pieces = [p for p, _, _ in pieces]
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        if self.kind == BPE:
            self.entries, self.lone = Trie((p, i, ONE) for p, i in self.id.items()), Fallback(ONE)
            self.after = Neighbours(self.id, lambda s: None if (x := self.score.get(s)) is None else -x, list)
        else:
            worst = min(self.score.values(), default=0.0) - UNKNOWN_COST
            self.entries, self.lone, self.after = Trie((p, i, -self.score[p]) for p, i in self.id.items()), Fallback(-worst), FREE
        self.segments = regex.compile(self._segments(), regex.S)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._decoder(pieces)

    def _segments(self) -> str:
        """A pattern for runs that no piece leaves or enters."""
        letter = regex.compile(r"\p{L}")
        kind = lambda c: "mark" if c == MARK else "letter" if letter.match(c) else "other"
        steps = {(kind(a), kind(b)) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        if self.kind == UNIGRAM or steps & {("letter", "mark"), ("other", "mark")}:
            # a unigram path may tie between segments only within floating error; take the whole text
            return r".+" if steps & {("letter", "mark"), ("other", "mark")} else rf"{MARK}*[^{MARK}]+|{MARK}+"
        if steps & {("letter", "other"), ("other", "letter")}:
            return rf"{MARK}*[^{MARK}]+|{MARK}+"
        return rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+"

    def _decoder(self, pieces: Sequence[tuple[str, float, int]]) -> None:
        """A flat table of the bytes that each piece writes."""
        out = [
            b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()
            for p, _, t in pieces
        ]
        self.width = np.array([len(x) for x in out], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    def normalise(self, text: str) -> str:
        if self.map is None:
            if self.squeeze:
                text = re.sub(" +", " ", text.strip(" "))
        else:
            text = self._mapped(text)
            if text is None:
                return ""
        out = (MARK if self.prefix and (text or self.map) else "") + text.replace(" ", MARK)
        return out.rstrip(MARK) if self.squeeze else out

    def _mapped(self, text: str) -> str | None:
        """The text rewritten by the map, runs of blanks made one; None if nothing but leading blanks comes out."""
        out, blank, begun = [], self.squeeze, False
        for x, rewritten in self.map.chunks(text):
            if not begun and self.squeeze and x == " ":
                continue
            begun = True
            if blank:
                x = x.lstrip(" ")
            if x:
                out.append(x)
                blank = self.squeeze and x[-1] == " "
        return "".join(out) if begun else None

    def shortest(self, segment: str) -> list[int]:
        """The labels on the shortest path: ids, and LONE + code point for a character that is no piece."""
        return shortest(compose(segment, self.entries, self.lone, self.after))

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for i in self.shortest(segment):
            if i < LONE:
                out.append(i)
            elif self.fallback:
                out += (self.bytes[b] for b in chr(i - LONE).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def packed(self, segment: str) -> bytes:
        """The ids of a segment as 32-bit integers. What a generation did not ask for again goes with it."""
        out = self.older.get(segment) or np.array(self.ids(segment), np.int32).tobytes()
        if len(segment) > KEPT_CHARS:
            return out
        if len(self.kept) >= KEPT:
            self.older, self.kept = self.kept, {}
        self.kept[segment] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        kept, made = self.kept.get, self.packed
        return np.frombuffer(b"".join([kept(s) or made(s) for s in self.segments.findall(self.normalise(text))]), np.int32)

    def write(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids write one after the other, and how many each writes."""
        width = self.width[ids]
        ends = np.cumsum(width)
        at = np.repeat(self.start[ids] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], width

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        text = self.write(ids)[0].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_machines: dict[bytes, Machine] = {}


def machine(model: bytes) -> Machine:
    """The compiled model, once for each Python process."""
    key = model[:64] + struct.pack("<q", hash(model))
    if key not in _machines:
        _machines[key] = Machine(model)
    return _machines[key]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_pieces, pieces (array of ids) and round_trip: whether decoding gives the normalised text back.

    Rows are encoded where they lie, in batches of bounded bytes; nothing is shuffled.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_column].dataType
    rows = docs.select(docs[id_column], docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model.value)
        for batch in batches:
            names, texts, begin, size = batch.column(0), batch.column(1), 0, 0
            ids: list[np.ndarray] = []
            parts: list[str] = []
            for at in range(len(batch)):
                parts.append(texts[at].as_py() or "")
                ids.append(m.encode(parts[-1]))
                size += len(parts[-1])
                if size >= BATCH or at == len(batch) - 1:
                    yield _batch(m, names.slice(begin, at + 1 - begin), parts, ids)
                    ids, parts, begin, size = [], [], at + 1, 0
        m.older = {}  # a resting process keeps one generation
        rest()

    return rows.mapInArrow(run, f"{id_column} {kind.simpleString()}, n_pieces bigint, pieces array<int>, round_trip boolean")


def _batch(m: Machine, names: pa.Array, texts: list[str], ids: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(x) for x in ids], np.int64)
    all_ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
    written, width = m.write(all_ids)
    per_id = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(n)
    stop, begin = per_id[ends], per_id[ends - n]
    back = written.tobytes()
    same = [back[b:e] == m.normalise(t).replace(MARK, " ").encode() for t, b, e in zip(texts, begin, stop, strict=True)]
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(all_ids))
    return pa.RecordBatch.from_arrays([names, pa.array(n), pieces, pa.array(same)], names=["id", "n_pieces", "pieces", "round_trip"])


def decode(encoded: DataFrame, model_path: str, id_column: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """id and text of encoded rows; null pieces give an empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(encoded[id_column], encoded[pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model.value)
        for batch in batches:
            texts = [m.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"{id_column} {encoded.schema[id_column].dataType.simpleString()}, text string")
