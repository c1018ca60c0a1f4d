"""Secret scans: fixed patterns, and novelty against a primed compressor.

Base kinds are patterns. The method adds ``novel`` spans: a candidate is a long run of token
characters that mixes classes and stands near a sensitive word. A zstandard compressor is primed
with a dictionary of identifiers and code; the candidate's *marginal* size is what it adds to its
surroundings when both are compressed together. Names, paths and words are in the dictionary or
repeat what surrounds them and add little; a candidate that adds nearly its own length in bytes
cannot be predicted, and is reported unless a base span covers it. Surroundings are taken without
what they share with the candidate in ``SHARED`` characters or more, so a secret that stands
several times is measured at every place as if it stood there alone.

Defined cases: a null text is empty and has no spans; repeated rows are all returned; an empty
table gives an empty result; offsets count code points, ends are exclusive; a text of any length is
scanned whole, in time that grows with its length; other columns are ignored by ``scan`` and
carried by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckframe.llm.common import rest


#: Kinds in the order by which spans with one start are sorted.
KINDS = ("assign", "access", "hex", "novel")
#: The pattern's letters in either case, written out so that only ASCII letters fold.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What may be a secret: token characters in a row. Runs have no upper bound here, but a piece of at most PIECE is measured at a time.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CONTEXT = re.compile(r"(?i:pass|pwd|secret|token|key|auth|bearer|credential|private|session|cookie|signature|aws|access)", re.A)
NEAR = 80
AROUND = 256
#: Characters in a row from which surroundings hold a copy of the candidate: the least that a candidate has.
SHARED = 20
PIECE = 4096
#: Marginal bytes over bytes from which a candidate counts as incompressible. Random base 64 needs 0.75, random hex 0.5.
NOVEL = 0.62

#: Fixed value: identifiers and code that compress well must not look novel.
IDENTIFIERS = """
public static final void class import return function const let var self this null None true false
password passwd secret token api_key apiKey access_key access_token refresh_token client_secret client_id
private_key public_key authorization Authorization: Bearer Basic session_id csrf_token X-Api-Key X-Auth-Token
getElementById addEventListener querySelector createElement innerHTML documentElement application/json
Content-Type text/html; charset=utf-8 https://www.example.com/path/to/resource/index.html?query=value
AbstractFactoryBeanConfiguration ApplicationContext ConnectionPoolManager DataSourceTransactionManager
user_name user_id first_name last_name created_at updated_at description configuration environment
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 0123456789ABCDEF
BEGIN RSA PRIVATE KEY END RSA PRIVATE KEY BEGIN CERTIFICATE END CERTIFICATE ssh-rsa
/usr/local/lib/python/site-packages/ /home/user/.config/ /var/log/ node_modules/ src/main/java/com/example/
SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE PRIMARY KEY FOREIGN KEY REFERENCES
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx ******************************** ================================
""".strip()


class Novelty:
    """Marginal compressed sizes under the primed dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6) -> None:
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def marginal(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, over its own bytes. Long candidates are measured in pieces and averaged."""
        around = self.size(before + after)
        pieces = [candidate[i : i + PIECE] for i in range(0, len(candidate), PIECE)]
        added = sum(max(0, self.size(before + p + after) - around) for p in pieces)
        return added / len(candidate.encode())


def without(text: str, start: int, end: int, candidate: str) -> str:
    """``text[start:end]`` without what it shares with the candidate, also where the range cuts a copy."""
    lo, hi = max(0, start - SHARED + 1), min(len(text), end + SHARED - 1)
    kept, at = [], start
    for i in range(lo, hi - SHARED + 1):
        if text[i : i + SHARED] in candidate:
            kept.append(text[at : max(at, min(i, end))])
            at = max(at, min(i + SHARED, end))
    return "".join(kept) + text[at:end]


def mixed(candidate: str) -> bool:
    """Digits with letters, or both cases within: what no plain word shows."""
    digit = any(c.isdigit() for c in candidate)
    lower = any(c.islower() for c in candidate)
    upper = any(c.isupper() for c in candidate[1:])
    return digit + lower + upper >= 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return [(s, e, KINDS[k]) for s, k, e in found]


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Incompressible strings near sensitive words that no base span overlaps."""
    taken: list[list[int]] = []  # the base spans' union: apart from each other and in order, so one pointer follows the candidates
    for s, e, _ in base:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e or not mixed(m.group()):
            continue
        if not CONTEXT.search(text[max(0, s - NEAR) : s]):
            continue
        before, after = without(text, max(0, s - AROUND), s, m.group()), without(text, e, min(len(text), e + AROUND), m.group())
        if novelty.marginal(before, m.group(), after) >= NOVEL:
            out.append((s, e, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), both in order."""
    base = base_spans(text)
    extra = novel_spans(text, base, novelty)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]))) if extra else base


def scan(docs: DataFrame, identifiers: str = IDENTIFIERS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_novel. Nothing is shuffled."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for value in batch.column(1):
                base, every = find(value.as_py() or "", novelty)
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n["assign"], n["access"], n["hex"], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n["novel"]],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    return docs.select(docs[id_column], docs[text]).mapInArrow(
        run, f"{id_column} {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    )


def masked(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, or union of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, identifiers: str = IDENTIFIERS, text: str = "text") -> DataFrame:
    """``docs`` with its columns, every secret in the text replaced by a mark; a null text stays null.

    Only the text goes through Python, and n_chars follows it where there is one of a whole-number type.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            clean = []
            for value in batch.column(at):
                t = value.as_py()
                if t:
                    _, spans = find(t, novelty)
                    t = masked(t, spans) if spans else t
                clean.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
        rest()

    out = docs.mapInArrow(run, docs.schema)
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out
