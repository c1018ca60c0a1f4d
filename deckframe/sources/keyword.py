"""Readers of keyword files as Arrow batches: blocks, typed rows, ids and fields.

A file of any size is many tasks: it is cut into ranges of ``CHUNK`` bytes, and a line belongs to the
range of its first byte. A first pass looks at each range alone and notes its keywords, how many
lines it has and how its last keyword goes on. From these notes, a row a range, windows make what a
range must know of those before it (its *context*): the number of its first block and line, and the
keyword that is open where it begins. All later passes read a range with its context, so no file is
read as a whole and no block is shuffled. Inside a range lines are handled as columns.

Rows keep explicit order keys (block_idx, pos); nothing relies on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from deckframe.functions.text import canonical_base, has_title, parse_float, parse_id, parse_int
from deckframe.library import FLOAT, INT, STR, Card, Field, Library, Schema, definition_of
from deckframe.sources import cards, files

#: Bytes of a file that one task reads at a time.
CHUNK = 8 << 20
#: Rows up to which a table of ranges or files is broadcast (some 300 bytes each); beyond it the join is by shuffle.
BROADCAST_ROWS = 100_000
HEAD_SCHEMA = (
    "path string, chunk int, n int, name string, base string, options array<string>, span_start long, span_end long, name_start long, body_start long, line long, title_offset int, "
    "lines long, long_format boolean, tail_rows long, names array<string>, own int"
)
_HEAD_NAMES = [c.strip().split()[0] for c in HEAD_SCHEMA.split(", ")]
#: Ids of one keyword's field, as parallel arrays.
ID_SCHEMA = "path string, chunk int, keyword string, field string, role string, per_line boolean, kinds array<string>, block_idx array<int>, row array<int>, line array<long>, id array<long>"
_ID_NAMES = [c.split()[0] for c in ID_SCHEMA.split(", ")]
PACK = 1 << 16


def read_range(path: str, start: int = 0, end: int | None = None) -> bytes:
    with files.open_file(path) as f:
        f.seek(start)
        return f.read() if end is None else f.read(end - start)


def _aligned(path: str, start: int, end: int, first: bool, last: bool) -> tuple[int, bytes]:
    """(offset, bytes) of the lines that begin in a range: a line belongs to the range of its first byte."""
    skip = 0 if first else 1
    data = read_range(path, start - skip, end)
    if skip:
        cut = data.find(b"\n") + 1
        if not cut:
            return end, b""
        start, data = start - 1 + cut, data[cut:]
    if not last and data and not data.endswith(b"\n"):
        data += _line_from(path, end)
    return start, data


def _line_from(path: str, at: int) -> bytes:
    """The bytes from a place to the end of its line."""
    out = b""
    with files.open_file(path) as f:
        f.seek(at)
        while more := f.read(4096):
            stop = more.find(b"\n")
            if stop >= 0:
                return out + more[: stop + 1]
            out += more
    return out


def _trivia_from(path: str, at: int) -> int:
    """Where the run of blank and comment lines that ends at a place begins."""
    size = 4096
    while True:
        begin = max(0, at - size)
        data = read_range(path, begin, at)
        if begin:
            cut = data.find(b"\n") + 1
            begin, data = begin + cut, data[cut:]
        found = cards._trivia(data, len(data))
        if found or not begin or at - size <= 0:
            return begin + found
        size *= 8


def _data_lines_from(path: str, at: int, want: int) -> bytes:
    """The lines from a place on until ``want`` data lines are there, or a keyword begins."""
    out, found, rest = b"", 0, b""
    with files.open_file(path) as f:
        f.seek(at)
        while found < want:
            more = f.read(1 << 16)
            rest += more
            *whole, rest = rest.split(b"\n") if more else [rest, b""]
            for x in whole:
                if x[:1] == b"*" or found == want:
                    return out
                found += not cards.skippable(x)
                out += x + (b"\n" if more or rest else b"")
            if not more:
                break
    return out


class Part:
    """The lines of one range: which are keywords, which data, and for each its keyword and its place among that one's data lines.

    Block 0 is the keyword that is open where the range begins; 1, 2 and so on begin in it. ``tail``
    adds up to so many data lines behind the range to its last keyword; ``owned`` counts the others.
    """

    def __init__(self, job: dict, tail: int = 0) -> None:
        self.job, self.path = job, job["path"]
        self.begin, data = _aligned(self.path, job["a"], job["b"], job["first"], job["last"])
        own = len(data)
        if tail and not job["last"] and data:
            data += _data_lines_from(self.path, self.begin + own, tail)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10) + 1
        if len(raw) and (not len(ends) or ends[-1] != len(raw)):
            ends = np.append(ends, len(raw))
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.ends, self.owned = ends, int(np.searchsorted(self.starts, own)) if len(ends) else 0
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
        self.lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data)])
        self.newlines = int(np.count_nonzero(raw[:own] == 10))
        self.head = raw[self.starts] == 42 if len(ends) else np.zeros(0, bool)
        self.skip = np.asarray(pc.match_substring_regex(self.lines, r"^[ \t\r\n]*(\$|$)")) if len(ends) else np.zeros(0, bool)
        self.at = np.flatnonzero(self.head)
        coded = self.lines.take(pa.array(self.at)).dictionary_encode()
        self.code, self.spelled = np.asarray(coded.indices), [_spelled(x) for x in coded.dictionary.to_pylist()]
        self.block = np.cumsum(self.head)
        data_line = ~self.head & ~self.skip
        run = np.cumsum(data_line)
        before = np.concatenate([[-(job.get("open_rows") or 0)], run[self.at]]).astype(np.int64)
        self.row = np.where(data_line, run - 1 - before[self.block], -1)

    @property
    def format(self) -> str:
        return cards.LONG if self.job["long_format"] else cards.FIXED

    def block_names(self) -> tuple[list[str], np.ndarray]:
        """(names, the number of its name for each block)."""
        names = [x[0] for x in self.spelled] + [self.job["open_name"] or ""]
        return names, np.concatenate([[len(names) - 1], self.code]).astype(np.int64)

    def block_idx(self) -> np.ndarray:
        return np.arange(self.job["block0"] - 1, self.job["block0"] + len(self.at), dtype=np.int32)

    def block_line(self) -> np.ndarray:
        return np.concatenate([[self.job["open_line"] or 0], self.job["line0"] + 1 + self.at]).astype(np.int64)

    def cells(self, at: np.ndarray, widths: Sequence[int]) -> list[pa.Array]:
        """The fields of some lines as trimmed text."""
        return _cells(self.lines.take(pa.array(at)), widths, self.format)


def _spelled(line: bytes) -> tuple[str, list[str], bool]:
    """(name, options, whether it asks for the long format) of a keyword line."""
    line = line.rstrip(b"\n")
    name = cards._NAME.match(line)
    return cards.text(name[1]), line[name.end() :].decode(errors="replace").split(), line[1:8].upper() == b"KEYWORD" and cards._LONG.match(line) is not None


# ranges and their context -------------------------------------------------------------------

_RANGE = "path string, chunk int, a long, b long, first boolean, last boolean"


def ranges(sizes: Sequence[tuple[str, int]]) -> Iterator[tuple]:
    """(path, chunk, a, b, first, last) of files with their sizes."""
    for path, size in sizes:
        n = max(1, -(-size // CHUNK))
        for k in range(n):
            yield path, k, k * CHUNK, min(size, (k + 1) * CHUNK), k == 0, k == n - 1


def heads(part: Part) -> pa.RecordBatch:
    """A row for each keyword that begins in a range, and one (n = -1) for the range itself."""
    n, own, spelled = len(part.at), part.owned, part.spelled
    plain = np.maximum.accumulate(np.where(part.skip[:own], -1, np.arange(own)))
    first = np.concatenate([[-1], plain])[part.at] + 1  # the lines where the trivia above keywords begin
    spans = (part.begin + part.starts[first]).astype(np.int64)
    if n and first[0] == 0 and not part.job["first"]:
        spans[0] = _trivia_from(part.path, part.begin)
    whole, text, flag, texts = pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())

    def column(values: pa.Array | np.ndarray | None, kind: pa.DataType, last: object) -> pa.Array:
        each = pa.nulls(n, kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.concat_arrays([each, pa.array([last], kind)])

    take = lambda values, kind: pa.array(values, kind).take(pa.array(part.code))
    return pa.RecordBatch.from_arrays([
        pa.array([part.path] * (n + 1)), pa.array(np.full(n + 1, part.job["chunk"], np.int32)), column(np.arange(n, dtype=np.int32), pa.int32(), -1),
        column(take([x[0] for x in spelled], text), text, spelled[part.code[-1]][0] if n else None),
        column(take([canonical_base(x[0]) for x in spelled], text), text, None),
        column(take([x[1] for x in spelled], texts), texts, None),
        column(spans, whole, int(spans[0]) if n else None),
        pa.concat_arrays([pa.array(spans[1:], whole), pa.nulls(2 if n else 1, whole)]),
        column((part.begin + part.starts[part.at]).astype(np.int64), whole, None),
        column((part.begin + part.ends[part.at]).astype(np.int64), whole, None),
        column((part.at + 1).astype(np.int64), whole, int(part.at[-1]) + 1 if n else None),
        column(take([int(has_title(x[0])) for x in spelled], pa.int32()), pa.int32(), None),
        column(None, whole, part.newlines), column(None, flag, any(x[2] for x in spelled)),
        column(None, whole, int(np.count_nonzero((part.block[:own] == n) & (part.row[:own] >= 0)))),
        column(None, texts, sorted({x[0].upper() for x in spelled})), column(None, pa.int32(), n),
    ], names=_HEAD_NAMES)


def scanned(spark: SparkSession, sizes: Sequence[tuple[str, int]]) -> tuple[DataFrame, int]:
    """(rows of ``heads`` for all ranges of some files, the number of ranges)."""
    jobs = list(ranges(sizes))
    frame = spark.createDataFrame(jobs, _RANGE).repartition(_tasks(spark, len(jobs)), "path", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                yield heads(Part(job))

    return frame.mapInArrow(run, HEAD_SCHEMA), len(jobs)


def _tasks(spark: SparkSession, jobs: int) -> int:
    return max(1, min(jobs, max(4 * spark.sparkContext.defaultParallelism, jobs // 16)))


#: A range with its context: block0 and line0 are the numbers of its first block and line, next_start is where the first keyword behind it begins, open_name, open_line and open_rows tell of the keyword that is open.
CONTEXT_SCHEMA = (
    "path string, chunk int, a long, b long, first boolean, last boolean, block0 int, line0 long, long_format boolean, byte_count long, next_start long, open_name string, open_line long, open_rows long, names array<string>"
)


def context_of(notes: Sequence[dict], size: int) -> list[dict]:
    """The contexts of one file's ranges from their notes, in order."""
    out, block0, line0, name, line, rows, is_long = [], 0, 0, None, None, 0, any(x["long_format"] for x in notes)
    for x in notes:
        k = x["chunk"]
        out.append({
            "path": x["path"], "chunk": k, "a": k * CHUNK, "b": min(size, (k + 1) * CHUNK), "first": k == 0, "last": (k + 1) * CHUNK >= size, "block0": block0, "line0": line0,
            "long_format": is_long, "byte_count": size, "next_start": None, "open_name": name, "open_line": line, "open_rows": rows, "names": x["names"],
        })
        rows = x["tail_rows"] + (0 if x["own"] else rows)
        if x["own"]:
            name, line = x["name"], line0 + x["line"]
        block0, line0 = block0 + x["own"], line0 + x["lines"]
    following = None
    for job, x in zip(reversed(out), reversed(notes), strict=True):
        job["next_start"] = following
        following = x["span_start"] if x["own"] else following
    return out


def contexts(found: DataFrame, sizes: Sequence[tuple[str, int]], n_ranges: int) -> DataFrame:
    """The context of every range, from rows of ``heads``: on the driver up to ``BROADCAST_ROWS`` ranges, else by windows."""
    spark = found.sparkSession
    if n_ranges > BROADCAST_ROWS:
        return windowed_contexts(found, spark.createDataFrame(sizes, "path string, byte_count long"))
    notes: dict[str, list[dict]] = {}
    for r in found.where("n = -1").select("path", "chunk", "name", "span_start", "line", "lines", "long_format", "tail_rows", "names", "own").orderBy("path", "chunk").collect():
        notes.setdefault(r.path, []).append(r.asDict())
    jobs = [tuple(job.values()) for path, size in sizes for job in context_of(notes[path], size)]
    return spark.createDataFrame(jobs, CONTEXT_SCHEMA)


def windowed_contexts(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``context_of`` for any number of ranges: windows over one row a range. ``sizes``: path, byte_count."""
    rows = found.where("n = -1").select("path", "chunk", F.col("name").alias("last_name"), F.col("span_start").alias("first_start"), F.col("line").alias("last_line"), "lines", "long_format", "tail_rows", "names", "own")
    rows = rows.join(sizes, "path")
    w = Window.partitionBy("path").orderBy("chunk")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("block0"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("line0"),
        F.max("long_format").over(Window.partitionBy("path")).alias("is_long"), F.first("first_start", ignorenulls=True).over(behind).alias("next_start"), F.last("last_name", ignorenulls=True).over(before).alias("open_name"),
    )
    rows = rows.withColumn("through", F.col("block0") + F.col("own")).withColumn("at_line", F.col("line0") + F.col("last_line"))
    kept = F.sum("tail_rows").over(Window.partitionBy("path", "through").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("kept", kept).withColumn("open_rows", F.coalesce(F.lag("kept").over(w), F.lit(0))).withColumn("open_line", F.last("at_line", ignorenulls=True).over(before))
    a = F.col("chunk").cast("long") * CHUNK
    return rows.select(
        "path", "chunk", a.alias("a"), F.least(F.col("byte_count"), a + CHUNK).alias("b"), (F.col("chunk") == 0).alias("first"), (a + CHUNK >= F.col("byte_count")).alias("last"),
        "block0", "line0", F.col("is_long").alias("long_format"), "byte_count", "next_start", "open_name", "open_line", "open_rows", "names",
    )


def blocks(found: DataFrame, context: DataFrame) -> DataFrame:
    """path, block_idx, name, base, options, span_start, span_end, name_start, body_start, line, format, title_offset."""
    own = found.where("n >= 0").select("path", "chunk", "n", "name", "base", "options", "span_start", "span_end", "name_start", "body_start", "line", "title_offset")
    end = F.coalesce("span_end", "next_start", "byte_count")
    return own.join(context.select("path", "chunk", "block0", "line0", "long_format", "next_start", "byte_count"), ["path", "chunk"]).select(
        "path", (F.col("block0") + F.col("n")).cast("int").alias("block_idx"), "name", "base", "options",
        # what stands above a file's first keyword belongs to it, whatever it is
        F.when(F.col("block0") + F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.col("span_start")).alias("span_start"), end.alias("span_end"), "name_start", F.least("body_start", end).alias("body_start"),
        (F.col("line0") + F.col("line")).alias("line"), F.when(F.col("long_format"), cards.LONG).otherwise(cards.FIXED).alias("format"), "title_offset",
    )


# typed rows ---------------------------------------------------------------------------------


def spark_type(f: Field) -> T.DataType:
    one = {INT: T.LongType(), FLOAT: T.DoubleType(), STR: T.StringType()}[f.type]
    return T.ArrayType(one) if f.count > 1 else one


def row_schema(schema: Schema, *, keys: bool = True) -> T.StructType:
    head = [T.StructField("path", T.StringType()), T.StructField("block_idx", T.IntegerType()), T.StructField("pos", T.LongType())] if keys else []
    return T.StructType(head + [T.StructField(n, spark_type(f)) for n, f in schema.columns()])


def _typed(column: pa.Array, kind: str) -> pa.Array:
    """Trimmed text to values: blank or unreadable text gives 0, 0.0 or the empty string."""
    if kind == STR:
        return column
    filled = pc.if_else(pc.equal(column, ""), "0", column)
    target, parse = (pa.int64(), parse_int) if kind == INT else (pa.float64(), parse_float)
    try:
        return pc.cast(filled, target)
    except pa.ArrowInvalid:
        return pa.array([parse(x) or 0 for x in filled.to_pylist()], target)


def _text(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_trim(pc.cast(column, pa.string()), " \t\r\n")
    except pa.ArrowInvalid:
        return pa.array([cards.text(x) for x in column.to_pylist()], pa.string())


def _cells(lines: pa.Array, widths: Sequence[int], fmt: str) -> list[pa.Array]:
    """The fields of lines, free or in columns line by line, as trimmed text."""
    free = np.asarray(pc.match_substring(lines, b",")) if fmt != cards.FREE else np.ones(len(lines), bool)
    if free.all() or not free.any():
        return _fields(lines, widths, cards.FREE if free.any() else fmt)
    back = pa.array(np.argsort(np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)]), kind="stable"))
    some, rest = _fields(lines.filter(pa.array(free)), widths, cards.FREE), _fields(lines.filter(pa.array(~free)), widths, fmt)
    return [pa.concat_arrays([a, b]).take(back) for a, b in zip(some, rest, strict=True)]


def _fields(lines: pa.Array, card_widths: Sequence[int], fmt: str) -> list[pa.Array]:
    """The fields of lines that are all free, or all in columns, as trimmed text."""
    if fmt == cards.FREE:
        parts = pc.split_pattern(lines, b",")
        ends, values = parts.offsets.to_numpy(), parts.values
        out = []
        for k in range(len(card_widths)):
            at = ends[:-1] + k
            out.append(_text(values.take(pa.array(at, mask=at >= ends[1:])).fill_null(b"")))
        return out
    out, at, scale = [], 0, 2 if fmt == cards.LONG else 1
    for w in card_widths:
        out.append(_text(pc.binary_slice(lines, at, at + w * scale)))
        at += w * scale
    return out


def _columns(schema: Schema, by_card: list[list[pa.Array]], n: int) -> list[pa.Array]:
    """Typed columns from the cells of each card."""
    out: list[pa.Array] = []
    for card, cells in zip(schema.cards, by_card, strict=True):
        at = 0
        for f in card.fields:
            typed = [_typed(x, f.type) for x in cells[at : at + f.count]]
            at += f.count
            if f.count == 1:
                out.append(typed[0])
            else:
                turn = pa.array(np.arange(n * f.count).reshape(f.count, n).T.ravel())
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * f.count + 1, f.count, dtype=np.int32)), pa.concat_arrays(typed).take(turn)))
    return out


def part_rows(part: Part, schema: Schema) -> pa.RecordBatch:
    """Rows of one keyword whose first card begins in a range."""
    names, code = part.block_names()
    wanted = np.array([x.upper() == schema.keyword.upper() for x in names])[code]
    k = len(schema.cards)
    data = np.flatnonzero((part.row >= 0) & wanted[part.block]) if len(part.block) else np.zeros(0, np.int64)
    row, block = part.row[data], part.block[data]
    begin = (row % k == 0 if schema.repeat else row == 0) & (data < part.owned)
    # a row is whole if its last card is there, in the same block
    last = np.flatnonzero(begin) + k - 1
    whole = last < len(data)
    whole[whole] = block[last[whole]] == block[last[whole] - k + 1]
    first = last[whole] - k + 1
    by_card = [part.cells(data[first + c], card.widths) for c, card in enumerate(schema.cards)]
    pos = part.begin + part.starts[data[first]] if len(first) else np.zeros(0, np.int64)
    head = [pa.array([part.path] * len(first), pa.string()), pa.array(part.block_idx()[block[first]], pa.int32()), pa.array(pos.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*head, *_columns(schema, by_card, len(first))], names=["path", "block_idx", "pos", *(c for c, _ in schema.columns())])


def rows(context: DataFrame, schema: Schema, n_ranges: int) -> DataFrame:
    """Typed rows of a keyword. Only ranges that have the keyword are read."""
    name = schema.keyword.upper()
    jobs = context.where(F.array_contains("names", name) | (F.upper("open_name") == name))
    tail = len(schema.cards) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                yield part_rows(Part(job, tail), schema)

    return _dealt(jobs, n_ranges).mapInArrow(run, row_schema(schema))


def _dealt(jobs: DataFrame, n_ranges: int) -> DataFrame:
    return jobs.repartition(_tasks(jobs.sparkSession, n_ranges), "path", "chunk")


# ids ----------------------------------------------------------------------------------------


def _id_values(column: pa.Array) -> pa.Array:
    """Trimmed text to ids, null where it is none; floats count."""
    try:
        return pc.cast(pc.if_else(pc.equal(column, ""), pa.scalar(None, pa.string()), column), pa.int64())
    except pa.ArrowInvalid:
        return pa.array([parse_id(x) for x in column.to_pylist()], pa.int64())


def _cards_of(layout: Schema, base: str, library: Library) -> list[tuple[int | None, Card]]:
    """(data line, or None for every one, and the card that it is read by)."""
    d = definition_of(base)
    if d and d.per_line or base in library.own and layout.repeat and len(layout.cards) == 1:
        return [(None, layout.cards[0])]
    return list(enumerate(layout.cards))


def part_ids(part: Part, library: Library, want: str) -> Iterator[tuple]:
    """(keyword, field, role, per_line, kinds, block_idx, row, line, ids) of what a range defines and refers to.

    ``def``: definitions, and references of cards; ``conn``: references of element lines, in place;
    ``distinct``: the different ids that element lines refer to.
    """
    names, code = part.block_names()
    if not len(part.block):
        return
    which, idx, lines = code[part.block], part.block_idx(), part.block_line()
    for u, name in enumerate(names):
        base, layout = canonical_base(name), library.find(name)
        d = definition_of(base)
        lined = bool(d and d.per_line)
        if layout is None or want != "def" and not lined:
            continue
        title = int(has_title(name))
        own = np.flatnonzero((which == u) & (part.row >= title))
        row = part.row[own] - title
        for number, card in _cards_of(layout, base, library):
            here = np.arange(len(own)) if number is None else np.flatnonzero(row == number)
            if not len(here) or not (d or any(f.refs for f in card.fields)):
                continue
            cells, at, distinct = None, 0, {}
            for k, f in enumerate(card.fields):
                defines = want == "def" and d is not None and k == 0 and (lined or number is None or number == d.card)
                refers = bool(f.refs) and (want == "def") != lined and not (lined and f.count > 1)
                for j in range(at, at + f.count) if defines or refers else ():
                    cells = cells or part.cells(own[here], card.widths)
                    ids = _id_values(cells[j])
                    if defines and j == 0:
                        keep = np.flatnonzero(np.asarray(pc.is_valid(ids)) & (lined | (row[here] == d.card)))
                        yield base, f.name, "def", lined, [d.kind], *_placed(part, ids, own[here], row[here], keep, idx, lines)
                    if refers and want == "distinct":
                        distinct.setdefault(f.refs, []).append(ids)
                    elif refers:
                        keep = np.flatnonzero(np.asarray(pc.fill_null(pc.not_equal(ids, 0), False)))
                        yield base, f.name, "conn" if lined else "ref", lined, list(f.refs), *_placed(part, ids, own[here], row[here], keep, idx, lines)
                at += f.count
            for refs, values in distinct.items():
                ids = pc.unique(pa.concat_arrays(values))
                ids = np.asarray(ids.filter(pc.fill_null(pc.not_equal(ids, 0), False)))
                void = np.zeros(len(ids), np.int64)
                yield base, "", "distinct", True, list(refs), void, void, void, ids


def _placed(part: Part, ids: pa.Array, own: np.ndarray, row: np.ndarray, keep: np.ndarray, idx: np.ndarray, lines: np.ndarray) -> tuple:
    """(block_idx, row, line, ids) of the ids that are kept."""
    at = own[keep]
    return idx[part.block[at]], row[keep], lines[part.block[at]] + part.row[at], np.asarray(ids.take(pa.array(keep)))


def packed_ids(context: DataFrame, library: Library, n_ranges: int, want: str = "def") -> DataFrame:
    """The ids of ranges, an array of up to ``PACK`` a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                for *head, block, row, line, ids in part_ids(Part(job), library, want):
                    for a in range(0, len(ids), PACK):
                        arrays = [pa.array([v[a : a + PACK].astype(t)]) for v, t in zip((block, row, line, ids), (np.int32, np.int32, np.int64, np.int64), strict=True)]
                        keyword, field, role, per_line, kinds = head
                        yield pa.RecordBatch.from_arrays([
                            pa.array([job["path"]]), pa.array([job["chunk"]], pa.int32()), pa.array([keyword]), pa.array([field]), pa.array([role]), pa.array([per_line]), pa.array([kinds], pa.list_(pa.string())), *arrays,
                        ], names=_ID_NAMES)

    return _dealt(context, n_ranges).mapInArrow(run, ID_SCHEMA)


def unpacked(packed: DataFrame) -> DataFrame:
    """A row an id, with its own block, row and line."""
    return packed.select("path", "chunk", "keyword", "field", "role", "per_line", "kinds", F.inline(F.arrays_zip("block_idx", "row", "line", "id")))


# fields -------------------------------------------------------------------------------------


def fields(context: DataFrame, library: Library, base: str, wanted: Sequence[str], n_ranges: int) -> DataFrame:
    """path, block_idx, line, and f_NAME for each field: its text in the first card that has it, null without that line. A row a keyword."""
    like = [base, f"{base}_TITLE", f"{base}_ID", f"{base}_ID_TITLE"]
    jobs = context.where(F.arrays_overlap("names", F.array(*(F.lit(x) for x in like))))
    layout = library.find(base)
    places: dict[str, tuple[int, int, Card]] = {}
    if layout is not None:
        for number, card in _cards_of(layout, base, library):
            at = 0
            for f in card.fields:
                if f.name.lower() in wanted:
                    places.setdefault(f.name.lower(), (number or 0, at, card))
                at += f.count
    tail = 1 + max((p[0] for p in places.values()), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                part = Part(job, tail)
                names, code = part.block_names()
                mine = np.flatnonzero(np.array([canonical_base(x) == base for x in names])[code[1:]]) + 1 if len(code) > 1 else np.zeros(0, np.int64)
                if not len(mine):
                    continue
                title = np.array([int(has_title(x)) for x in names])[code]
                row = part.row - title[part.block]
                slot = np.full(len(code), -1)
                slot[mine] = np.arange(len(mine))
                out = []
                for f in wanted:
                    texts = pa.nulls(len(mine), pa.string())
                    if f in places:
                        number, at, card = places[f]
                        own = np.flatnonzero((part.row >= title[part.block]) & (row == number) & (slot[part.block] >= 0))
                        source = np.full(len(mine), -1)
                        source[slot[part.block[own]]] = np.arange(len(own))
                        texts = part.cells(own, card.widths)[at].take(pa.array(source, mask=source < 0))
                    out.append(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * len(mine)), pa.array(part.block_idx()[mine], pa.int32()), pa.array(part.block_line()[mine], pa.int64()), *out], names=["path", "block_idx", "line", *(f"f_{f}" for f in wanted)],
                )

    return _dealt(jobs, n_ranges).mapInArrow(run, "path string, block_idx int, line long, " + ", ".join(f"`f_{f}` string" for f in wanted))


# spark.read.format("keyword") ---------------------------------------------------------------


class KeywordSource(DataSource):
    """``spark.read.format("keyword").option("keyword", "NODE").load(path)``: a keyword's rows of a file, or of a deck.

    ``layouts``: further layouts as JSON (see ``Library.load_json``). ``includes``: ``true`` for the
    files that the path includes, too. A partition is a range of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "keyword"

    def _layout(self) -> Schema:
        library = Library()
        if self.options.get("layouts"):
            library.load_json(self.options["layouts"])
        found = library.find(self.options["keyword"])
        if found is None:
            raise KeyError(self.options["keyword"])
        return Schema(self.options["keyword"].upper(), found.cards, found.repeat)

    def schema(self) -> T.StructType:
        return row_schema(self._layout())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _KeywordReader(self.options["path"], self._layout(), self.options.get("includes", "false").lower() == "true")


class _Range(InputPartition):
    def __init__(self, job: dict) -> None:
        self.job = job


def _note(job: tuple) -> dict:
    found = heads(Part(dict(zip([c.split()[0] for c in _RANGE.split(", ")], job, strict=True))))
    return found.slice(len(found) - 1).to_pylist()[0]


class _KeywordReader(DataSourceReader):
    def __init__(self, path: str, layout: Schema, includes: bool) -> None:
        self.path, self.layout, self.includes = path, layout, includes

    def _files(self) -> list[str]:
        if not self.includes:
            return [self.path]
        from deckframe.includes import walk

        return sorted({n.path for n in walk(self.path)})

    def partitions(self) -> list[InputPartition]:
        """Ranges with their context: files are looked through a range at a time, and only notes are kept."""
        out = []
        for path in self._files():
            size = files.size(path)
            notes = [_note(job) for job in ranges([(path, size)])]
            out += [_Range(job) for job in context_of(notes, size) if self.layout.keyword in {*job["names"], (job["open_name"] or "").upper()}]
        return out or [_Range({})]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.job:
            yield part_rows(Part(partition.job, len(self.layout.cards) - 1), self.layout)
