"""The include graph of a deck: a breadth-first walk on the driver.

Only directives come to the driver. A generation's files are scanned by threads, or, where they
are large, by a Spark job; the walk itself must be sequential, as the search directories of a file
depend on its first visitor.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession

from deckframe.functions.text import parse_id
from deckframe.operators.ids import OFFSETS
from deckframe.sources import cards, files

#: Bytes of a generation from which Spark scans it instead of threads on the driver.
DISTRIBUTED_BYTES = 256 << 20
NONE = (0,) * len(OFFSETS)
Raw = tuple[str, str, tuple[int, ...]]


@dataclass(frozen=True)
class Directive:
    kind: str
    raw_path: str
    resolved_path: str
    exists: bool
    offsets: tuple[int, ...] = NONE


@dataclass
class FileNode:
    """A visited file. ``offsets``: those of its whole chain of includes, added up."""

    path: str
    kind: str | None = None
    parent: int | None = None
    depth: int = 0
    offsets: tuple[int, ...] = NONE
    search: tuple[str, ...] = ()
    byte_count: int = 0
    includes: list[Directive] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    readable: bool = True


def directives(data: bytes | mmap.mmap, strict: bool = False) -> list[Raw]:
    """(kind, raw path, offsets) of the include directives in a file's bytes, in order.

    ``strict`` reads offsets below a continued file name; by default they are taken from the
    second and third data line, however long the name.
    """
    out: list[Raw] = []
    heads = list(cards._KEYWORD.finditer(data))
    long_ = any(cards._LONG.match(m.group()) for m in heads if m.group()[1:8].upper() == b"KEYWORD")
    for k, m in enumerate(heads):
        kind = cards.include_kind(m.group())
        if kind is None:
            continue
        body = bytes(data[m.end() + 1 : heads[k + 1].start() if k + 1 < len(heads) else len(data)])
        name = cards.file_name(body)
        if name is None:
            continue
        offsets = NONE
        if kind == "include_transform":
            rows = cards.lines(body)
            if strict:
                while len(rows) > 1 and rows[0].rstrip(b" \t").endswith(b"+"):
                    rows.pop(0)
            cells = [parse_id(cards.text(x)) or 0 for i, n in ((1, 7), (2, 1)) if i < len(rows) for x in cards.slices(rows[i], [10] * n, cards.LONG if long_ else cards.FIXED)]
            offsets = tuple((cells + [0] * len(OFFSETS))[: len(OFFSETS)])
        out.append((kind, name, offsets))
    return out


def scan(path: str) -> tuple[int, list[Raw]] | None:
    """(bytes, directives) of a file, None if it cannot be read."""
    try:
        if files.is_uri(path):
            with files.open_file(path) as f:
                data = f.read()
            return len(data), directives(data)
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            if not size:
                return 0, []
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
                return size, directives(m)
    except OSError:
        return None


def scan_all(paths: Sequence[str], spark: SparkSession | None = None) -> list[tuple[int, list[Raw]] | None]:
    total = sum(files.size(p) for p in paths if files.exists(p))
    if spark is None or total < DISTRIBUTED_BYTES:
        with ThreadPoolExecutor(16) as pool:
            return list(pool.map(scan, paths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "found": [json.dumps(scan(p)) for p in b["path"]]})

    df = spark.createDataFrame(list(enumerate(paths)), "k int, path string").repartition(len(paths))
    found = {r.k: json.loads(r.found) for r in df.mapInPandas(run, "k int, found string").collect()}
    return [found[k] and (found[k][0], [(a, b, tuple(c)) for a, b, c in found[k][1]]) for k in range(len(paths))]


def _search_dir(kind: str, raw: str, parent: str) -> str | None:
    """The directory that a path directive adds: relative to the run, or to the including file."""
    return {"include_path": raw, "include_path_relative": os.path.join(parent, raw)}.get(kind)


def resolve(raw: str, parent: str, search: Sequence[str]) -> str:
    """Absolute; else beside the including file; else in the first search directory that has it; else beside it, missing."""
    beside = os.path.join(parent, raw)
    if files.absolute(raw) or files.exists(beside):
        return raw if files.absolute(raw) else beside
    return next((p for d in search if files.exists(p := os.path.join(d, raw))), beside)


def walk(root: str, scan_files: Callable[[Sequence[str]], list] = scan_all) -> list[FileNode]:
    """The files of a deck in breadth-first order. A file is visited once for each set of offsets it is included with, and never below itself."""
    nodes = [FileNode(files.real(root))]
    seen = {(nodes[0].path, NONE)}
    front = 0
    while front < len(nodes):
        begin, front = front, len(nodes)
        for idx, found in zip(range(begin, front), scan_files([n.path for n in nodes[begin:front]]), strict=True):
            node = nodes[idx]
            if found is None:
                node.readable = False
                continue
            node.byte_count, raw = found
            parent = os.path.dirname(node.path)
            own = [d for kind, name, _ in raw if (d := _search_dir(kind, name, parent)) is not None]
            search = (*node.search, *own)
            for kind, name, offsets in raw:
                path = resolve(name, parent, search)
                node.includes.append(Directive(kind, name, path, files.exists(path), offsets))
            for inc in node.includes:
                if not inc.exists or inc.kind in ("include_path", "include_path_relative"):
                    continue
                path, up = files.real(inc.resolved_path), idx
                while up is not None and nodes[up].path != path:
                    up = nodes[up].parent
                total = tuple(a + b for a, b in zip(node.offsets, inc.offsets, strict=True))
                if up is None and (path, total) not in seen:
                    seen.add((path, total))
                    node.children.append(len(nodes))
                    nodes.append(FileNode(path, inc.kind, idx, node.depth + 1, total, search))
    place = {i: k for k, i in enumerate(i for i, n in enumerate(nodes) if n.readable)}
    out = [n for n in nodes if n.readable]
    for n in out:
        n.children = [place[c] for c in n.children if c in place]
        n.parent = place.get(n.parent)
    return out


def tree(nodes: Sequence[FileNode], idx: int = 0) -> dict:
    """The nested form of the graph below a file."""
    n = nodes[idx]
    return {"path": n.path, "kind": n.kind, "byte_count": n.byte_count, "children": [tree(nodes, c) for c in n.children]}
