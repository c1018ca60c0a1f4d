"""State databases (d3plot) and interface-force files (intfor).

The driver reads the control block, the sizes of the geometry and the times of states; every state is
a (file, offset), so tasks read ranges of entities by byte range, geometry as well as results. Values come as one row a
(state, entity) with an array of words. Words are little-endian, 4 or 8 bytes wide.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.functions.shell import ShellLayout
from deckframe.operators import reductions
from deckframe.sources import files

#: The places of words in the control block.
WORDS = {
    "filetype": 11, "ndim": 15, "numnp": 16, "icode": 17, "nglbv": 18, "it": 19, "iu": 20, "iv": 21, "ia": 22, "nel8": 23, "nv3d": 27, "nel2": 28,
    "nv1d": 30, "nel4": 31, "nummat4": 32, "nv2d": 33, "neiph": 34, "neips": 35, "maxint": 36, "nmsph": 37, "narbs": 39, "nelth": 40, "nv3dt": 42,
    "ioshl1": 43, "ioshl2": 44, "ioshl3": 45, "ioshl4": 46, "ialemat": 47, "nmmat": 51, "npefg": 54, "nel48": 55, "idtdt": 56, "extra": 57,
    "nwear": 59, "npresu": 60, "nshear": 61, "nforce": 62, "ngapc": 63,
}
CONTROL, EOF, PRESENT, INTFOR = 64, -999999.0, 1000, 4
#: Entities that a task takes at a time, and files up to which the driver itself looks for states.
ENTITIES, FILES = 65_536, 64
#: The words of a connectivity record, the last one its part.
CONNECTIVITY = {"solid": 9, "tshell": 9, "beam": 6, "shell": 5}
COUNTS = {"solid": "nel8", "tshell": "nelth", "beam": "nel2", "shell": "nel4"}
#: The flags of the SPH section, in order.
SPH_FLAGS = ("words", "radius", "pressure", "stress", "plastic_strain", "density", "internal_energy", "neighbours", "strain", "mass", "history")
GLOBALS = ("kinetic_energy", "internal_energy", "total_energy", "velocity_x", "velocity_y", "velocity_z")
INTERFACE = ("wear", "pressure", "shear", "force", "gap")


class BadHeader(ValueError):
    """The file does not begin with a control block."""


class Unsupported(ValueError):
    """The file lacks what is asked for, or holds what is not supported."""


@dataclass
class Control:
    """The control block and what the geometry adds to it. Sizes are in words unless named otherwise."""

    word: int
    values: dict[str, int]
    nt3d: int = 0
    rigid_shells: int = 0
    coords: int = 0
    geometry: int = 0
    sph_vars: int = 0
    airbags: tuple[int, int, int, int, int] = (0, 0, 0, 0, 0)  # bags, geometry words, particle words, particles, bag words
    rigids: int = 0
    roads: int = 0

    def __getattr__(self, name: str) -> int:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def deletion(self) -> int:
        """0 none, 1 by node, 2 by element."""
        return 0 if self.maxint >= 0 else 2 if -self.maxint >= 10_000 else 1

    @property
    def layers(self) -> int:
        return self.maxint if self.maxint >= 0 else -self.maxint - 10_000 if self.deletion == 2 else -self.maxint

    def count(self, block: str) -> int:
        """Elements of a block that have results."""
        n = self.values[COUNTS[block]]
        return max(0, n - self.rigid_shells) if block == "shell" else n

    def node_extras(self) -> list[tuple[str, int]]:
        """Nodal fields between displacement and velocity, with their words a node."""
        heat, flags = self.it % 10, f"{max(0, self.idtdt):02d}"
        out = [("temperature", 3 if heat == 3 else 1)] if 1 <= heat <= 3 else []
        out += [("heat_flux", 3)] if heat in (2, 3) else []
        out += [("mass_scaling", 1)] if self.it // 10 % 10 == 1 else []
        out += [("temperature_gradient", 1)] if flags[-1] == "1" else []
        return out + ([("residual_force", 3), ("residual_moment", 3)] if flags[-2] == "1" else [])

    @functools.cached_property
    def layout(self) -> dict[str, tuple[int, int, int]]:
        """What a state holds, in order: name -> (first word, entities, words an entity). ``end`` is its size."""
        parts: list[tuple[str, int, int]] = [("time", 1, 1), ("global", 1, self.nglbv)]
        parts += [("displacement", self.numnp, 3)] if self.iu else []
        parts += [(name, self.numnp, k) for name, k in self.node_extras()]
        parts += [("velocity", self.numnp, 3)] if self.iv else []
        parts += [("acceleration", self.numnp, 3)] if self.ia else []
        parts.append(("solid_thermal", self.nel8, self.nt3d))
        parts += [("solid", self.nel8, self.nv3d), ("tshell", self.nelth, self.nv3dt), ("beam", self.nel2, self.nv1d), ("shell", self.count("shell"), abs(self.nv2d))]
        if self.deletion == 1:
            parts.append(("node_alive", self.numnp, 1))
        if self.deletion == 2:
            # flags are written for the shells that have results
            parts += [(f"{b}_alive", self.count(b), 1) for b in ("solid", "tshell", "shell", "beam")]
            parts.append(("_rest", self.nel4 - self.count("shell"), 1))
        bags, _, particle_words, particles, bag_words = self.airbags
        parts += [("sph", self.nmsph, self.sph_vars), ("airbag", bags, bag_words), ("airbag_particle", particles, particle_words), ("rigid_road", self.roads, 6)]
        parts.append(("rigid_body", self.rigids, 12 if self.ndim == 9 else 24))
        out, at = {}, 0
        for name, n, k in parts:
            out[name] = (at, n, k)
            at += n * k
        return out | {"end": (at, 0, 0)}

    @property
    def state_bytes(self) -> int:
        return self.layout["end"][0] * self.word


def read_control(data: bytes | files.Ranged) -> Control:
    """The control block, with the geometry walked."""
    def ints(word: int, size: int, n: int = 1) -> np.ndarray:
        raw = data[word * size : (word + n) * size]
        return np.frombuffer(raw, f"<i{size}") if len(raw) == n * size else np.array([0])

    size = next((s for s in (4, 8) if 2 <= ints(WORDS["ndim"], s)[0] <= 9), 0)
    if not size or len(data) < CONTROL * size:
        raise BadHeader("no plausible number of dimensions in the header")
    head = ints(0, size, CONTROL)
    signed = {"ndim", "it", "iu", "iv", "ia", "nv2d", "maxint", "ioshl1", "ioshl2", "ioshl3", "ioshl4", "idtdt", "npefg", "filetype", "icode"}
    c = Control(size, {k: int(head[w]) if k in signed else max(0, int(head[w])) for k, w in WORDS.items()})
    if not c.iu:
        raise Unsupported("no nodal displacement (IU is 0)")
    at = lambda w: int(ints(w, size)[0])
    natural = lambda w: max(0, at(w))
    if c.extra > 1:
        c.nt3d = natural(65)

    # The sections between the control block and the states, in the format's order: each says how
    # many words it takes, and may note what it finds at its beginning.
    def rigid_material(w: int) -> int:
        c.rigid_shells = natural(w)
        return 2 + c.nmmat

    def sph(w: int) -> int:
        flags = dict(zip(SPH_FLAGS, (at(w + k) for k in range(len(SPH_FLAGS))), strict=True))
        history = 0 if flags["words"] == len(SPH_FLAGS) - 1 else max(0, flags["history"])
        c.sph_vars = max(0, sum(flags[k] for k in SPH_FLAGS[1:8]) + abs(flags["strain"]) + flags["mass"]) + history + 1
        return max(0, flags["words"])

    def airbag(w: int) -> int:
        words, particle_words, particles, bag_words = (natural(w + k) for k in range(4))
        c.airbags = (c.npefg % 1000, words, particle_words, particles, bag_words)
        return 4 + (c.npefg // 1000 == 4) + 9 * (words + particle_words + bag_words)

    def rigid_bodies(w: int) -> int:
        c.rigids, end = natural(w), w + 1
        for _ in range(min(c.rigids, size_in_words)):
            end += 2 + natural(end + 1)
            end += 1 + natural(end)
        return end - w

    def rigid_roads(w: int) -> int:
        nodes, c.roads = natural(w), natural(w + 2)
        end = w + 4 + 4 * nodes
        for _ in range(min(c.roads, size_in_words)):
            end += 2 + 4 * natural(end + 1)
        return end - w

    size_in_words = len(data) // size
    before = [
        (c.ndim in (5, 7), rigid_material), (True, c.ialemat), (c.nmsph > 0, sph), (c.npefg > 0, airbag),
    ]
    behind = [
        (True, 3 * c.numnp), *((True, words * c.values[COUNTS[b]]) for b, words in CONNECTIVITY.items()), (True, c.narbs),
        (c.ndim in (8, 9), rigid_bodies), (True, 2 * c.nmsph), (True, lambda _: c.airbags[0] * c.airbags[1]), (c.ndim in (6, 9), rigid_roads), (True, 5 * c.nel48),
    ]

    def through(w: int, sections: list) -> int:
        for there, words in sections:
            if there:
                w += words(w) if callable(words) else words
            if w > size_in_words:
                raise BadHeader("the geometry reaches past the end of the file")
        return w

    c.coords = through(CONTROL + c.extra, before)
    c.geometry = through(c.coords, behind)
    return c


def family(base: str) -> list[str]:
    """The base file and its numbered siblings, by number."""
    base = base if files.is_uri(base) else os.path.abspath(base)
    files.size(base)
    pattern = re.compile(re.escape(os.path.basename(base)) + r"(\d+)\Z")
    numbered = [(int(m[1]), n) for n in files.names(os.path.dirname(base)) if (m := pattern.match(n))]
    return [base, *(os.path.join(os.path.dirname(base), n) for _, n in sorted(numbered))]


def _column(values: np.ndarray) -> pa.Array:
    """Numbers, or rows of numbers as lists."""
    if values.ndim == 1:
        return pa.array(values)
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def _words(path: str, word: int, at: int, n: int, kind: str = "f") -> np.ndarray:
    with files.open_file(path) as f:
        f.seek(at)
        return np.frombuffer(f.read(n * word), f"<{kind}{word}")


def state_times(path: str, at: int, size: int, word: int) -> list[tuple[int, float]]:
    """(offset, time) of the states of one file. An end marker ends this file only."""
    out, total = [], files.size(path)
    with files.open_file(path) as f:
        while at + size <= total:
            f.seek(at)
            time = float(np.frombuffer(f.read(word), f"<f{word}")[0])
            if time == EOF:
                break
            out.append((at, time))
            at += size
    return out


class D3plot:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.files = spark, family(base)
        with files.Ranged(self.files[0]) as data:
            self.control = read_control(data)
        #: (file, byte offset, time) of every state
        self.states: list[tuple[int, int, float]] = []
        size, word = self.control.state_bytes, self.control.word
        starts = [(k, p, self.control.geometry * word if k == 0 else 0) for k, p in enumerate(self.files)]
        for k, found in self._times(starts if size else []):
            self.states += [(k, at, t) for at, t in found]

    def _times(self, starts: list[tuple[int, str, int]]) -> list[tuple[int, list[tuple[int, float]]]]:
        """For each file the offsets and times of its states: a file is opened once, and many files by tasks."""
        size, word = self.control.state_bytes, self.control.word
        if len(starts) <= FILES:
            return [(k, state_times(p, at, size, word)) for k, p, at in starts]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, p, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = state_times(p, at, size, word)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["k", "at", "time"])

        jobs = self.spark.createDataFrame(starts, "k int, path string, at long").repartition(4 * self.spark.sparkContext.defaultParallelism, "k")
        out: dict[int, list] = {k: [] for k, *_ in starts}
        for r in jobs.mapInArrow(run, "k int, at long, time double").collect():
            out[r.k].append((r.at, r.time))
        return [(k, sorted(v)) for k, v in out.items()]

    # geometry -------------------------------------------------------------------------------

    def _geometry(self, word: int, n: int, kind: str) -> np.ndarray:
        return _words(self.files[0], self.control.word, word * self.control.word, n, kind)

    def node_coordinates(self) -> np.ndarray:
        """Initial coordinates, (nodes, 3)."""
        return self._geometry(self.control.coords, 3 * self.control.numnp, "f").astype(float).reshape(-1, 3)

    def _connectivity_at(self, block: str) -> int:
        w = self.control.coords + 3 * self.control.numnp
        for b, k in CONNECTIVITY.items():
            if b == block:
                break
            w += k * self.control.values[COUNTS[b]]
        return w

    def connectivity(self, block: str) -> tuple[np.ndarray, np.ndarray]:
        """(node indexes from 1, part indexes from 1) of the elements."""
        k, n = CONNECTIVITY[block], self.control.values[COUNTS[block]]
        raw = self._geometry(self._connectivity_at(block), k * n, "i").astype(np.int64).reshape(n, k)
        return raw[:, :-1], raw[:, -1]

    def ids(self, what: str) -> np.ndarray:
        """User ids of node, solid, beam, shell, tshell or part; 1, 2, 3 and so on without a numbering section."""
        c = self.control
        sizes = {"node": c.numnp, "solid": c.nel8, "beam": c.nel2, "shell": c.nel4, "tshell": c.nelth, "part": c.nmmat}
        w = self._ids_at(what)
        return np.arange(1, sizes[what] + 1) if w is None else self._geometry(w, sizes[what], "i").astype(np.int64)

    def _ids_at(self, what: str) -> int | None:
        """The word where user ids begin, None without a numbering section."""
        c = self.control
        sizes = {"node": c.numnp, "solid": c.nel8, "beam": c.nel2, "shell": c.nel4, "tshell": c.nelth, "part": c.nmmat}
        if not c.narbs or not sizes[what]:
            return None
        w = self._connectivity_at("shell") + CONNECTIVITY["shell"] * c.nel4
        head = 16 if self._geometry(w, 1, "i")[0] < 0 else 10
        return w + head + sum(n for k, n in list(sizes.items())[: list(sizes).index(what)])

    def part_titles(self) -> dict[int, str]:
        """User part ids to titles, from the section behind an end marker after the geometry."""
        word, titles = self.control.word, {}
        with files.Ranged(self.files[0]) as f:
            data = f[self.control.geometry * word :] if len(self.files) > 1 or not self.states else f[self.control.geometry * word : self.states[0][1]]
        value = lambda at: int.from_bytes(data[at : at + word], "little", signed=True)
        if len(data) < word or np.frombuffer(data[:word], f"<f{word}")[0] != EOF:
            return titles
        at, text = word, 72
        while at + word <= len(data):
            kind = value(at)
            if kind == 90000:
                at += word + text
            elif kind in (90001, 90002, 90020):
                n = max(0, value(at + word))
                at += 2 * word
                for _ in range(n):
                    if kind == 90001:
                        titles[value(at)] = data[at + word : at + word + text].decode(errors="replace").strip(" \0")
                    at += word + text
            elif kind == 90100:
                at += 2 * word + max(0, value(at + word)) * 80
            else:
                break
        return titles

    def blocks(self) -> list[str]:
        """The result blocks that states hold."""
        return [b for b, (_, n, k) in self.control.layout.items() if n * k and b not in ("time", "global", "_rest")]

    def shell_layout(self) -> ShellLayout:
        c = self.control
        stress, strain = c.ioshl1 == PRESENT, c.ioshl2 == PRESENT
        return ShellLayout(c.layers, 6 * stress + strain + c.neips, stress, strain, c.ioshl3 == PRESENT, c.ioshl4 == PRESENT)

    # states ---------------------------------------------------------------------------------

    def select_states(self, states: int | Sequence[int] | None) -> list[int]:
        """All states, one (negative counts from the end) or several; IndexError if there is no such state."""
        n = len(self.states)
        wanted = range(n) if states is None else [states] if isinstance(states, int) else states
        out = [s + n if s < 0 else s for s in wanted]
        if any(not 0 <= s < n for s in out):
            raise IndexError(f"the file has {n} states")
        return out

    @functools.cached_property
    def state_index(self) -> DataFrame:
        rows = [(i, self.files[f], at, t) for i, (f, at, t) in enumerate(self.states)]
        return self.spark.createDataFrame(rows, "state int, file string, offset long, time double")

    def block(self, name: str, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, entity (from 0), vars. A task reads a run of states, and of each only the block's bytes."""
        if name not in self.control.layout or name.startswith("_"):
            raise Unsupported(f"no block {name}")
        return self._read(name, states)

    def _read(self, name: str, states: int | Sequence[int] | None = None, beside: Sequence[str] = (), part: tuple[str, int] | None = None) -> DataFrame:
        """The block, with columns of the geometry beside it, for all entities or those of one part.

        A task has a range of entities and a run of states. It reads the geometry of its range once
        and then, of each state, just the bytes from the range's first wanted entity to its last.
        ``beside``: any of node_id, start, element_id, part_index, part_id. ``part``: (part_index or
        part_id, value). Nothing is joined and nothing but the rows asked for leaves the task.
        """
        at, n, k = self.control.layout[name]
        if not n * k:
            raise Unsupported(f"the file has no {name}")
        word, wanted = self.control.word, self.select_states(states)
        chunks, parallel = -(-n // ENTITIES), 4 * self.spark.sparkContext.defaultParallelism
        groups = max(1, min(len(wanted), -(-parallel // chunks)))
        index = self.state_index if states is None else self.state_index.where(F.col("state").isin(wanted))
        run_of = F.pmod("state", F.lit(groups))
        jobs = index.groupBy(run_of.alias("g")).agg(F.sort_array(F.collect_list(F.struct("state", "file", "offset", "time"))).alias("states"))
        jobs = jobs.select("g", "states", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(min(parallel, chunks * groups), "g", "chunk")
        places = self._places(name, beside, part)
        numbers = self.ids("part") if {"part_id"} & {*beside, *(part or ())[:1]} else None  # a row a part
        kinds = {"node_id": "long", "start": "array<double>", "element_id": "long", "part_index": "int", "part_id": "long"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for job in batch.to_pylist():
                    a, b = job["chunk"] * ENTITIES, min(n, (job["chunk"] + 1) * ENTITIES)
                    own = {c: read(a, b) for c, read in places.items()}
                    if numbers is not None:
                        p = own["part_index"]
                        own["part_id"] = np.where((p >= 1) & (p <= len(numbers)), numbers[np.clip(p - 1, 0, max(0, len(numbers) - 1))] if len(numbers) else p, p)
                    keep = np.arange(b - a) if part is None else np.flatnonzero(own[part[0]] == part[1])
                    if not len(keep):
                        continue
                    lo, hi = int(keep[0]), int(keep[-1]) + 1
                    extra = [_column(own[c][keep].astype(np.int32) if c == "part_index" else own[c][keep]) for c in beside]
                    for s in job["states"]:
                        values = _words(s["file"], word, s["offset"] + (at + (a + lo) * k) * word, (hi - lo) * k).astype(float).reshape(-1, k)[keep - lo]
                        m = len(keep)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, s["state"], np.int32)), pa.array(np.full(m, s["time"])), pa.array((keep + a).astype(np.int32)), _column(values), *extra], names=["state", "time", "entity", "vars", *beside],
                        )

        return jobs.mapInArrow(run, "state int, time double, entity int, vars array<double>" + "".join(f", {c} {kinds[c]}" for c in beside))

    def _places(self, name: str, beside: Sequence[str], part: tuple[str, int] | None) -> dict[str, Callable[[int, int], np.ndarray]]:
        """For each column of the geometry how a task reads it for a range of entities."""
        c, base, word = self.control, self.files[0], self.control.word
        need, out = {*beside, *(part or ())[:1]}, {}

        def reader(first: int, k: int, kind: str, column: int | None = None) -> Callable[[int, int], np.ndarray]:
            def read(a: int, b: int) -> np.ndarray:
                got = _words(base, word, (first + a * k) * word, (b - a) * k, kind).astype(float if kind == "f" else np.int64)
                return got if k == 1 else got.reshape(-1, k) if column is None else got.reshape(-1, k)[:, column]
            return read

        if "start" in need:
            out["start"] = reader(c.coords, 3, "f")
        for column, what in (("node_id", "node"), ("element_id", name)):
            if column in need:
                w = self._ids_at(what)
                out[column] = reader(w, 1, "i") if w is not None else lambda a, b: np.arange(a + 1, b + 1)
        if need & {"part_index", "part_id"}:
            k = CONNECTIVITY[name]
            out["part_index"] = reader(self._connectivity_at(name), k, "i", k - 1)
        return out

    def nodes(self, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, node_id, x, y, z: current coordinates, which is what the displacement block holds."""
        return self._read("displacement", states, ["node_id"]).select("state", "time", "node_id", *(F.col("vars")[i].alias(a) for i, a in enumerate("xyz")))

    def displacement_magnitude(self, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, entity, value: how far each node is from where it began."""
        moved = F.aggregate(F.zip_with("vars", "start", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return self._read("displacement", states, ["start"]).select("state", "time", "entity", F.sqrt(moved).alias("value"))

    def max_final_displacement(self) -> float:
        return float(self.displacement_magnitude(-1).agg(F.max("value")).first()[0] or 0.0)

    def global_history(self, name: str) -> DataFrame:
        """state, time, value of one of GLOBALS."""
        k = GLOBALS.index(name)
        if k >= self.control.nglbv:
            raise Unsupported(f"the file has no {name}")
        return self.block("global").select("state", "time", F.col("vars")[k].alias("value"))

    def part_history(self, name: str) -> DataFrame:
        """state, time, part_index (from 0), value: internal_energy, kinetic_energy, mass or hourglass_energy of every part."""
        n = self.control.nmmat
        start = 6 + {"internal_energy": 0, "kinetic_energy": 1, "mass": 5, "hourglass_energy": 6}[name] * n
        if not n or start + n > self.control.nglbv:
            raise Unsupported(f"the file has no {name} of parts")
        return self.block("global").select("state", "time", F.posexplode(F.slice("vars", start + 1, n)).alias("part_index", "value"))

    def alive(self, block: str, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, entity, alive: whether elements are not deleted."""
        if self.control.deletion != 2:
            raise Unsupported("the file marks no deleted elements")
        return self.block(f"{block}_alive", states).select("state", "time", "entity", (F.col("vars")[0] != 0).alias("alive"))

    def elements(self, block: str, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, entity, element_id, part_index (from 1), part_id, vars."""
        if block == "shell" and self.control.rigid_shells:
            raise Unsupported("shells of rigid bodies have no results, so shells cannot be told by their place")
        return self._read(block, states, ["element_id", "part_index", "part_id"]).select("state", "time", "entity", "element_id", "part_index", "part_id", "vars")

    def element(self, block: str, state: int, entity: int) -> np.ndarray:
        """The words of one element in one state: one read of its bytes."""
        at, n, k = self.control.layout[block]
        (s,) = self.select_states(state)
        if not 0 <= entity < n:
            raise IndexError(f"the file has {n} elements in {block}")
        f, offset, _ = self.states[s]
        return _words(self.files[f], self.control.word, offset + (at + entity * k) * self.control.word, k).astype(float)

    def _part(self, block: str, part_index: int | None, part_id: int | None) -> DataFrame:
        if (part_index is None) == (part_id is None):
            raise ValueError("give part_index or part_id")
        if block == "shell" and self.control.rigid_shells:
            raise Unsupported("shells of rigid bodies have no results, so shells cannot be told by their place")
        return self._read(block, part=("part_id", part_id) if part_index is None else ("part_index", part_index))

    def part_max_history(self, block: str, quantity: Column, part_index: int | None = None, part_id: int | None = None) -> DataFrame:
        """state, value: the largest quantity (a Column over ``vars``) of a part's elements, 0 at least."""
        return self._spine(reductions.part_max(self._part(block, part_index, part_id), quantity, ["state"]))

    def part_percentile_history(self, block: str, quantity: Column, percent: float, part_index: int | None = None, part_id: int | None = None) -> DataFrame:
        return self._spine(reductions.part_percentile(self._part(block, part_index, part_id), quantity, percent, ["state"]))

    def part_failure_fraction(self, block: str, quantity: Column, threshold: float, part_index: int | None = None, part_id: int | None = None) -> DataFrame:
        return self._spine(reductions.part_fraction(self._part(block, part_index, part_id), quantity, threshold, ["state"]))

    def part_argmax(self, block: str, quantity: Column, part_index: int | None = None, part_id: int | None = None) -> DataFrame:
        """state, entity, value of the first element that has the largest quantity; no row for a part without elements."""
        return reductions.part_argmax(self._part(block, part_index, part_id), quantity, "entity", ["state"])

    def part_elements(self, block: str, quantity: Column, part_index: int | None = None, part_id: int | None = None) -> DataFrame:
        """state, entity, value of every element of a part."""
        return self._part(block, part_index, part_id).select("state", "entity", quantity.alias("value"))

    def _spine(self, reduced: DataFrame) -> DataFrame:
        return reductions.with_states(self.state_index.select("state", "time"), reduced, ["state"])

    # interface forces -----------------------------------------------------------------------

    @property
    def is_intfor(self) -> bool:
        return self.control.filetype == INTFOR

    @property
    def is_fsifor(self) -> bool:
        return self.control.nv2d < 0

    def interface_fields(self) -> dict[str, tuple[int, int]]:
        """Field -> (first value, values) within a segment's record."""
        out, at = {}, 0
        for name, key in zip(INTERFACE, ("nwear", "npresu", "nshear", "nforce", "ngapc"), strict=True):
            out[name] = (at, self.control.values[key])
            at += self.control.values[key]
        return out

    def interface(self, name: str, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, segment, vars of one interface field."""
        at, n = self.interface_fields()[name]
        if not n:
            raise Unsupported(f"the file has no {name}")
        return self.block("shell", states).select("state", "time", F.col("entity").alias("segment"), F.slice("vars", at + 1, n).alias("vars"))

    def fsifor(self, column: int, states: int | Sequence[int] | None = None) -> DataFrame:
        """state, time, segment, value of one fixed column of an FSIFOR file."""
        if not self.is_fsifor or not 0 <= column < -self.control.nv2d:
            raise Unsupported(f"the file has no column {column}")
        return self.block("shell", states).select("state", "time", F.col("entity").alias("segment"), F.col("vars")[column].alias("value"))


# writing ------------------------------------------------------------------------------------


@dataclass
class Writer:
    """A single-precision d3plot, or with ``interface`` or ``fsifor`` an intfor file whose segments are the shells."""

    coordinates: np.ndarray
    solids: np.ndarray = field(default_factory=lambda: np.empty((0, 9), np.int32))
    shells: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int32))
    title: str = ""
    ids: dict[str, Sequence[int]] = field(default_factory=dict)
    shell_layers: int = 1
    interface: dict[str, int] = field(default_factory=dict)
    fsifor: int = 0
    states: list[tuple[float, dict[str, np.ndarray]]] = field(default_factory=list)

    def add_state(self, time: float, coordinates: np.ndarray, velocity: np.ndarray | None = None, acceleration: np.ndarray | None = None, solid: np.ndarray | None = None, shell: np.ndarray | None = None) -> None:
        """Results are (elements, words). What the first state has every state must have, in the same shape."""
        given = {"displacement": coordinates, "velocity": velocity, "acceleration": acceleration, "solid": solid, "shell": shell}
        own = {k: np.asarray(v, np.float32).reshape({"solid": len(self.solids), "shell": len(self.shells)}.get(k, len(self.coordinates)), -1) for k, v in given.items() if v is not None}
        for k in ("displacement", "velocity", "acceleration"):
            if k in own and own[k].shape[1] != 3:
                raise Unsupported(f"{k} must have three values a node")
        if self.states and {k: v.shape for k, v in own.items()} != {k: v.shape for k, v in self.states[0][1].items()}:
            raise Unsupported("every state must have what the first has")
        self.states.append((time, own))

    def to_bytes(self) -> bytes:
        first = self.states[0][1] if self.states else {}
        parts = int(max([0, *self.solids[:, -1], *self.shells[:, -1]]))
        nv3d, nv2d = (first[b].shape[1] if b in first else 0 for b in ("solid", "shell"))
        layer = nv2d // max(1, self.shell_layers)
        n, n8, n4 = len(self.coordinates), len(self.solids), len(self.shells)
        w = np.zeros(CONTROL, "<i4")
        intfor = bool(self.interface or self.fsifor)
        values = {
            "filetype": INTFOR if intfor else 1, "ndim": 4, "numnp": n, "icode": 6, "iu": 1, "iv": "velocity" in first, "ia": "acceleration" in first,
            "nel8": n8, "nv3d": nv3d, "nel4": n4, "nummat4": parts, "nv2d": -nv2d if self.fsifor else nv2d, "maxint": max(1, self.shell_layers), "nmmat": parts,
            "narbs": n + n8 + n4 + 3 * parts + 16,
        }
        values |= dict(zip(("nwear", "npresu", "nshear", "nforce", "ngapc"), (self.interface.get(k, 0) for k in INTERFACE), strict=True))
        if not intfor:
            stress, strain = max(nv3d, layer) >= 6, max(nv3d, layer) >= 7
            values |= {"ioshl1": PRESENT * stress, "ioshl2": PRESENT * strain, "neiph": max(0, nv3d - 6 * stress - strain), "neips": max(0, layer - 6 * stress - strain)}
        for k, v in values.items():
            w[WORDS[k]] = v
        ids = lambda k, count: np.asarray(self.ids.get(k, range(1, count + 1)), "<i4")
        head = np.zeros(16, "<i4")
        head[[0, 1, 2, 4, 6, 7, 9]] = [-1, n, n8, n4, n, n8, n4]
        head[13] = parts
        part = ids("part", parts)
        numbers = [head, ids("node", n), ids("solid", n8), ids("shell", n4), part, part, part]
        out = [self.title.encode()[:40].ljust(40), w[10:].tobytes(), np.asarray(self.coordinates, "<f4").tobytes(), np.asarray(self.solids, "<i4").tobytes(), np.asarray(self.shells, "<i4").tobytes(), *(x.tobytes() for x in numbers)]
        for time, own in self.states:
            out.append(np.array([time], "<f4").tobytes())
            out += [own[k].astype("<f4").tobytes() for k in ("displacement", "velocity", "acceleration", "solid", "shell") if k in own]
        return b"".join(out) + np.array([EOF], "<f4").tobytes()

    def write(self, path: str | os.PathLike) -> None:
        if self.fsifor or self.interface:
            want = self.fsifor or sum(self.interface.values())
            if any(own["shell"].shape[1] != want for _, own in self.states):
                raise Unsupported(f"segments must have {want} values")
        with open(path, "wb") as f:
            f.write(self.to_bytes())


class Editor:
    """Overwrites words of single-precision states in place, in a copy of the family's files."""

    def __init__(self, plot: D3plot) -> None:
        if plot.control.word != 4:
            raise Unsupported("only single precision can be edited")
        self.plot = plot
        self.data = {}
        for p in plot.files:
            with files.open_file(p) as f:
                self.data[p] = bytearray(f.read())

    def set_block(self, name: str, state: int, values: np.ndarray) -> None:
        at, n, k = self.plot.control.layout[name]
        (s,) = self.plot.select_states(state)
        values = np.asarray(values, "<f4")
        if values.size != n * k:
            raise Unsupported(f"{name} has {n} times {k} values")
        f, offset, _ = self.plot.states[s]
        begin = offset + at * 4
        self.data[self.plot.files[f]][begin : begin + 4 * n * k] = values.tobytes()

    def write(self, folder: str | os.PathLike) -> list[str]:
        out = []
        for p, data in self.data.items():
            out.append(os.path.join(folder, os.path.basename(p)))
            with open(out[-1], "wb") as f:
                f.write(data)
        return out
