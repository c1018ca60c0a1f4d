"""Time histories as DataFrames.

The driver reads symbol tables only; ``leaves`` has a row for every dataset, and values are decoded
in tasks, each a run of states. The long form has a row for every (branch, state, column).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.sources import lsda

LEAVES = "path string, branch string, state string, var string, file string, type int, data long, count long, little boolean"


_PLACE = "struct<file:string,type:int,data:bigint,count:bigint,little:boolean>"


def _place(leaf: lsda.Leaf, paths: Sequence[str]) -> tuple:
    return paths[leaf.file], leaf.type, leaf.data, leaf.count, leaf.little


def _leaf(place: dict) -> lsda.Leaf:
    return lsda.Leaf(place["type"], place["data"], place["count"], 0, place["little"])


def _is_state(name: str) -> bool:
    return len(name) > 1 and name[0] == "d" and name[1:].isascii() and name[1:].isdigit()


class Binout:
    def __init__(self, spark: SparkSession, pattern: str | list[str], run_id: str = "") -> None:
        self.spark, self.run_id = spark, run_id
        self.paths = lsda.family(pattern)
        self.tree = lsda.read_tree(self.paths)

    # the tree -------------------------------------------------------------------------------

    def read(self, *path: str, **select: object) -> list[str] | np.ndarray:
        """What a path stands for.

        A dataset gives its values; a branch with states the names of its variables; any other
        directory its names; and a branch and a variable all states of it, (states,) or (states,
        columns), of which ``id``, ``ids``, ``name`` or ``names`` selects columns.
        """
        if select:
            if len(path) != 2:
                raise ValueError("columns are selected of a branch and a variable")
            return self.matrix(*path, **select)[1]
        try:
            node = self.tree.find(*path)
        except KeyError:
            if len(path) == 2 and any(path[1] in self.tree.find(path[0], s).children for s in self.states(path[0])):
                values = self.matrix(*path)[1]
                return values[:, 0] if values.shape[1] == 1 else values
            raise
        if not isinstance(node, lsda.Tree):
            return node.read(self.paths[node.file])
        first = next((k for k in sorted(node.children) if _is_state(k)), None)
        return sorted(node.children if first is None else node.children[first].children)

    def read_many(self, paths: Sequence[Sequence[str]]) -> list[list[str] | np.ndarray]:
        return [self.read(*p) for p in paths]

    def read_f64(self, *path: str) -> np.ndarray:
        got = self.read(*path)
        return np.array([]) if isinstance(got, list) or got.dtype.kind == "S" else got.astype(float)

    def channels(self, *path: str) -> list[str]:
        """The names in a directory as they are."""
        node = self.tree.find(*path)
        return sorted(node.children) if isinstance(node, lsda.Tree) else []

    def _meta(self, branch: str, name: str) -> bytes:
        got = self.read(branch, "metadata", name)
        return got.tobytes() if got.dtype.kind == "S" else bytes(got.astype(np.uint8))

    def ids(self, branch: str) -> list[int]:
        try:
            return [int(x) for x in self.read(branch, "metadata", "ids")]
        except KeyError:
            return []

    def legend(self, branch: str) -> list[str]:
        """Names of the entities: equal parts of one text."""
        n, raw = len(self.ids(branch)), self._meta(branch, "legend")
        if not n or not raw:
            return []
        width = max(1, len(raw) // n)
        return [raw[i : i + width].decode(errors="replace").strip() for i in range(0, len(raw), width)]

    def title(self, branch: str) -> str:
        return self._meta(branch, "title").decode(errors="replace").strip()

    def states(self, branch: str) -> list[str]:
        found = sorted(k for k in self.tree.find(branch).children if _is_state(k))
        if not found:
            raise KeyError(f"no states under {branch}")
        return found

    # frames ---------------------------------------------------------------------------------

    @functools.cached_property
    def leaves(self) -> DataFrame:
        """Every dataset: path, branch, state (null outside states), var, and where it lies."""
        rows = []
        for path, leaf in self.tree.leaves():
            state = path[1] if len(path) > 2 and _is_state(path[1]) else None
            rows.append(("/".join(path), path[0], state, path[-1], self.paths[leaf.file], leaf.type, leaf.data, leaf.count, leaf.little))
        return self.spark.createDataFrame(rows, LEAVES)

    def select_columns(self, branch: str, *, id: int | None = None, ids: Sequence[int] | None = None, name: str | None = None, names: Sequence[str] | None = None) -> list[int] | None:  # noqa: A002
        """Column indexes from at most one of the selectors."""
        given = {k: v for k, v in {"id": id, "ids": ids, "name": name, "names": names}.items() if v is not None}
        if len(given) > 1:
            raise ValueError(f"give one of id, ids, name and names, not {', '.join(given)}")
        if not given:
            return None
        (kind, value), = given.items()
        have: list = self.ids(branch) if kind.startswith("id") else self.legend(branch)
        wanted = list(value) if kind in ("ids", "names") else [value]
        missing = [x for x in wanted if x not in have]
        if missing:
            raise KeyError(missing[0])
        return [have.index(x) for x in wanted]

    def long(self, branch: str, variables: Sequence[str] | None = None, columns: Sequence[int] | None = None) -> DataFrame:
        """run_id, branch, state, time, col, entity_id, legend, var, value, ordered by nothing.

        Only the wanted variables' bytes are read, and of them only ``columns`` are kept.
        """
        states = self.states(branch)
        if variables is None:
            variables = sorted({v for s in states for v in self.tree.find(branch, s).children if v != "time"})
        cells = []
        for state in states:
            own = self.tree.find(branch, state).children
            t = own.get("time")
            clock = _place(t, self.paths) if isinstance(t, lsda.Leaf) and t.count else None
            cells += [(state, clock, v, _place(own[v], self.paths)) for v in variables if isinstance(own.get(v), lsda.Leaf) and own[v].type != 11]
        wanted = None if columns is None else list(columns)
        tasks = max(1, min(len(states), 4 * self.spark.sparkContext.defaultParallelism))
        base = self.spark.createDataFrame(cells, f"state string, clock {_PLACE}, var string, leaf {_PLACE}").repartition(tasks, "state")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times: dict[tuple, float] = {}
            for batch in batches:
                for cell in batch.to_pylist():
                    state, clock = cell["state"], cell["clock"]
                    if clock is not None and (key := (clock["file"], clock["data"])) not in times:
                        times = {key: float(_leaf(clock).read(clock["file"])[0])}
                    time = times[key] if clock is not None else 0.0
                    leaf = _leaf(cell["leaf"])
                    col = np.arange(leaf.count) if wanted is None else np.array(wanted)
                    value = leaf.read(cell["leaf"]["file"], wanted).astype(float)
                    n = len(col)
                    yield pa.RecordBatch.from_arrays([pa.array([state] * n), pa.array(np.full(n, time)), pa.array(col.astype(np.int32)), pa.array([cell["var"]] * n), pa.array(value)], names=["state", "time", "col", "var", "value"])

        got = base.mapInArrow(run, "state string, time double, col int, var string, value double")
        own, legend = self.ids(branch), self._legend_or_none(branch)
        meta = self.spark.createDataFrame([(i, x, legend[i] if i < len(legend) else None) for i, x in enumerate(own)], "col int, entity_id long, legend string")
        return got.join(meta, "col", "left").select(F.lit(self.run_id).alias("run_id"), F.lit(branch).alias("branch"), "state", "time", "col", "entity_id", "legend", "var", "value")

    def _legend_or_none(self, branch: str) -> list[str]:
        try:
            return self.legend(branch)
        except KeyError:
            return []

    def series(self, branch: str, var: str, **select: object) -> DataFrame:
        """state, time, col, entity_id, value of a variable, for all columns or selected ones."""
        return self.long(branch, [var], self.select_columns(branch, **select)).select("state", "time", "col", "entity_id", "value")

    def matrix(self, branch: str, var: str, **select: object) -> tuple[np.ndarray, np.ndarray]:
        """(times, states by columns); one column for a single id or name is one-dimensional."""
        columns = self.select_columns(branch, **select)
        rows = self.long(branch, [var], columns).select("state", "time", "col", "value").toPandas()
        wide = rows.pivot(index="state", columns="col", values="value").sort_index()
        wide = wide if columns is None else wide[columns]
        time = rows.groupby("state")["time"].first().sort_index().to_numpy()
        values = wide.to_numpy()
        return time, values[:, 0] if "id" in select or "name" in select else values

    def time_series(self, *path: str) -> DataFrame:
        """time, value of one dataset, with the ``time`` beside it or else 0, 1, 2 and so on."""
        value = self.read_f64(*path)
        try:
            time = self.read_f64(*path[:-1], "time")
        except KeyError:
            time = np.arange(len(value), dtype=float)
        n = min(len(time), len(value))
        return self.spark.createDataFrame(list(zip(range(n), time[:n].tolist(), value[:n].tolist(), strict=True)), "i long, time double, value double")

    def wide(self, branch: str) -> DataFrame:
        """run_id, state, time, id (the column), entity_id and a column for every variable.

        Variables of one value a state are repeated for all ids. Those whose length differs from the
        number of ids are left out.
        """
        states = self.states(branch)
        first = self.tree.find(branch, states[0]).children
        lengths = {v: {leaf.count for s in states if isinstance(leaf := self.tree.find(branch, s).children.get(v), lsda.Leaf)} for v in first if v != "time"}
        n = len(self.ids(branch)) or max((max(x) for x in lengths.values() if x), default=1)
        full = sorted(v for v, x in lengths.items() if x == {n})
        scalar = sorted(v for v, x in lengths.items() if x == {1} and n > 1)
        rows = self.long(branch, full + scalar)
        keys = ["run_id", "state", "time"]
        out = rows.where(F.col("var").isin(full)).groupBy(*keys, "col", "entity_id").pivot("var", full).agg(F.first("value"))
        if scalar:
            out = out.join(rows.where(F.col("var").isin(scalar)).groupBy("state").pivot("var", scalar).agg(F.first("value")), "state")
        return out.select(*keys, F.col("col").alias("id"), "entity_id", *(F.col(f"`{v}`").alias(safe_name(v)) for v in full + scalar))


def safe_name(name: str) -> str:
    """A variable as a column name."""
    return name.replace(" ", "_").replace("+", "_plus_")


def append(binout: Binout, folder: str, branches: Sequence[str] | None = None) -> list[str]:
    """Appends each branch in the wide form to its own Parquet table under ``folder``, by run. Gives the tables' paths."""
    out = []
    for b in branches or [x for x in binout.read() if isinstance(binout.tree.children[x], lsda.Tree)]:
        if any(_is_state(k) for k in binout.tree.find(b).children):
            out.append(f"{folder}/{b}")
            binout.wide(b).write.mode("append").partitionBy("run_id").parquet(out[-1])
    return out


