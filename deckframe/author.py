"""Writing decks from frames, and synthetic decks for benchmarks."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.sources import cards, files


def write_keyword(path: str | os.PathLike, name: str, columns: Mapping[str, Sequence]) -> None:
    """A deck of one keyword with a free-format line for each row. Columns must be of one length."""
    lengths = {len(c) for c in columns.values()}
    if len(lengths) > 1:
        raise ValueError(f"columns differ in length: {sorted(lengths)}")
    with open(path, "w") as f:
        f.write(f"*KEYWORD\n*{name}\n")
        for row in zip(*columns.values(), strict=True):
            f.write(",".join(cards.edit_text(v.item() if hasattr(v, "item") else v) for v in row) + "\n")
        f.write("*END\n")


def write_lines(lines: DataFrame, folder: str, order: Sequence[str], head: str = "*KEYWORD") -> list[str]:
    """Part files of a deck from a column ``value`` (a line or a whole keyword), each below ``head``. Gives their paths.

    Rows are range-partitioned by the order columns, so part files are in order and are written in
    parallel; nothing passes through the driver.
    """
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")

    def headed(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        first = True
        for b in batches:
            if len(b):
                yield pd.concat([pd.DataFrame({"value": [head]}), b]) if first else b
                first = False

    dealt.mapInPandas(headed, "value string").write.mode("overwrite").text(folder)
    return sorted(f"{folder}/{p}" for p in files.names(folder) if p.startswith("part-") and files.size(f"{folder}/{p}"))


def write_frame(df: DataFrame, folder: str, name: str, order: Sequence[str]) -> None:
    """A deck of one keyword from a frame of any size: a root file that includes a part file for each range of rows."""
    lines = df.select(*order, F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns)).alias("value"))
    parts = write_lines(lines, f"{folder}/parts", order, f"*KEYWORD\n*{name}")
    with open(f"{folder}/root.k", "w") as f:
        f.write("*KEYWORD\n" + "".join(f"*INCLUDE\nparts/{os.path.basename(p)}\n" for p in parts) + "*END\n")


def generate(folder: str | os.PathLike, depth: int, breadth: int, nodes: int) -> int:
    """A tree of decks with ``nodes`` fixed-format nodes a file, includes spelled in several ways. Gives the number of files."""
    os.makedirs(folder, exist_ok=True)
    spellings = ("*INCLUDE\n{}\n", "*INCLUDE_TRANSFORM\n{}\n", "*include\n{}\n", "$# comment\n*INCLUDE\n$# another\n{}\n")
    made = 0

    def one(name: str, level: int) -> None:
        nonlocal made
        made += 1
        first = made * 10_000_000
        with open(os.path.join(folder, name), "w") as f:
            f.write(f"$# {name}\n*KEYWORD\n*NODE\n")
            f.writelines(f"{first + i + 1:>8}{i * 1.5:>16.6f}{i * 2.5:>16.6f}{i * 0.1:>16.6f}{0:>8}{0:>8}        \n" for i in range(nodes))
            below = [f"{name.removesuffix('.k')}_{k}.k" for k in range(breadth if level < depth else 0)]
            f.writelines(spellings[k % 4].format(b) for k, b in enumerate(below))
            f.write("*END\n")
        for b in below:
            one(b, level + 1)

    one("root.k", 0)
    return made


def generate_table(spark: SparkSession, n: int) -> DataFrame:
    """``n`` nodes as a frame."""
    i = F.col("id")
    return spark.range(n).select((i + 1).alias("nid"), (i * 1.5).alias("x"), (i * 2.5).alias("y"), (i * 0.1).alias("z"))
