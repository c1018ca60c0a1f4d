"""``python -m deckframe parse [--json] FILE`` and ``generate FOLDER``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from deckframe import author, includes


def _show(node: dict, level: int = 0) -> None:
    print(f"{'  ' * level}{os.path.basename(node['path'])} ({node['kind'] or 'root'}, {node['byte_count']} bytes)")
    for c in node["children"]:
        _show(c, level + 1)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deckframe")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse", help="show the include tree of a deck")
    p.add_argument("file")
    p.add_argument("--json", action="store_true")
    g = sub.add_parser("generate", help="write a synthetic tree of decks")
    g.add_argument("folder")
    g.add_argument("--depth", type=int, default=2)
    g.add_argument("--breadth", type=int, default=4)
    g.add_argument("--nodes", type=int, default=1000)
    own = parser.parse_args(args)
    if own.command == "generate":
        print(f"{author.generate(own.folder, own.depth, own.breadth, own.nodes)} files in {own.folder}")
        return 0
    begin = time.perf_counter()
    try:
        nodes = includes.walk(own.file)
    except OSError as e:
        print(f"cannot read {own.file}: {e}", file=sys.stderr)
        return 1
    took, size = time.perf_counter() - begin, sum(n.byte_count for n in nodes)
    tree = includes.tree(nodes)
    if own.json:
        print(json.dumps({"tree": tree, "total_files": len(nodes), "total_bytes": size}))
    else:
        _show(tree)
        print(f"{len(nodes)} files, {size} bytes in {took:.3f} s ({size / 1e6 / max(took, 1e-9):.0f} MB/s)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
