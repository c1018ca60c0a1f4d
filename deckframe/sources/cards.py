"""Bytes of keyword files: blocks, lines and fields. Plain functions, used in readers and editors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

FIXED, LONG, FREE = "fixed", "long", "free"
_KEYWORD = re.compile(rb"^\*[^\n]*", re.M)
_LONG = re.compile(rb"\*KEYWORD.*?LONG[ \t]*=[ \t]*[YS]", re.I | re.S)
_NAME = re.compile(rb"\*([^ \t\r\n]*)")

#: Fixed value: the suffixes of *INCLUDE, and the kind of directive each makes.
INCLUDES = {
    "": "include", "_PATH": "include_path", "_PATH_RELATIVE": "include_path_relative", "_TRANSFORM": "include_transform",
    "_AUTO_ZZFREE": "include_auto_zzfree", "_BINARY": "include_binary", "_COMPENSATED": "include_compensated", "_STAMPED_PART": "include_stamped_part",
}


@dataclass(frozen=True)
class Block:
    """One keyword with its cards. Blocks tile the file: trivia above a keyword line belongs to it."""

    start: int
    end: int
    name_start: int
    body_start: int
    line: int
    name: str
    options: tuple[str, ...]
    fmt: str


def text(raw: bytes) -> str:
    """A field's text; bytes that are not UTF-8 give an empty one."""
    try:
        return raw.decode().strip(" \t\r\n")
    except UnicodeDecodeError:
        return ""


def skippable(line: bytes) -> bool:
    """A blank line or a comment, also an indented one."""
    t = line.strip(b" \t\r\n")
    return not t or t[:1] == b"$"


def split_blocks(data: bytes) -> list[Block]:
    """The blocks of a file; none if it has no keyword."""
    heads = list(_KEYWORD.finditer(data))
    long_ = any(_LONG.match(m.group()) for m in heads if m.group()[1:8].upper() == b"KEYWORD")
    starts = [0] + [_trivia(data, m.start()) for m in heads[1:]]
    out, at, line = [], 0, 1
    for k, m in enumerate(heads):
        end = starts[k + 1] if k + 1 < len(heads) else len(data)
        line += data.count(b"\n", at, m.start())
        at = m.start()
        newline = data.find(b"\n", m.start())
        body = min(end, len(data) if newline < 0 else newline + 1)
        name = _NAME.match(m.group())
        rest = m.group()[name.end() :].decode(errors="replace")
        out.append(Block(starts[k], end, m.start(), body, line, text(name[1]), tuple(rest.split()), LONG if long_ else FIXED))
    return out


def _trivia(data: bytes, head: int) -> int:
    """Where the run of blank and comment lines above a keyword line begins."""
    while head > 0:
        above = data.rfind(b"\n", 0, head - 1) + 1
        if not skippable(data[above : head - 1]):
            break
        head = above
    return head


def lines(body: bytes) -> list[bytes]:
    """Data lines, without blank lines, comments and line ends."""
    return [x.rstrip(b"\r\n") for x in body.split(b"\n") if not skippable(x)]


def is_free(line: bytes, fmt: str = FIXED) -> bool:
    return fmt == FREE or b"," in line


def slices(line: bytes, widths: Sequence[int], fmt: str = FIXED) -> list[bytes]:
    """The raw fields of a line: comma tokens, or columns (twice as wide in the long format); missing ones are empty."""
    if is_free(line, fmt):
        found = line.split(b",")[: len(widths)]
        return found + [b""] * (len(widths) - len(found))
    out, at, scale = [], 0, 2 if fmt == LONG else 1
    for w in widths:
        out.append(line[at : at + w * scale])
        at += w * scale
    return out


def positional(line: bytes, fmt: str = FIXED) -> list[str]:
    """Fields of a line of unknown layout: comma tokens, or columns of 8 (long format 20)."""
    if is_free(line, fmt):
        return [text(x) for x in line.split(b",")]
    w = 20 if fmt == LONG else 8
    return [text(line[i : i + w]) for i in range(0, len(line), w)]


def cards(body: bytes, fmt: str = FIXED) -> Iterator[list[str]]:
    """Rows of fields without a layout. Only a ``$`` in the first column makes a comment here."""
    for x in body.split(b"\n"):
        x = x.rstrip(b"\r")
        if x.strip(b" \t") and x[:1] != b"$":
            yield positional(x, fmt)


def include_kind(head: bytes) -> str | None:
    """The directive of an *INCLUDE line, with nothing else on it; None for other lines."""
    head = head.rstrip(b" \t\r\n")
    if head[:8].upper() != b"*INCLUDE":
        return None
    rest = head[8:]
    if rest[:1] in (b" ", b"\t"):
        return "include"
    return INCLUDES.get(rest.decode(errors="replace").upper())


def file_name(body: bytes) -> str | None:
    """The file name of an include: comments above it are skipped, ``+`` at a line's end continues it."""
    name, begun = [], False
    for x in body.split(b"\n"):
        x = x.rstrip(b"\r")
        if not begun and x[:1] == b"$":
            continue
        begun = True
        part = x.strip(b" \t\r\n")
        more = part.endswith(b"+")
        name.append((part[:-1].rstrip(b" \t") if more else part).decode(errors="replace"))
        if not more:
            break
    return "".join(name).strip() or None


def keyword_of(data: bytes, block: Block) -> dict:
    """The block as name, options and rows of fields."""
    return {"name": block.name, "options": list(block.options), "cards": list(cards(data[block.body_start : block.end], block.fmt))}


# editing ------------------------------------------------------------------------------------

IN_PLACE, REFLOWED = "in_place", "reflowed"


def set_keyword(data: bytes, block: Block, keyword: dict) -> bytes:
    """New bytes for a block: its trivia, then the keyword line and free-format cards."""
    head = " ".join([f"*{keyword['name']}", *keyword.get("options", [])])
    return data[block.start : block.name_start] + "".join(f"{x}\n" for x in [head, *(",".join(c) for c in keyword["cards"])]).encode()


def _data_line(block: bytes, row: int) -> tuple[int, int] | None:
    """Where the ``row``-th data line lies in a block's bytes, without its line end."""
    at, seen, count = 0, False, 0
    for x in block.split(b"\n"):
        end = at + len(x.removesuffix(b"\r"))
        if not seen:
            seen = x[:1] == b"*"
        elif not skippable(x):
            if count == row:
                return at, end
            count += 1
        at += len(x) + 1
    return None


def set_field(block: bytes, row: int, col: int, widths: Sequence[int], value: str, fmt: str = FIXED) -> tuple[bytes, str] | None:
    """(the block's bytes with one field replaced, how): right-justified in its column, or as a comma token.

    A value too wide for its column turns that line into free format. ``widths`` are those in the
    file, so doubled for the long format. None if there is no such line or column.
    """
    at = _data_line(block, row)
    if at is None:
        return None
    line, new = block[at[0] : at[1]], value.encode()
    how = IN_PLACE
    if is_free(line, fmt):
        tokens = line.split(b",")
        tokens += [b""] * (col + 1 - len(tokens))
        tokens[col] = new
        line = b",".join(tokens)
    elif col >= len(widths):
        return None
    else:
        off, w = sum(widths[:col]), widths[col]
        if len(new) <= w:
            line = line[:off].ljust(off) + new.rjust(w) + line[off + w :]
        else:
            fields = [text(x).encode() for x in slices(line, widths)]
            fields[col] = new
            while len(fields) > col + 1 and not fields[-1]:
                fields.pop()
            line, how = b",".join(fields), REFLOWED
    return block[: at[0]] + line + block[at[1] :], how


def apply_edits(data: bytes, blocks: Sequence[Block], edits: dict[int, bytes]) -> bytes:
    """The file's bytes with some blocks replaced; without edits exactly the input."""
    if not blocks:
        return data
    return b"".join(edits.get(k, data[b.start : b.end]) for k, b in enumerate(blocks))


def edit_text(value: object) -> str:
    """A value as it is written into a field: the shorter of plain and scientific for a float."""
    if not isinstance(value, float):
        return str(value)
    if value != value or value in (float("inf"), float("-inf")):
        return str(value)
    plain = repr(value)
    if "e" in plain:
        plain = f"{value:.20f}".rstrip("0")
    science = f"{value:e}"
    mantissa, exponent = science.split("e")
    for digits in range(0, 18):
        science = f"{value:.{digits}e}"
        if float(science) == value:
            mantissa, exponent = science.split("e")
            break
    science = f"{mantissa}e{int(exponent)}"
    return plain if len(plain) <= len(science) else science
