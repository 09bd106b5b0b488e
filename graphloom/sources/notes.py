"""Markdown notes parsed into nested rows: header, typed fields, blocks, links, chunks.

The header is read by a small parser of the part of YAML that notes use (a map as a field's value becomes
the text `[object Object]`). The body is read by its containers, quotes and list items, and what
stands in them; each text knows its places in the body, so that links are edited where they are.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from functools import lru_cache
from itertools import accumulate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shared import dealt, ship

LINK = re.compile(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
HEAD = re.compile(r"\A---\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|\Z)(.*)\Z", re.S)
_HEAD_END = re.compile(r"---[ \t]*(?:\r?\n|\Z)")
#: Folders that hold no notes; a caller with others names them.
IGNORED = (".git", "node_modules")
#: Headings cut a text into chunks from so many estimated tokens on.
LONG_ENOUGH = 200
_NUMBER = re.compile(r"[-+]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?\Z")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?:Z|[ ]?\+00:?00)?)?\Z")


def read_notes(spark: SparkSession, path: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, mtime, raw) of all .md files below path, ids relative to it, without ignored folders."""
    d = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    root = path.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    inside = F.substring(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))), len("/" + root.lstrip("/")) + 2, 10_000)
    d = d.select(inside.alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("raw"))
    return d.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(*ignored)))


# ---- header ---------------------------------------------------------------------------------


_QUOTED_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)")
_COMMENT = re.compile(r"(?:^|\s)#")
_RADIX = re.compile(r"([-+]?)0(x[0-9a-fA-F_]+|b[01_]+|[0-7_]+)\Z")
_INF = re.compile(r"[-+]?\.(inf|Inf|INF)\Z")
#: What a plain scalar begins with that is no text but for the words below.
_NUMERIC = frozenset("0123456789+-.")
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def scalar(text: str) -> Any:
    """A plain or quoted scalar as the Python value it stands for."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] == '"':
        return t[1:-1] if "\\" not in t else _QUOTED_ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), t[1:-1])
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if "#" in t:
        t = _COMMENT.split(t, maxsplit=1)[0].strip()
    if t in _WORDS:
        return _WORDS[t]
    if t[0] not in _NUMERIC:
        return t
    if m := _RADIX.match(t):
        return float(int(m[2].lstrip("xb").replace("_", ""), {"x": 16, "b": 2}.get(m[2][0], 8)) * (-1 if m[1] == "-" else 1))
    if _NUMBER.match(t):
        return float(t.replace("_", ""))
    if _INF.match(t):
        return -math.inf if t[0] == "-" else math.inf
    if t in (".nan", ".NaN", ".NAN"):
        return math.nan
    if m := _DATE.match(t):
        y, mo, d, h, mi, s, ms = m.groups()
        try:
            return datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int(((ms or "0") + "00")[:3]) * 1000, timezone.utc)
        except ValueError:
            return t
    return t


def _closed(text: str) -> bool:
    """Whether the brackets and quotes of a flow collection are closed."""
    depth, quote, before = 0, "", " "
    for c in text:
        if quote:
            quote = "" if c == quote and before != "\\" else quote
        elif c in "\"'" and before in " ,[{:\t\n":
            quote = c
        else:
            depth += (c in "[{") - (c in "]}")
        before = c
    return depth <= 0 and not quote


def _parts(text: str) -> list[str]:
    """The parts of the inside of a flow collection, split at commas outside quotes and brackets."""
    out, part, quote, depth = [], "", "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not part.strip():
            quote = c
        else:
            depth += (c in "[{") - (c in "]}")
        if c == "," and not quote and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part] if part.strip() else out


#: A list on one line of plain scalars alone.
_FLAT = re.compile(r"\[[^\[\]{}\"'*#]*\]\Z")
_LINK_ALONE = re.compile(r"\[\[[^\[\]]*\]\]\Z")
_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s:#\[{\"'-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:[ \t]+(.*))?\Z", re.S)
_ANCHOR = re.compile(r"&(\S+)(?:\s+(.*))?\Z", re.S)
_ALIAS = re.compile(r"\*([^\s,\]}]+)\s*(?:#.*)?\Z")
_TAG = re.compile(r"!\S*(?:\s+(.*))?\Z", re.S)
_CLOSED = {'"': re.compile(r'"(?:[^"\\]|\\.)*"', re.S), "'": re.compile(r"'(?:[^']|'')*'", re.S)}
_SPACE_HASH = re.compile(r"\s#")
_SCALAR_HEAD = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)[ \t]*(?:#.*)?\Z")


class _Yaml:
    """The part of YAML that headers use: maps and lists by indentation, block and quoted scalars over
    lines, flow collections, anchors and aliases. A line that fits nowhere is left out."""

    def __init__(self, text: str):
        self.lines, self.i, self.anchors = text.split("\n"), 0, {}
        self.at, self.found = -1, None  # the line that peek() found last, and what it holds

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that holds something."""
        if self.i == self.at:
            return self.found
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line[:1].isalpha():
                self.at, self.found = self.i, (0, line.rstrip())
                return self.found
            bare = line.strip()
            if bare and bare[0] != "#":
                self.at, self.found = self.i, (len(line) - len(line.lstrip(" \t")), bare)
                return self.found
            self.i += 1
        return None

    def block(self, indent: int) -> Any:
        first = self.peek()
        if first is None or first[0] < indent:
            return None
        at, bare = first
        if bare == "-" or bare.startswith("- "):
            return self.list(at)
        if _KEY.match(bare):
            return self.map(at)
        self.i += 1
        return self.scalar(bare, at - 1)

    def map(self, indent: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while (line := self.peek()) is not None and line[0] >= indent:
            self.i += 1
            key, colon, rest = line[1].partition(":")
            if colon and line[0] == indent and key.isidentifier() and rest[:1] in " \t":  # as _KEY would find it
                out[key] = self.scalar(rest.strip(), indent)
                continue
            m = _KEY.match(line[1]) if line[0] == indent and not line[1].startswith("- ") else None
            if m:
                self.put(out, m, indent)
        return out

    def put(self, out: dict[str, Any], m: re.Match, indent: int) -> None:
        key = str(scalar(m[1])) if m[1][0] in "\"'" else m[1].strip()
        value = self.scalar((m[2] or "").strip(), indent)
        if key == "<<" and isinstance(value, dict):
            for k, v in value.items():
                out.setdefault(k, v)
        else:
            out[key] = value

    def list(self, indent: int) -> list:
        out = []
        while (line := self.peek()) is not None and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            self.i += 1
            rest = line[1][1:].strip()
            m = None if ":" not in rest else _KEY.match(rest) if rest[:1] not in "\"'[{" or re.match(r"(\"[^\"]*\"|'[^']*')\s*:", rest) else None
            if rest == "-" or rest.startswith("- "):
                self.i -= 1
                inner = indent + line[1].index("-", 1)
                self.lines[self.i], self.at = " " * inner + rest, -1
                out.append(self.list(inner))
            elif m:  # a map that begins behind the dash
                inner, item = indent + line[1].index(rest), {}
                self.put(item, m, inner)
                after = self.peek()
                if after is not None and after[0] == inner and not after[1].startswith("- "):
                    item |= self.map(inner)
                out.append(item)
            else:
                out.append(self.scalar(rest, indent))
        return out

    def scalar(self, rest: str, indent: int) -> Any:
        """A value that begins with rest, and goes on in lines that are further in than indent."""
        c = rest[:1]
        if c == "&" and (m := _ANCHOR.match(rest)):
            self.anchors[m[1]] = self.scalar(m[2] or "", indent)
            return self.anchors[m[1]]
        if c == "*" and (m := _ALIAS.match(rest)):
            return self.anchors.get(m[1])
        if c == "!" and (m := _TAG.match(rest)):
            return self.scalar(m[1] or "", indent)
        if not rest or c == "#":
            line = self.peek()
            if line is None:
                return None
            if line[0] > indent:
                return self.block(indent + 1)
            return self.list(indent) if line[0] == indent and (line[1] == "-" or line[1].startswith("- ")) else None
        if c in "|>" and (m := _SCALAR_HEAD.match(rest)):
            return self.folded(m[1], m[2] or m[4], int(m[3] or 0), indent)
        if c == "[" and _FLAT.match(rest):
            items = rest[1:-1].split(",")
            return [scalar(x) for x in (items if items[-1].strip() else items[:-1])]
        if c in "[{" and not _LINK_ALONE.match(_SPACE_HASH.split(rest)[0].strip()):
            while not _closed(rest) and self.i < len(self.lines):
                rest += " " + self.lines[self.i].strip()
                self.i += 1
            return self.flow(rest)
        if c in "\"'":
            closed = _CLOSED[c]
            while not closed.match(rest) and (line := self.peek()) is not None and line[0] > indent:
                rest += " " + line[1]
                self.i += 1
            m = closed.match(rest)
            return scalar(m[0] if m else rest)
        while not ("#" in rest and _SPACE_HASH.search(rest)) and (line := self.peek()) is not None and line[0] > indent:
            rest += " " + line[1]
            self.i += 1
        return scalar(rest)

    def folded(self, style: str, chomp: str, ahead: int, indent: int) -> str:
        """A block scalar: lines as they are (|), or joined where neither is blank nor further in (>)."""
        lines, width = [], max(indent, 0) + ahead if ahead else None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            here = len(line) - len(line.lstrip(" "))
            if line.strip():
                width = here if width is None else width
                if here < width or here <= indent:
                    break
            lines.append(line[width or 0 :] if line.strip() else "")
            self.i += 1
        tail = len(lines)
        while tail and not lines[tail - 1]:
            tail -= 1
        kept, end = lines[:tail], len(lines) - tail
        if style == "|":
            text = "\n".join(kept)
        else:
            text, blank = "", 0
            for k, line in enumerate(kept):
                if not line:
                    blank += 1
                    continue
                plain_ = line[0] not in " \t" and k > 0 and kept[k - 1 - blank][:1] not in (" ", "\t")
                text += ("" if not k else "\n" * blank if blank and plain_ else " " if plain_ else "\n" * (blank + 1)) + line
                blank = 0
        return text + ("" if chomp == "-" or not kept else "\n" * (end + 1) if chomp == "+" else "\n")

    def flow(self, text: str) -> Any:
        text = text.strip()
        if text[:1] == "[" and not _LINK_ALONE.match(text):
            return [self.flow(x) for x in _parts(text[1 : text.rindex("]")] if "]" in text else text[1:])]
        if text[:1] == "{":
            out = {}
            for part in _parts(text[1 : text.rindex("}")] if "}" in text else text[1:]):
                k, _, v = part.partition(":") if not re.match(r"\s*[\"']", part) else (lambda m: (m[1], ":", m[2]) if m else (part, "", ""))(re.match(r"\s*(\"[^\"]*\"|'[^']*')\s*:(.*)\Z", part, re.S))
                out[str(scalar(k)) if k.strip()[:1] in ("'", '"') else k.strip()] = self.flow(v)
            return out
        if m := re.match(r"\*(\S+)\Z", text):
            return self.anchors.get(m[1])
        return scalar(text)


def header(yaml: str) -> dict[str, Any]:
    """The keys of a header in order, as Python values (numbers are floats)."""
    y = _Yaml(yaml)
    first = y.peek()
    got = y.block(first[0]) if first else None
    return got if isinstance(got, dict) else {}


def value_type(v: Any) -> str:
    if isinstance(v, str):
        return "reference" if "[[" in v and LINK.search(v) else "string"
    if isinstance(v, list):
        return "list"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, (date, datetime)):
        return "date"
    return "string"


def number_text(v: float) -> str:
    return str(int(v)) if math.isfinite(v) and v == int(v) and abs(v) < 1e21 else repr(float(v))


def iso(v: date | datetime) -> str:
    at = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
    return f"{at.replace(tzinfo=None).isoformat(timespec='milliseconds')}Z"


def plain(v: Any) -> Any:
    """A value as JSON would hold it."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else iso(v) if isinstance(v, (date, datetime)) else int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else None if isinstance(v, float) and not math.isfinite(v) else v


_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))
_quoted = json.encoder.encode_basestring


def value_text(v: Any) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return f"[{','.join(map(_quoted, v))}]" if all(type(x) is str for x in v) else _JSON.encode(plain(v))
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return number_text(float(v))
    if isinstance(v, (date, datetime)):
        return iso(v)
    return "null" if v is None else "[object Object]" if isinstance(v, dict) else str(v)


# ---- body -----------------------------------------------------------------------------------


@dataclass
class Block:
    kind: str  # heading, paragraph, item, code
    text: str
    start: int
    #: where each line of text begins in the body, and the outermost quote or list item it stands in
    places: list[int] = field(default_factory=list)
    part: int | None = None
    level: int = 0

    def at(self, i: int) -> int:
        """The place in the body of a character of text."""
        line = self.text.count("\n", 0, i)
        return (self.places[line] if self.places else self.start) + i - (self.text.rfind("\n", 0, i) + 1)


@dataclass
class Note:
    title: str
    types: list[str]
    fields: list[tuple[str, Any]]
    body: str
    blocks: list[Block] = field(default_factory=list)


_FENCE = re.compile(r"(`{3,})(?=[^`]*\Z)|(~{3,})")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|\Z)(.*?)(?:(?:^|[ \t]+)#+)?[ \t]*\Z")
_SETEXT = re.compile(r"(=+|-+)[ \t]*\Z")
_BREAK = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*\Z")
_MARKER = re.compile(r"([-*+]|([0-9]{1,9})[.)])(?=[ \t]|\Z)")
_HTML = re.compile(r"<(?:[A-Za-z][^\s>]*|/[A-Za-z]|!|\?)")


class _Line:
    """A line of a body, read from the left. Tabs reach to the next multiple of four."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.pos, self.col = text, at, 0, 0

    def indent(self) -> int:
        col = self.col
        for c in self.text[self.pos :]:
            if c == " ":
                col += 1
            elif c == "\t":
                col += 4 - col % 4
            else:
                break
        return col - self.col

    def blank(self) -> bool:
        return not self.text[self.pos :].strip()

    def skip(self, columns: int) -> None:
        end = self.col + columns
        while self.col < end and self.pos < len(self.text) and self.text[self.pos] in " \t":
            self.col += 1 if self.text[self.pos] == " " else 4 - self.col % 4
            self.pos += 1

    def rest(self) -> str:
        return self.text[self.pos :].lstrip(" \t")

    def take(self, n: int) -> None:
        self.pos, self.col = self.pos + n, self.col + n

    def piece(self) -> tuple[str, int]:
        """What is left without white space around it, and where that begins in the body."""
        bare = self.text[self.pos :].strip()
        return bare, self.at + (self.text.index(bare, self.pos) if bare else self.pos)


def blocks(body: str) -> list[Block]:
    """Headings, paragraphs, list items and code of a body in order, with their offsets.

    A line first continues the quotes and list items it stands in, in their order; then it may open
    others, end or go on with a paragraph, or be code. A paragraph's line may leave out the marks of
    the quotes and items around it.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (quote, 0) or (item, columns its lines are further in)
    leaf: Block | None = None  # a paragraph, or code by indentation, that goes on
    fence: tuple[str, int] | None = None
    in_html, part, parts, at = False, None, 0, 0
    for text in body.split("\n"):
        start = at
        at += len(text) + 1
        if not stack:  # most lines stand in no quote or list, and their first character tells what they are
            c = text[:1]
            if fence:
                if fence[0] not in text:
                    continue
            elif not c:
                in_html = False
                if leaf is not None and leaf.kind != "code":
                    leaf = None
                continue
            elif c.isalpha():
                if not in_html:
                    if leaf is None or leaf.kind == "code":
                        leaf = Block("paragraph", "", 0, part=part)
                        out.append(leaf)
                    _add(leaf, text.rstrip(), start)
                continue
        line = _Line(text, start)
        k = 0
        for kind, width in stack:
            if kind == "quote":
                if line.indent() > 3 or not line.rest().startswith(">"):
                    break
                line.skip(3)
                line.take(1)
                line.skip(1)
            elif not line.blank():
                if line.indent() < width:
                    break
                line.skip(width)
            k += 1
        inside = k == len(stack)
        if fence and inside:
            rest = line.rest()
            m = rest[:1] == fence[0] and re.match(rf"{re.escape(fence[0])}{{{fence[1]},}}[ \t]*\Z", rest)
            fence = None if m and line.indent() < 4 else fence
            continue
        if in_html and inside and not line.blank():
            continue
        fence, in_html = None, False
        if not inside:
            lazy = leaf is not None and leaf.kind in ("paragraph", "item") and not line.blank() and (line.indent() > 3 or not _starts(line.rest()))
            if lazy:
                _more(leaf, line)
                continue
            stack, leaf = stack[:k], None
            part = part if stack else None
        while True:
            if line.blank():
                if leaf is not None and leaf.kind != "code":
                    leaf = None
                break
            if line.indent() > 3:
                if leaf is None:
                    leaf = Block("code", "", line.piece()[1], part=part)
                    out.append(leaf)
                elif leaf.kind != "code":
                    _more(leaf, line)
                break
            if leaf is not None and leaf.kind == "code":
                leaf = None
            rest = line.rest()
            if rest[0] == ">":
                line.skip(3)
                line.take(1)
                line.skip(1)
                leaf = None
                if not stack:
                    parts += 1
                    part = parts
                stack.append(("quote", 0))
                continue
            if m := _FENCE.match(rest):
                mark = m[1] or m[2]
                fence, leaf = (mark[0], len(mark)), None
                out.append(Block("code", "", line.piece()[1], part=part))
                break
            if m := _ATX.match(rest):
                start = line.piece()[1] + m.start(2)
                out.append(Block("heading", m[2].strip(), start, [start], part, len(m[1])))
                leaf = None
                break
            if leaf is not None and (m := _SETEXT.match(rest)):
                leaf.kind, leaf.level, leaf = "heading", 1 if m[1][0] == "=" else 2, None
                break
            if _BREAK.match(rest):
                leaf = None
                break
            m = _MARKER.match(rest)
            if m and (leaf is None or (rest[m.end() :].strip() and m[2] in (None, "1"))):
                before = line.indent()
                line.skip(before)
                line.take(m.end())
                after = line.indent()
                gap = 1 if line.blank() or after > 4 else after
                line.skip(gap)
                leaf = None
                if not stack:
                    parts += 1
                    part = parts
                stack.append(("item", before + m.end() + gap))
                continue
            if leaf is None and _HTML.match(rest) and not re.match(r"<[A-Za-z][A-Za-z0-9+.-]*:|<[^\s@>]+@", rest):
                in_html = True
                out.append(Block("code", "", line.piece()[1], part=part))
                break
            if leaf is None:
                leaf = Block("item" if stack and stack[-1][0] == "item" else "paragraph", "", 0, part=part)
                out.append(leaf)
            _more(leaf, line)
            break
    return out


def _starts(rest: str) -> bool:
    """Whether a block other than a paragraph begins here, outside the paragraph's container."""
    return rest[:1] == ">" or any(x.match(rest) for x in (_FENCE, _ATX, _BREAK, _MARKER))


def _more(leaf: Block, line: _Line) -> None:
    _add(leaf, *line.piece())


def _add(leaf: Block, text: str, place: int) -> None:
    leaf.start = leaf.start if leaf.places else place
    leaf.text = f"{leaf.text}\n{text}" if leaf.places else text
    leaf.places.append(place)


_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_CODE = re.compile(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
_PICTURE = re.compile(r"!\[[^\]\[]*\]\([^)]*\)")
_LABELLED = re.compile(r"\[([^\]\[]*)\]\([^)]*\)")
_ADDRESS = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*|[^\s@<>]+@[^\s@<>]+)>")
_ELEMENT = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_EMPHASIS = re.compile(r"(\*\*|__|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w))")
_KEPT = re.compile(r"\x00(\d+)\x00")
#: A text without any of these characters is its own inline text.
_MARKS = re.compile(r"[`\x00\\\[\]<*_&]")


@lru_cache(maxsize=64)
def inline(text: str) -> str:
    """Text of a block: links as alias or target or text; code, pictures, tags and marks left out.
    The last ones are kept, as a block is asked for its content, its chunk and each of its links."""
    if not _MARKS.search(text):
        return text
    t = _CODE.sub("", text) if "`" in text else text
    kept: list[str] = []

    def keep(m: re.Match) -> str:  # an escaped character, and a wiki link, are no marks
        kept.append(m[1] if m.re is _ESCAPE else (m[2] or m[1]).strip())
        return f"\x00{len(kept) - 1}\x00"

    t = t.replace("\x00", "")
    t = _ESCAPE.sub(keep, t) if "\\" in t else t
    if "[" in t:
        t = _LABELLED.sub(r"\1", _PICTURE.sub("", LINK.sub(keep, t)))
    if "<" in t:
        t = _ELEMENT.sub("", _ADDRESS.sub(r"\1", t))
    if "*" in t or "_" in t:
        t = _EMPHASIS.sub("", t)
    t = html.unescape(t) if "&" in t else t
    while "\x00" in t:
        t = _KEPT.sub(lambda m: kept[int(m[1])], t)
    return t


def links(text: str) -> list[tuple[str, str | None, int, int]]:
    """(target, alias, start, end) of the links of a block outside code."""
    if "[[" not in text:
        return []
    code = [m.span() for m in _CODE.finditer(text)] if "`" in text else []
    return [(m[1].strip(), m[2].strip() if m[2] else None, *m.span()) for m in LINK.finditer(text) if not any(a <= m.start() < b for a, b in code)]


def split(raw: str) -> tuple[str | None, str]:
    """The header, None without one, and the body; as HEAD tells them, by a search for where the header ends."""
    start = 4 if raw.startswith("---\n") else 5 if raw.startswith("---\r\n") else 0
    m = _HEAD_END.search(raw, start) if start else None
    if m is None:
        return None, raw
    end = m.start()
    end -= end > start and raw[end - 1] == "\n"
    end -= end > start and raw[end - 1] == "\r"
    return raw[start:end], raw[m.end() :]


def parse(path: str, raw: str, parts: tuple[str, ...] = ("head", "body")) -> Note:
    yaml, body = split(raw)
    head = header(yaml) if yaml is not None and "head" in parts else {}
    types = head.get("types")
    types = [str(t) for t in types] if isinstance(types, list) else [str(types)] if types is not None else []
    title = head.get("title")
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    fields = [(k, v) for k, v in head.items() if k not in ("title", "types")]
    return Note(title if isinstance(title, str) and title else stem, types, fields, body, blocks(body) if "body" in parts else [])


def content(note: Note) -> str:
    return _text(note.blocks)


def _text(some: list[Block]) -> str:
    """Blocks as lines; what stands in one outermost quote or list item runs together."""
    out, last = [], None
    for b in some:
        t = inline(b.text) if b.kind != "code" else ""
        if t and b.part is not None and b.part == last:
            out[-1] += t
        elif t:
            out.append(t)
            last = b.part
    return "\n".join(out).strip()


def places(note: Note, offset: int = 0) -> list[tuple[str, str | None, int, int]]:
    """(target, alias, start, end) of the links of a note's body, with their places in it, behind offset."""
    return [(t, alias, offset + b.at(i), offset + b.at(j - 1) + 1) for b in note.blocks if b.kind != "code" for t, alias, i, j in links(b.text)]


def renamed(raw: str, old: str, new: str) -> str:
    """A note in which links to old (in any case) are links to new: in header values and the text, not
    in code, and nothing else is changed."""
    m = HEAD.match(raw)
    split = m.start(2) if m else 0
    note = parse("", raw)
    edits = [(i, j, alias) for t, alias, i, j in places(note, split) if t.lower() == old.lower()]
    head = re.sub(rf"(?i)\[\[[ \t]*{re.escape(old)}[ \t]*(\|[^\]]+)?\]\]", lambda x: f"[[{new}{x[1] or ''}]]", raw[:split])
    out, done = [head], split
    for i, j, _ in sorted(edits):
        inner = raw[i:j]
        out += [raw[done:i], f"[[{new}{inner[inner.index('|'):-2] if '|' in inner else ''}]]"]
        done = j
    return "".join([*out, raw[done:]])


def rename_links(notes: DataFrame, old: str, new: str) -> DataFrame:
    """notes (path, mtime, raw) with their links renamed, in Arrow batches."""
    ship(notes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=[r if r is None or old.lower() not in r.lower() else renamed(r, old, new) for r in pdf["raw"]])

    return notes.mapInPandas(run, notes.schema)


def tokens(text: str) -> int:
    return math.ceil(len(text.split()) * 1.3)


def edges(note: Note) -> list[tuple[str, str, str | None]]:
    """(target, rel_type, context): links of field values by key, then those of the body."""
    out: list[tuple[str, str, str | None]] = []
    for k, v in note.fields:
        for x in v if isinstance(v, list) else [v]:
            if isinstance(x, str) and "[[" in x:
                out += [(m[1].strip(), k, None) for m in LINK.finditer(x)]
    for b in note.blocks:
        if b.kind != "code":
            out += [(t, "wiki-link", inline(b.text)) for t, *_ in links(b.text)]
    return out


def chunks(note: Note, text: str | None = None) -> list[tuple[int, str | None, str, int]]:
    """(index, heading, text, tokens): one for a short note or one without headings, else the text
    before the first heading and one for each heading. text is its content(), where that is known."""
    text = content(note) if text is None else text
    size = tokens(text)
    if size < LONG_ENOUGH or not any(b.kind == "heading" for b in note.blocks):
        return [(0, None, text, size)]
    parts: list[tuple[str | None, list[Block]]] = [(None, [])]
    for b in note.blocks:
        if b.kind == "heading":
            parts.append((inline(b.text).strip(), []))
        else:
            parts[-1][1].append(b)
    texts = [(h, _text(bs)) for h, bs in parts]
    kept = [x for i, x in enumerate(texts) if i or x[1]]
    return [(i, h, t, tokens(t)) for i, (h, t) in enumerate(kept)]


SCHEMA = (
    "id string, mtime timestamp, hash string, title string, types array<string>, "
    "fields array<struct<key:string,value_text:string,value_type:string,value_number:double,value_date:string>>, "
    "edges array<struct<target_id:string,rel_type:string,context:string>>, "
    "chunks array<struct<chunk_index:int,heading:string,content:string,token_count:int>>, content_text string, content_md string"
)


def _nested(counts: list[int], columns: dict[str, tuple[list, pa.DataType]]) -> pa.Array:
    """A column of lists of structs, from how many structs each row has and their members in order."""
    offsets = pa.array([0, *accumulate(counts)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns)))


#: What a note's header alone and its body alone tell; links stand in both.
PARTS = {"head": ("mtime", "hash", "title", "types", "fields"), "body": ("chunks", "content_text", "content_md")}


def _rows(batch: pa.RecordBatch, which: tuple[str, ...] = ("head", "body")) -> pa.RecordBatch:
    """SCHEMA for a batch of (path, mtime, hash, raw), by columns: rows of dicts cost more than the parser."""
    text, number, whole = pa.string(), pa.float64(), pa.int32()
    titles, types, bodies, texts = [], [], [], []
    fields: list[tuple] = []
    found: list[tuple] = []
    parts: list[tuple] = []
    n_fields, n_found, n_parts = [], [], []
    for path, raw in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist()):
        n = parse(path, raw or "", which)
        for k, v in n.fields:
            kind, shown = value_type(v), value_text(v)
            fields.append((k, shown, kind, float(v) if kind == "number" else None, shown if kind == "date" else None))
        whole_text = content(n)
        links_, pieces = edges(n), chunks(n, whole_text)
        found += links_
        parts += pieces
        n_fields.append(len(n.fields))
        n_found.append(len(links_))
        n_parts.append(len(pieces))
        titles.append(n.title)
        types.append(list(dict.fromkeys(n.types)))
        texts.append(whole_text)
        bodies.append(n.body)
    key, shown, kind, numbers, dates = zip(*fields) if fields else ((),) * 5
    target, rel, context = zip(*found) if found else ((),) * 3
    index, heading, piece, size = zip(*parts) if parts else ((),) * 4
    columns = {
        "id": batch.column("path"), "mtime": batch.column("mtime"), "hash": batch.column("hash"),
        "title": pa.array(titles, text), "types": pa.array(types, pa.list_(text)),
        "fields": _nested(n_fields, {"key": (key, text), "value_text": (shown, text), "value_type": (kind, text), "value_number": (numbers, number), "value_date": (dates, text)}),
        "edges": _nested(n_found, {"target_id": (target, text), "rel_type": (rel, text), "context": (context, text)}),
        "chunks": _nested(n_parts, {"chunk_index": (index, whole), "heading": (heading, text), "content": (piece, text), "token_count": (size, whole)}),
        "content_text": pa.array(texts, text), "content_md": pa.array(bodies, text),
    }
    wanted = _columns(which)
    kept = [c for c in columns if c in wanted]
    return pa.RecordBatch.from_arrays([columns[c] for c in kept], names=kept)


def _columns(parts: tuple[str, ...]) -> set[str]:
    return {"id", "edges", *(c for p in parts for c in PARTS[p])}


def parsed(notes: DataFrame, parts: tuple[str, ...] = ("head", "body")) -> DataFrame:
    """One nested row for each note (path, mtime, raw; hash, where it is known), or what a part of it tells."""
    ship(notes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch, parts)

    known = F.col("hash") if "hash" in notes.columns else F.sha2("raw", 256)
    rows = dealt(notes.select("path", F.col("mtime").cast("timestamp").alias("mtime"), known.alias("hash"), "raw"), "path")
    schema = StructType([f for f in StructType.fromDDL(SCHEMA) if f.name in _columns(parts)])
    return rows.mapInArrow(run, schema)
