"""Expressions over the raw text of notes: header, links, embeds, attachments, patches, serialising."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quote_key, quote_yaml
from ..plans.shared import ship
from .notes import IGNORED, read_notes

LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
HEADER = r"(?s)\A---\n(.*?)\n---\n?"
#: Attachment classes by extension, and media types (fixed values).
CLASSES = {"image": "png jpg jpeg gif webp svg", "audio": "m4a mp3 wav ogg webm", "document": "pdf docx txt md"}
MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "m4a": "audio/mp4", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "webm": "audio/webm",
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown",
}


def header(raw: Column) -> Column:
    return F.regexp_extract(raw, HEADER, 1)


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, HEADER, "")


def flat_fields(notes: DataFrame, raw: str = "raw", id: str = "path") -> DataFrame:
    """(id, key, value) of the flat `key: value` lines of the front matter, without meta keys; quotes
    around a value go. For lists and types see notes.parsed()."""
    line = F.explode(F.split(header(F.col(raw)), "\n"))
    d = notes.select(id, line.alias("line")).filter(F.col("line").rlike(r"^[A-Za-z_][\w -]*:"))
    d = d.select(id, F.regexp_extract("line", r"^([^:]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)), "^\"(.*)\"$|^'(.*)'$", "$1$2").alias("value"))
    return d.filter(~F.col("key").isin("title", "types"))


def links(notes: DataFrame, text: str = "raw", id: str = "path") -> DataFrame:
    """(id, ordinal, target, alias, start, end) of the [[target|alias]] links of a text, in order,
    with their offsets (end exclusive)."""
    whole = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    # the text between links, from which the offsets follow
    gaps = F.split(text, r"\[\[[^\]|]+(?:\|[^\]]+)?\]\]", -1)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("a"), whole.alias("w"))
    sizes = F.zip_with(gaps, whole, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0)))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    d = notes.select(id, ends.alias("__ends"), F.posexplode(both).alias("ordinal", "l"))
    end = F.get("__ends", F.col("ordinal"))
    return d.select(id, "ordinal", F.trim("l.t").alias("target"), F.nullif(F.trim("l.a"), F.lit("")).alias("alias"), (end - F.length("l.w")).alias("start"), end.alias("end"))


def embeds(text: Column) -> Column:
    r"""Distinct files of ![[file|size]] in order, without notes."""
    found = F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, F.trim)), lambda x: ~F.lower(x).endswith(".md"))


def attachment_class(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    out = F.lit("unknown")
    for kind, exts in CLASSES.items():
        out = F.when(ext.isin(*exts.split()), kind).otherwise(out)
    return out


def plain_text(raw: Column) -> Column:
    """Body with links shown as alias or target, code and heading marks left out."""
    t = F.regexp_replace(body(raw), r"(?s)```.*?```|`[^`]*`", "")
    t = F.regexp_replace(t, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    t = F.regexp_replace(t, r"\[\[([^\]]+)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?m)^#+ ", ""), r"\n{2,}", "\n"))


def media_type(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.coalesce(pairs[F.lower(F.substring_index(name, ".", -1))], F.lit("application/octet-stream"))


def resolve_embeds(wanted: DataFrame, files: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """wanted (source, file) with the path that is meant, of files (path): in Attachments, at the
    root, beside the source, else the first of that name outside ignored folders."""
    base = files.filter(~F.exists(F.split("path", "/"), lambda x: x.isin(*ignored))).select("path")
    w = wanted.select("source", "file").distinct()
    folder = F.regexp_extract("source", "^(.*/)[^/]*$", 1)
    places = w.select("source", "file", F.posexplode(F.array(F.concat(F.lit("Attachments/"), "file"), F.col("file"), F.concat(folder, F.col("file")))).alias("rank", "path"))
    direct = places.join(files.select("path"), "path").select("source", "file", "rank", "path")
    named = base.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.min("path").alias("path"))
    other = w.withColumn("name", F.substring_index("file", "/", -1)).join(named, "name").select("source", "file", F.lit(3).alias("rank"), "path")
    best = direct.unionByName(other).groupBy("source", "file").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return w.join(best, ["source", "file"], "left")


def read_attachments(files: DataFrame) -> DataFrame:
    """(path, kind, media_type, data) of binaryFile rows (path, content): images in base64; svg, text
    documents and the text of DOCX as text; others have no data, as their formats need a reader of their own."""
    kind = attachment_class(F.col("path"))
    text = F.lower(F.substring_index("path", ".", -1)).isin("svg", "txt", "md")
    data = F.when(text, F.decode("content", "UTF-8")).when(kind == "image", F.base64("content"))
    word = F.lower("path").endswith(".docx")
    rows = files.select("path", kind.alias("kind"), media_type(F.col("path")).alias("media_type"), data.alias("data"), "content")
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[docx_text(c) for c in pdf["content"]])[["path", "kind", "media_type", "data"]]

    docx = rows.filter(word).mapInPandas(run, "path string, kind string, media_type string, data string")
    return rows.filter(~word).drop("content").unionByName(docx)


_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes | None) -> str | None:
    """The text of a DOCX file: paragraphs, those of tables too, each with a blank line after it; None if it
    can't be read. Deleted text of tracked changes is left out."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, zlib.error):
        return None
    out: list[str] = []
    for p in root.iter(f"{_WORDS}p"):
        for x in p.iter():
            if x.tag in (f"{_WORDS}t", f"{_WORDS}tab"):
                out.append((x.text or "") if x.tag.endswith("}t") else "\t")
        out.append("\n\n")
    return "".join(out)


def embed_report(notes: DataFrame, kind: str = "all", raw: str = "raw", id: str = "path") -> DataFrame:
    """(id, kind, n, files): the embeds of each note by class, of one class only or all."""
    e = notes.select(id, F.posexplode(embeds(F.col(raw))).alias("place", "file")).withColumn("kind", attachment_class(F.col("file")))
    e = e if kind == "all" else e.filter(F.col("kind") == kind)
    return e.groupBy(id, "kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]), ",").alias("files"))


def summary(notes: DataFrame, raw: str = "raw", id: str = "path") -> DataFrame:
    """(id, header, text, n_embeds) of each note, for a summary."""
    return notes.select(id, header(F.col(raw)).alias("header"), plain_text(F.col(raw)).alias("text"), F.size(embeds(F.col(raw))).alias("n_embeds"))


def serialize(title: Column, types: Column, fields: Column, text: Column, order: list[str] | None = None) -> Column:
    """A note from a title, labels, an array of (key, value, plain) and a body: keys in the declared
    order, then the others by name; null values are left out. plain marks values that are written
    as they are (numbers, booleans, dates, lists)."""
    first = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    place = lambda f: F.struct(F.when(F.array_contains(first, f["key"]), F.array_position(first, f["key"])).otherwise(F.lit(1_000_000)).alias("p"), f["key"].alias("key"), f["value"].alias("value"), f["plain"].alias("plain"))
    kept = F.array_sort(F.transform(F.filter(fields, lambda f: f["value"].isNotNull()), place))
    lines = F.transform(kept, lambda f: F.concat(quote_key(f["key"]), F.lit(": "), F.when(f["plain"], f["value"]).otherwise(quote_yaml(f["value"]))))
    labels = F.when(F.size(types) > 0, F.concat(F.lit("types: ["), F.array_join(F.transform(types, quote_yaml), ", "), F.lit("]\n"))).otherwise("")
    body_lines = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\ntitle: "), quote_yaml(title), F.lit("\n"), labels, body_lines, F.lit("---\n"), text)


@dataclass(frozen=True)
class Patch:
    """rename (key, to), set (key, value) or wrap (key): a scalar becomes a list of one."""

    action: str
    key: str
    value: Any = None


def _scalar(v: Any) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_scalar, v)) + "]"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return json.dumps(v)
    t = str(v)
    plain = re.match(r"[a-zA-Z][a-zA-Z0-9 _.\-]*\Z", t) and t == t.strip() and t.lower() not in ("true", "false", "yes", "no", "on", "off", "null")
    return t if plain else '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _literal(text: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", text)


def _to(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def patch(raw: Column, patches: list[Patch]) -> Column:
    """The header with renames first, then values; the body stays byte for byte. A rename to a key
    that exists, and a value of a key that doesn't, change nothing. Header lines of a key include the
    indented lines and dashes below it."""
    block = r"(?s)\A---\n(.*?\n)---(?:\n|\z)"
    head = F.regexp_extract(raw, block, 1)
    rest = raw.substr(F.length(head) + 5, F.length(raw))
    out = head
    for p in [x for x in patches if x.action == "rename"]:
        new = F.regexp_replace(out, F.lit(rf"(?m)\A((?:.*\n)*?){_literal(p.key)}:"), F.lit("$1" + _to(_scalar_key(str(p.value))) + ":"))
        out = F.when(out.rlike(rf"(?m)^{_literal(str(p.value))}:"), out).otherwise(new)
    for p in [x for x in patches if x.action != "rename"]:
        lines = rf"(?m)^{_literal(p.key)}:([^\n]*)\n((?:[ \t]+[^\n]*\n|-[^\n]*\n)*)"
        if p.action == "set":
            out = F.regexp_replace(out, F.lit(lines), F.lit(_to(f"{p.key}: {_scalar(p.value)}\n")))
        else:
            value, below = F.trim(F.regexp_extract(out, lines, 1)), F.regexp_extract(out, lines, 2)
            is_list = (value.startswith("[") & ~value.startswith("[[")) | F.trim(below).startswith("-") | (value == "") | value.isin("null", "~")
            wrapped = F.regexp_replace(out, F.lit(rf"(?m)^({_literal(p.key)}):[ \t]*([^\n]*?)[ \t]*\n"), F.lit("$1: [$2]\n"))
            out = F.when(is_list, out).otherwise(wrapped)
    return F.when(head == "", raw).otherwise(F.concat(F.lit("---\n"), out, rest))


def _scalar_key(key: str) -> str:
    return key if re.match(r"[a-zA-Z_][a-zA-Z0-9_\-]*\Z", key) else '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'


def patch_header(raw: Column, key: str, value: str) -> Column:
    """Set one key of the header."""
    return patch(raw, [Patch("set", key, value)])


def write_notes(notes: DataFrame, folder: str) -> int:
    """Write notes (path, raw) as files below a folder, each by the task that holds it; the number
    written. The folder is a path that all executors share, or the address of a store that pyarrow
    opens (s3, gs, hdfs, abfs, file); a path leaving it is an error."""

    def run(rows):
        import uuid

        from pyarrow import fs

        n, (store, base) = 0, fs.FileSystem.from_uri(folder)
        for r in rows:
            if any(p in ("", ".", "..") for p in r["path"].split("/")):
                raise ValueError(f"path {r['path']}")
            at = f"{base.rstrip('/')}/{r['path']}"
            store.create_dir(at.rpartition("/")[0], recursive=True)
            draft = f"{at}.{uuid.uuid4().hex}.draft"
            with store.open_output_stream(draft) as f:
                f.write(r["raw"].encode())
            store.move(draft, at)  # a task that runs twice leaves the same file
            n += 1
        yield n

    return sum(notes.select("path", "raw").rdd.mapPartitions(run).collect())


__all__ = ["Patch", "attachment_class", "body", "embed_report", "embeds", "flat_fields", "header", "links", "media_type", "patch", "patch_header", "plain_text", "read_attachments", "read_notes", "resolve_embeds", "serialize", "summary", "write_notes"]
