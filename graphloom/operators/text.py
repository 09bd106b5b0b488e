"""Full text: a query grammar, positional postings written in folders, boolean search, BM25.

A search over postings reads only the folders (and, as files are sorted by term, the row groups) of
the terms it names, and no text: places of the words of a phrase are intersected, all terms with
a prefix count as one, and a term, phrase or prefix is ranked as a unit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import dealt

TOKEN = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")


class QuerySyntaxError(ValueError):
    """A full-text expression that cannot be parsed."""


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


# ---- grammar --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    """Words that follow each other, the last one perhaps the beginning of a word."""

    words: tuple[str, ...]
    prefix: bool = False


#: An expression: a Unit, or (operator, left, right) with AND, OR or NOT (left without right).
Expression = Unit | tuple


def parse(expression: str) -> Expression:
    """Neighbouring units (an implied AND) bind tightest, then NOT, then AND, then OR; all from the
    left. Parentheses group; what they enclose is joined to others by an operator only."""
    parts = re.findall(r'"((?:[^"]|"")*)"(\s*\*)?|([()])|([^\s()"*]+)(\*)?|(\S)', expression)
    if any(p[5] or re.search(r"[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]", p[3]) for p in parts):
        raise QuerySyntaxError(expression)
    # a token is a Unit, or one of ( ) AND OR NOT
    line: list = [p[2] or (p[3] if p[3] in ("AND", "OR", "NOT") and not p[4] else Unit(tuple(_WORD.findall((p[0] or p[3]).lower())), bool(p[1] or p[4]))) for p in parts]
    at = 0

    def peek():
        return line[at] if at < len(line) else None

    def primary() -> Expression:
        nonlocal at
        got: Expression | str | None = peek()
        at += 1
        if got == "(":
            got = level(0)
            if peek() != ")":
                raise QuerySyntaxError(expression)
            at += 1
            return got
        if not isinstance(got, Unit):
            raise QuerySyntaxError(expression)
        while isinstance(peek(), Unit):
            got = ("AND", got, peek())
            at += 1
        return got

    def level(k: int) -> Expression:
        nonlocal at
        if k == 3:
            return primary()
        left = level(k + 1)
        while peek() == ("OR", "AND", "NOT")[k]:
            at += 1
            left = (("OR", "AND", "NOT")[k], left, level(k + 1))
        return left

    out = level(0) if line else None
    if out is None or at < len(line):
        raise QuerySyntaxError(expression)
    return out


def units(e: Expression) -> list[Unit]:
    """All units of an expression in order, each as often as it stands there."""
    return [e] if isinstance(e, Unit) else units(e[1]) + units(e[2])


def _fold(e: Expression, has) -> Column:
    """The condition of an expression; has() gives that of each unit, in order."""
    if isinstance(e, Unit):
        return has(e)
    a, b = _fold(e[1], has), _fold(e[2], has)
    return a & b if e[0] == "AND" else a | b if e[0] == "OR" else a & ~b


# ---- over texts -----------------------------------------------------------------------------


def _in_words(u: Unit, words: Column) -> Column:
    if not u.words:
        return F.lit(False)
    if len(u.words) == 1:
        return F.exists(words, lambda w: w.startswith(u.words[0])) if u.prefix else F.array_contains(words, u.words[0])
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(line, F.lit(" " + " ".join(u.words) + ("" if u.prefix else " ")))


def predicate(expression: str, words: Column) -> Column:
    return _fold(parse(expression), lambda u: _in_words(u, words))


def search(docs: DataFrame, expression: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of matching texts, by a look at each of them; for repeated searches see postings()."""
    return docs.select(id, tokens(F.col(text)).alias("__w")).filter(predicate(expression, F.col("__w"))).select(id)


def _count(term: str) -> Column:
    return F.size(F.filter("__w", lambda w: w == F.lit(term)))


def bm25(docs: DataFrame, terms: list[str], id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, every: bool = True) -> DataFrame:
    """(id, rank) of documents with all terms (or any); the smaller rank is the better."""
    tf = [_count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    d = docs.select(id, tokens(F.col(text)).alias("__w")).select(id, F.size("__w").alias("len"), *tf)
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    if not stats["n"]:
        return d.select(id, F.lit(0.0).alias("rank"))
    has = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    hits = d.filter(reduce(and_ if every else or_, has))
    return hits.select(id, (-_score([(F.col(f"tf{i}"), stats[f"df{i}"]) for i in range(len(terms))], stats["n"], stats["avgdl"], k1, b)).alias("rank"))


def _score(parts: list[tuple[Column, int]], n: int, average: float, k1: float, b: float) -> Column:
    """The sum over (frequency in the text, texts that have it) of units; len is the text's length."""
    score = F.lit(0.0)
    for tf, df in parts:
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (average or 1.0)))
    return score


# ---- over postings --------------------------------------------------------------------------

#: Folders of terms that begin with a letter or digit beyond ASCII.
OTHER_FOLDERS = 64


@dataclass
class TextIndex:
    """postings(term, id, positions, len, folder) · lengths(id, len). len counts a text's tokens."""

    postings: DataFrame
    lengths: DataFrame


def folder(term: Column) -> Column:
    """The folder of a term, which its first character tells."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise(F.format_string("other-%02d", F.pmod(F.crc32(first.cast("binary")), F.lit(OTHER_FOLDERS))))


def _folder_of(term: str) -> str:
    import zlib

    return term[0] if term[0].isascii() else f"other-{zlib.crc32(term[0].encode()) % OTHER_FOLDERS:02d}"


#: Words that are grouped at once, and postings that are handed on at once.
WORDS_AT_ONCE, POSTINGS_AT_ONCE = 1_000_000, 100_000


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", few: bool = False) -> TextIndex:
    """The index of texts, as expressions; see sorted_by_term() for writing it. Texts, unless they are few, are dealt once;
    the words of a text are then grouped where it is, in Arrow batches, without a row for each word."""
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    w = (texts if few else dealt(texts, "id")).select("id", tokens(F.coalesce("t", F.lit(""))).alias("w"))
    kind = dict(w.dtypes)["id"]
    most, handed = WORDS_AT_ONCE, POSTINGS_AT_ONCE

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ids = batch.column("w"), batch.column("id")
        size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        key = row * max(1, len(coded.dictionary)) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = order[first]
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place[order], pa.int32()))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[at])), ids.take(pa.array(row[at])), positions, pa.array(size[row[at]], pa.int32())], names=["term", "id", "positions", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(batch.column("w").value_lengths().to_numpy(zero_copy_only=False)) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                out = grouped(batch.slice(i, j - i))
                for k in range(0, out.num_rows, handed):
                    yield out.slice(k, handed)

    each = w.mapInArrow(run, f"term string, id {kind}, positions array<int>, len int")
    return TextIndex(each.withColumn("folder", folder(F.col("term"))), docs.select(F.col(id).alias("id"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("len")))


def sorted_by_term(p: DataFrame) -> DataFrame:
    """Postings for writing in folders: dealt by ranges of (folder, term, id), so that the rows of a
    frequent term are many tasks' work and a file's row groups hold few terms."""
    return p.repartitionByRange("folder", "term", "id").sortWithinPartitions("folder", "term", "id")


def ranked(index: TextIndex, expression: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, rank) of the texts that match an expression, by BM25 over all its units; the smaller
    rank is the better."""
    e = parse(expression)
    every = units(e)
    distinct = list(dict.fromkeys(every))
    p = index.postings
    nothing = p.select("id", F.lit(0.0).alias("rank")).limit(0)
    whole = sorted({w for u in distinct for w in (u.words[:-1] if u.prefix else u.words)})
    starts = sorted({u.words[-1] for u in distinct if u.prefix and u.words})
    if not whole and not starts:
        return nothing
    is_term = reduce(or_, [*([F.col("term").isin(whole)] if whole else []), *(F.col("term").startswith(s) for s in starts)])
    hits = p.filter(F.col("folder").isin(sorted({_folder_of(w) for w in [*whole, *starts]})) & is_term)

    # one row for each text, with the places of each word and prefix
    places = {}
    for w in whole:
        places[w, False] = F.max(F.when(F.col("term") == w, F.col("positions")))
    for s in starts:
        places[s, True] = F.flatten(F.collect_list(F.when(F.col("term").startswith(s), F.col("positions"))))
    names = {key: f"p{i}" for i, key in enumerate(places)}
    texts = hits.groupBy("id").agg(F.max("len").alias("len"), *(c.alias(names[k]) for k, c in places.items()))

    def frequency(u: Unit) -> Column:
        """Places where the first word stands with each other word as far behind as in the unit."""
        if not u.words:
            return F.lit(0)
        at = [_shifted(names[w, u.prefix and i == len(u.words) - 1], i) for i, w in enumerate(u.words)]
        return F.coalesce(F.size(reduce(F.array_intersect, at)), F.lit(0))

    tf = {u: f"tf{i}" for i, u in enumerate(distinct)}
    texts = texts.select("id", "len", *(F.when(frequency(u) > 0, frequency(u)).otherwise(0).alias(c) for u, c in tf.items()))
    found = texts.agg(*(F.count_if(F.col(c) > 0).alias(c) for c in tf.values())).first()
    n, average = index.lengths.agg(F.count("*"), F.avg("len")).first()
    match = texts.filter(_fold(e, lambda u: F.col(tf[u]) > 0))
    return match.select("id", (-_score([(F.col(tf[u]), found[tf[u]]) for u in every], n, average, k1, b)).alias("rank"))


def _shifted(name: str, by: int) -> Column:
    return F.transform(name, lambda x: x - by) if by else F.col(name)
