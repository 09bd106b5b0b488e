r"""Token counts of a unigram segmentation, with forward scores shared in a trie.

A pre-token is U+2581 followed by a word. Its segmentation is the sequence of vocabulary pieces with
the highest sum of scores (on a tie the shorter one); a character that is no piece falls back to one
token for each UTF-8 byte.

The distinct pre-tokens of the whole corpus are gathered first, with their counts, and dealt to tasks
by ranges of their sorted order. A task walks the trie of its pre-tokens branch by branch: a node
holds the forward score and token count of its prefix, worked out once from the nodes above for all
pre-tokens that share it, and is given up when the walk leaves its branch, so that the memory is
that of one branch. The terminal counts are a table (word, count). The texts then take the counts of
the KNOWN most frequent words (of at most SHORT bytes) from a copy of bounded size, and those of all
other words, which are never hot, by a join.

Scores come from the ranks of the vocabulary file by Zipf's law, -log(rank + 1), as the file holds
no unigram scores; the path is the parameter `path` of vocabulary(), for the registered query the
session's setting graphloom.tokenizer.model. The file is read by the driver only.

Defined results: null and blank texts have no tokens; each row gives one row, whether its id is null
or repeated; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, load, materialize, scope, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Words with a copied count, the longest of them in bytes, and distinct words a task holds at once.
KNOWN, SHORT, HELD = 200_000, 64, 200_000
#: Characters from which a pre-token shares no prefix (its nodes would be as many).
LONG = 100_000


def vocabulary(path: str = MODEL) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without its control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            out[sp.id_to_piece(i)] = -math.log(len(out) + 2)
    return out


class TokenTrie:
    """The current branch of the trie of pre-tokens that come in sorted order."""

    def __init__(self, pieces: dict[str, float]):
        self.fallback = min(pieces.values(), default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        # pieces by their characters from the end: (node, character) -> node, scores of whole pieces
        self.back: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for p, s in pieces.items():
            at = 0
            for c in reversed(p):
                nxt = self.back[at].get(c)
                if nxt is None:
                    nxt = self.back[at][c] = len(self.back)
                    self.back.append({})
                    self.score.append(None)
                at = nxt
            self.score[at] = s
        #: nodes worked out so far, for tests
        self.made = 0
        self._reset()

    def _reset(self) -> None:
        self.branch, self.best, self.tokens = "", [0.0], [0]

    def _extend(self, chars: str, best: list[float], tokens: list[int]) -> None:
        """Append the node of the last of chars, which ends at the depth of the next entry of best."""
        back, score = self.back, self.score
        c = chars[-1]
        size = len(c.encode("utf-8", "surrogatepass"))
        top, n = best[-1] + size * self.fallback, tokens[-1] + size
        at = 0
        for k in range(1, len(chars) + 1):
            at = back[at].get(chars[-k], -1)
            if at < 0:
                break
            s = score[at]
            if s is not None:
                b, t = best[-k] + s, tokens[-k] + 1
                if b > top + 1e-9 or (b > top - 1e-9 and t < n):
                    top, n = b, t
        best.append(top)
        tokens.append(n)
        self.made += 1

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token (a word without its mark)."""
        text = MARK + word.decode("utf-8", "surrogatepass")
        if len(text) > LONG:
            return self._alone(text)
        shared, most = 0, min(len(text), len(self.branch))
        while shared < most and text[shared] == self.branch[shared]:
            shared += 1
        del self.best[shared + 1 :], self.tokens[shared + 1 :]
        for i in range(shared, len(text)):
            self._extend(text[max(0, i + 1 - self.longest) : i + 1], self.best, self.tokens)
        self.branch = text
        return self.tokens[-1]

    def _alone(self, text: str) -> int:
        """The same for a very long pre-token, with only the last nodes in memory."""
        best, tokens = [0.0], [0]
        for i in range(len(text)):
            self._extend(text[max(0, i + 1 - self.longest) : i + 1], best, tokens)
            if len(best) > 4 * self.longest:
                del best[: -self.longest - 1], tokens[: -self.longest - 1]
        return tokens[-1]


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, counted in each task before they are shuffled."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in utf8(b.column(0)):
                if t:
                    seen.update(t.split())
                if len(seen) > HELD:
                    yield part()
                    seen.clear()
        if seen:
            yield part()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_words(words: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """(word, n, tokens) of distinct words (word, n)."""
    arrow_ready(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(shared.value)
        for b in batches:
            tokens = [trie.count(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64())], names=["word", "n", "tokens"])

    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, tokens long")


def count_tokens(docs: DataFrame, pieces: dict[str, float], known: int = KNOWN) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of whole texts."""
    spark = docs.sparkSession
    arrow_ready(spark)
    with scope() as keep:
        words = materialize(count_words(materialize(distinct_words(docs), "words"), pieces), "tokens")
        # at most `known` words of at most SHORT bytes
        top = words.filter(F.octet_length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(known).select("word", "tokens").toArrow()
        counts = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("tokens").to_pylist())))
        rest = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = counts.value.get
            for b in batches:
                size, tokens, others = [], [], []
                for t in utf8(b.column(1)):
                    w = (t or b"").split()
                    got = list(map(get, w))
                    other = Counter(x for x, g in zip(w, got) if g is None) if None in got else {}
                    size.append(len(w))
                    tokens.append(sum(filter(None, got)))
                    others.append([{"word": x, "k": k} for x, k in other.items()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(others, rest)], names=["doc_id", "n_pretokens", "part", "rest"])

        rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, part long, rest array<struct<word:binary,k:long>>")
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "counted")
        rare = rows.select("__row", F.explode("rest").alias("x")).select("__row", "x.word", "x.k").join(words.select("word", "tokens"), "word")
        more = rare.groupBy("__row").agg(F.sum(F.col("k") * F.col("tokens")).alias("more"))
        out = rows.select("__row", "doc_id", "n_pretokens", "part").join(more, "__row", "left")
        return keep(materialize(out.select("doc_id", "n_pretokens", (F.col("part") + F.coalesce("more", F.lit(0))).alias("n_tokens")), "counts"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), vocabulary(spark.conf.get("graphloom.tokenizer.model", MODEL)))
