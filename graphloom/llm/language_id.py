"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A whole text is parsed into the
longest phrases that occur in a language's training text; the language that needs the fewest
phrases for each symbol, each priced at the logarithm of the training text's length, wins. A symbol
is a letter (every letter that training saw has its own) or the break between two words; a symbol
that the training text doesn't have is a phrase of its own.

The automata are built on the driver as compact arrays: a transition of state s by symbol c stands
at place s + c of one array, together with s. The parse of a text is worked out in blocks side by
side: each block is first parsed as if a phrase began with it; then the state that truly enters a
block is followed until it meets the first parse in the same state, which is done again for blocks
whose entry changed by that. The number of phrases is that of one parse from the start.

Defined results: a null text and a text without any letter give `und` with score 0; repeated rows
and ids give the same answer each time (ties go to the language that sorts first); with no labelled
row at all every text is `und`; an empty table gives no rows; extra columns are ignored by op2 and
kept by keep_known, whatever their names (names that begin with two underscores are reserved).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_ready, crc_mod_col, drop, first_by_hash, in_chunks, load, materialize

UND = "und"
#: Symbols of a block; it changes no result.
BLOCK = 256
#: Bounds of training: symbols of each language, languages that get so many (of more, all share
#: as many symbols as these have together), characters used of one text, texts of a language.
TRAIN_SYMBOLS, FULL_LANGS, TRAIN_TEXT, TRAIN_DOCS = 60_000, 64, 20_000, 400


class Alphabet:
    """Maps letters (most frequent first) to codes from 2 on; 1 is a letter that training hasn't
    seen, and every run of other characters is one 0."""

    def __init__(self, letters: str):
        self.letters = letters
        if not hasattr(Alphabet, "_is_letter"):
            Alphabet._is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.lut = self._is_letter.astype(np.int32)
        self.lut[np.frombuffer(letters.encode("utf-32-le"), np.uint32)] = np.arange(2, len(letters) + 2)

    @staticmethod
    def learn(texts: list[str]) -> Alphabet:
        n = Counter(c for t in texts for c in t.lower() if c.isalpha())
        return Alphabet("".join(c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))))

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    def codes(self, text: str) -> np.ndarray:
        p = self.lut[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = p != 0
        keep[1:] |= p[:-1] != 0
        return p[keep]


class Automaton:
    """A suffix automaton in one array. State s has a transition by c where entries[s + c] >> 32 is
    s; its lower half is the next state. From `dead` there is no transition; first[c] is the state
    after a phrase that begins with c."""

    def __init__(self, codes: np.ndarray, symbols: int):
        nxt = _transitions(codes)
        self.length = len(codes)
        base, last = _places(nxt)
        self.dead = last + 1
        self.entries = np.full(self.dead + symbols + 1, -1, np.int64)
        state = [self.dead if b is None else b for b in base]
        for s, d in enumerate(nxt):
            for c, t in d.items():
                self.entries[base[s] + c] = (base[s] << 32) | state[t]
        self.first = np.full(symbols, self.dead, np.int64)
        for c, t in nxt[0].items():
            self.first[c] = state[t]


def _transitions(codes: np.ndarray) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _places(nxt: list[dict[int, int]]) -> tuple[list[int | None], int]:
    """A base for every state with transitions, so that no two transitions share a place and no two
    states a base; and the last place taken. States with many transitions come first; the search
    goes on from where it last had to try often, so that it takes no long ways over full places."""
    base: list[int | None] = [None] * len(nxt)
    taken, bases = set(), set()
    low = 0
    for s in sorted((i for i, d in enumerate(nxt) if d), key=lambda i: (-len(nxt[i]), i)):
        own = sorted(nxt[s])
        at = start = max(0, low - own[0])
        while at in bases or any(at + c in taken for c in own):
            at += 1
        if at - start > 24:
            low = max(low, at + own[0] - 8)
        while low in taken:
            low += 1
        base[s] = at
        bases.add(at)
        taken.update(at + c for c in own)
    return base, max(taken, default=0)


class Blocks:
    """Codes of texts (codes[starts[i]:starts[i + 1]], int64) cut into blocks, the longest first."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.texts = len(starts) - 1
        n = np.diff(starts)
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), blocks)
        first = starts[:-1][doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        sizes = np.minimum(BLOCK, starts[1:][doc] - first)
        order = self.order = np.argsort(-sizes, kind="stable")
        self.doc, self.sizes = doc[order], sizes[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.concatenate([[False], doc[1:] == doc[:-1]])[: len(doc)]
        #: place of the block before, or -1
        self.before = np.where(follows, np.concatenate([[-1], place[:-1]])[: len(doc)], -1)[order]
        self.active = np.searchsorted(-self.sizes, -np.arange(BLOCK), side="left").tolist()
        most = int(self.sizes[0]) if len(order) else 0
        padded = np.concatenate([codes, np.zeros(BLOCK, codes.dtype)])
        view = np.lib.stride_tricks.sliding_window_view(padded, max(most, 1))[first[order]]
        #: row t: symbol t of every block
        self.columns = np.ascontiguousarray(view.T[:most])


def phrases(a: Automaton, b: Blocks) -> np.ndarray:
    """Number of phrases of each text."""
    entries, first_state, dead = a.entries, a.first, a.dead
    width, most = len(b.order), len(b.columns)
    # each block as if a phrase began with it, one symbol of all at a time
    state = np.full(width, dead, np.int64)
    begins = np.zeros((most, width), np.int16)
    states = np.empty((most, width), np.int32)
    here, found, other = (np.empty(width, np.int64) for _ in range(3))
    for t, c in enumerate(b.columns):
        k = b.active[t]
        c, s, e, o = c[:k], state[:k], found[:k], other[:k]
        np.add(s, c, out=here[:k])
        entries.take(here[:k], out=e, mode="clip")
        np.right_shift(e, 32, out=o)
        fresh = np.not_equal(o, s)
        np.bitwise_and(e, 0xFFFFFFFF, out=s)
        first_state.take(c, out=o, mode="clip")
        np.copyto(s, o, where=fresh)
        begins[t, :k] = fresh
        states[t, :k] = s
    upto = np.cumsum(begins, axis=0, dtype=np.int16)  # phrases begun up to and with a symbol
    last = np.where(b.sizes > 0, b.sizes - 1, 0)
    whole = upto[last, np.arange(width)].astype(np.int64)
    count, leave, alone = whole.copy(), state.copy(), state.copy()
    # what enters a block is what leaves the one before it in the same text
    entry = np.full(width, dead, np.int64)
    flat = memoryview(entries)
    while True:
        now = np.where(b.before >= 0, leave[b.before], dead)
        run = np.flatnonzero(now != entry)
        if not len(run):
            break
        entry = now
        s, got, t = entry[run], np.zeros(len(run), np.int64), 0
        while len(run) > 12:
            c = b.columns[t, run]
            e = entries[s + c]
            fresh = (e >> 32) != s
            s = np.where(fresh, first_state[c], e & 0xFFFFFFFF)
            got += fresh
            met = s == states[t, run]
            at = run[met]
            count[at], leave[at] = got[met] + whole[at] - upto[t, at], alone[at]
            t += 1
            out = ~met & (b.sizes[run] == t)
            count[run[out]], leave[run[out]] = got[out], s[out]
            go = ~(met | out)
            run, s, got = run[go], s[go], got[go]
        for k, x, n in zip(run.tolist(), s.tolist(), got.tolist()):  # few are left: one by one
            symbols, alike, size = b.columns[t:, k].tolist(), states[t:, k].tolist(), int(b.sizes[k])
            for i in range(size - t):
                e = flat[x + symbols[i]]
                if e >> 32 != x:
                    n += 1
                    x = int(first_state[symbols[i]])
                else:
                    x = e & 0xFFFFFFFF
                if x == alike[i]:
                    count[k], leave[k] = n + whole[k] - int(upto[t + i, k]), alone[k]
                    break
            else:
                count[k], leave[k] = n, x
    return np.bincount(b.doc, count, b.texts).astype(np.int64)


class Model:
    """Automata of all languages; predict() takes texts and gives names and scores."""

    def __init__(self, langs: list[str], samples: list[str], symbols: int = TRAIN_SYMBOLS):
        self.langs = langs
        alphabet = Alphabet.learn(samples)
        self.letters = alphabet.letters
        most = min(symbols, FULL_LANGS * symbols // max(1, len(samples)))
        self.automata = [Automaton(alphabet.codes(s)[:most], alphabet.size) for s in samples]
        self.alphabet: Alphabet | None = alphabet

    def __getstate__(self) -> dict:
        return vars(self) | {"alphabet": None}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return [UND] * len(texts), [0.0] * len(texts)
        if self.alphabet is None:
            self.alphabet = Alphabet(self.letters)
        codes = [self.alphabet.codes(t or "") for t in texts]
        n = np.array([len(c) for c in codes], np.int64)
        letters = np.array([int(np.count_nonzero(c)) for c in codes])
        flat = np.concatenate([*codes, np.zeros(1, np.int32)]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        blocks = Blocks(flat, starts)
        cost = np.stack([phrases(a, blocks) for a in self.automata])
        size = np.log([a.length + 2 for a in self.automata])[:, None]
        bits = cost * size / np.maximum(n, 1)
        best = bits.argmin(axis=0)
        p = np.exp(-(bits - bits.min(axis=0)) * np.minimum(n, 40))
        score = (1 / p.sum(axis=0)).clip(0, 1)
        ok = letters > 0
        return [self.langs[b] if o else UND for b, o in zip(best.tolist(), ok.tolist())], np.where(ok, score, 0.0).tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", symbols: int = TRAIN_SYMBOLS) -> Model:
    """Learn from rows with a text and a label.

    The sample is bounded and holds every language that has a label: of its distinct texts those
    first by hash, TRAIN_DOCS at most, until twice its share of symbols is reached (one text at
    least); of a text TRAIN_TEXT characters at most are learned from.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null and t rlike '\\\\p{L}'").withColumn("h", F.xxhash64(F.lit(7), "t"))
    seen = materialize(rows.groupBy("l", "h").agg(F.min(F.least(F.length("t"), F.lit(TRAIN_TEXT))).alias("n")), "texts")
    langs = seen.select("l").distinct().count()
    if not langs:
        drop(seen)
        return Model([], [])
    budget = 2 * min(symbols, FULL_LANGS * symbols // langs)
    few = first_by_hash(seen.withColumnRenamed("n", "symbols"), ["l"], ["h"], TRAIN_DOCS)
    first = Window.partitionBy("l").orderBy("h")
    few = few.withColumn("before", F.coalesce(F.sum("symbols").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < budget)
    few = materialize(few.select("l", "h"), "chosen")
    # at most TRAIN_DOCS hashes of a language, with the symbols of FULL_LANGS languages together
    taken = rows.join(F.broadcast(few), ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, min(budget, TRAIN_TEXT))).alias("t")).collect()
    drop(seen)
    drop(few)
    by: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r["l"], r["h"])):
        by.setdefault(r["l"], []).append(r["t"])
    names = sorted(by)
    return Model(names, ["\n".join(by[k])[:budget] for k in names], symbols)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (default: all) of docs, with the prediction and its score as `names`."""
    spark = docs.sparkSession
    arrow_ready(spark)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, scores = b.column(b.num_columns - 1).to_pylist(), [], []
            for i, j in in_chunks(texts, 2_000_000):
                got = shared.value.predict(texts[i:j])
                found += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], *names])

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out third (crc32 of the id's text, mod 3, is 1)."""
    return docs.filter(F.coalesce(crc_mod_col(F.col("doc_id")) != 1, F.lit(True)))


def op2(spark: SparkSession, docs: DataFrame, symbols: int = TRAIN_SYMBOLS) -> DataFrame:
    model = train(training_rows(docs), symbols=symbols)
    rows = docs.select("doc_id", F.coalesce(crc_mod_col(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model, keep=["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that have no language (`und`); a null lang gets the prediction.

    Where training rows name no language at all, documents with a letter stay as they are.
    """
    model = train(training_rows(docs)) if "lang" in docs.columns else Model([], [])
    if not model.langs:
        return docs.filter("text rlike '\\\\p{L}'")
    found = identify(docs, model, names=("__lang", "__sure"))
    kept = found.filter(F.col("__lang") != UND).withColumn("lang", F.coalesce("lang", "__lang"))
    return kept.select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(spark, load(spark, sf_dir, "documents"))


