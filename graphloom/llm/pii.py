r"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by fixed patterns and always stay. Further spans
(secret, ssn, name, number) are proposed by three labelers, each by its own means: a regular
expression (the shape of the span), a gazetteer (given names, key prefixes, account prefixes) and the
context (cue words before the span). Each labeler then votes for or against every proposed span, or
abstains. For each kind, expectation-maximisation over the counts of vote patterns of all texts
estimates how reliable the labelers are; its posteriors are the soft labels of a logistic regression
whose features are other than the votes: hashed character trigrams and shape of the span, the words
next to it and the character before it. It is fitted on a bounded sample of spans (TRAIN_SPANS, those
first by hash), and decides on every span.

Defined results: a null text counts as empty; equal texts get equal spans; of spans that overlap the
one that starts first counts (of equal starts the longer, then the first kind), base ones before
others; with no proposed span nothing is learned and only base spans come back; each row gives one
row, whether its id is null or repeated; extra columns are ignored by op10 and kept by redact; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ready, load, materialize, scope

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "ssn", "name", "number")
KINDS = BASE + MORE

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
# possessive, and never from inside a run of digits: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_SECRET = re.compile(r"[=:][ ]?[\"']?([A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CAPS = r"[A-Z\u00c0-\u00de][a-z\u00df-\u00ff]+"
_NAME = re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ({_CAPS}(?: {_CAPS})?)")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.,-])[0-9](?:[ -]?[0-9]){6,}(?![0-9A-Za-z])")

#: Fixed word lists of the gazetteer and context labelers.
_GIVEN = frozenset(
    "James John Robert Michael William David Richard Thomas Charles Daniel Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Hans Peter Klaus Wolfgang "
    "Stefan Petra Monika Sabine Ursula Heike Jean Pierre Michel Philippe Marie Nathalie Isabelle Sophie Juan Carlos Luis Miguel Pedro Maria Carmen Lucia Elena Sofia".split()
)
_KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
_KEY_STARTS = re.compile(rf"(?<![A-Za-z0-9])((?:{'|'.join(_KEY_HEADS)})[A-Za-z0-9_.-]{{9,}}[A-Za-z0-9_])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])((?:DE|FR|ES|IT|NL|BE|AT|CH|GB|IE|PT)[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])")
_NOT_NAMES = frozenset("The This That Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())
_CUES = {
    4: frozenset("password passwd pwd secret token key apikey api_key access_key auth credential bearer passphrase".split()),
    5: frozenset("ssn social security".split()),
    6: frozenset("name named called patient customer contact signed sincerely regards author born".split()),
    7: frozenset("account passport iban number id phone call tel fax license".split()),
}
#: The kinds that each cue word stands for; longer words first, so that api_key isn't key.
_CUE_KINDS = {w: [k for k, c in _CUES.items() if w in c] for w in sorted({w for c in _CUES.values() for w in c}, key=lambda w: (-len(w), w))}
_HONORIFICS = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")
_AFTER = {
    4: re.compile(r"[ ]?(?:is|was)?[ ]?[=:]?[ ]?[\"']?([A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_])"),
    5: re.compile(r"[ ]?(?:is|no|number)?[ ]?[=:#]?[ ]?([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9])"),
    6: re.compile(rf"(?:[ ]?(?:is|was|by)|,)?[:]?[ ]({_CAPS}(?: {_CAPS}){{1,2}})"),
    7: re.compile(r"[ ]?(?:is|no|number)?[.]?[ ]?[=:#]?[ ]?([A-Z]{0,2}[0-9][0-9 -]{4,}[0-9])(?![0-9A-Za-z])"),
}
_CAP_WORDS = re.compile(rf"\b{_CAPS}(?: {_CAPS})*")
_WORD = re.compile(r"[A-Za-z_]+")
_HEX = re.compile(r"[0-9a-f]{12,}\Z")
#: Bounds: spans the classifier is fitted on, and hashed features.
TRAIN_SPANS, HASHED = 20_000, 4_096


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind as in BASE, then start."""
    out, low, p = [], 0, t.find("@")
    while p >= 0:
        s = p
        while s > low and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            out.append((0, s, m.end()))
            low = m.end()
        else:
            low = p + 1
        p = t.find("@", p + 1)
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() > 15 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _cue_words(t: str) -> Iterator[tuple[str, list[int], int]]:
    """Each cue word that stands alone in a text, in any case, its kinds and its end."""
    low = t.lower()
    if len(low) != len(t):  # a few letters become two
        low = t.translate(_LOWER)
    for cue, kinds in _CUE_KINDS.items():
        p = low.find(cue)
        while p >= 0:
            end = p + len(cue)
            if (p == 0 or low[p - 1] not in _WORDLIKE) and (end == len(low) or low[end] not in _WORDLIKE):
                yield cue, kinds, end
            p = low.find(cue, end)


_LOWER = {c: c + 32 for c in range(65, 91)}
_WORDLIKE = frozenset("abcdefghijklmnopqrstuvwxyz_")


def _proposed(t: str) -> dict[tuple[int, int, int], int]:
    """(kind, start, end) of each proposed span -> labelers that propose it (1 shape, 2 gazetteer, 4 context)."""
    out: dict[tuple[int, int, int], int] = {}

    def add(kind: int, m: re.Match, group: int, who: int) -> None:
        key = (kind, m.start(group), m.end(group))
        out[key] = out.get(key, 0) | who

    digits = _DIGIT.search(t) is not None
    if "=" in t or ":" in t:
        for m in _SECRET.finditer(t):
            add(4, m, 1, 1)
    if digits:
        for m in _SSN.finditer(t):
            add(5, m, 0, 1)
        for m in _NUMBER.finditer(t):
            add(7, m, 0, 1)
        for m in _ACCOUNT.finditer(t):
            add(7, m, 1, 2)
    # plain searches tell quickly that most texts hold none of the words
    if any(k in t for k in _KEY_HEADS):
        for m in _KEY_STARTS.finditer(t):
            add(4, m, 1, 2)
    if any(h in t for h in _HONORIFICS):
        for m in _NAME.finditer(t):
            add(6, m, 1, 1)
    for m in _CAP_WORDS.finditer(t) if any(g in t for g in _GIVEN) else ():
        words = m[0].split(" ")
        for i, w in enumerate(words):
            if w in _GIVEN:
                s = m.start() + sum(map(len, words[:i])) + i
                key = (6, s, s + sum(map(len, words[i : i + 3])) + len(words[i : i + 3]) - 1)
                out[key] = out.get(key, 0) | 2
                break
    for cue, kinds, end in _cue_words(t):
        for kind in kinds:
            n = _AFTER[kind].match(t, end)
            if n and (kind in (5, 6, 7) or _DIGIT.search(n[1])):
                add(kind, n, 1, 4)
    return out


def _votes(kind: int, body: str, before: list[str], who: int) -> int:
    """Votes of the three labelers in base 3: 0 abstains, 1 against, 2 for."""
    if kind == 4:
        shape = 1 if not _DIGIT.search(body) else 2 if who & 1 or _HEX.match(body) else 0
    else:
        shape = 2 if who & 1 else 0
    if who & 2:
        listed = 2
    elif kind == 5:
        listed = 1 if body[:3] in ("000", "666") or body[0] == "9" else 0
    elif kind == 6:
        listed = 1 if not _NOT_NAMES.isdisjoint(body.split(" ")) else 0
    else:
        listed = 0
    context = 2 if who & 4 or any(w in _CUES[kind] for w in before) else 1
    return (shape * 3 + listed) * 3 + context


def _features(kind: int, t: str, s: int, e: int, before: list[str]) -> list[int]:
    """Places of the classifier's features, none of which is a vote."""
    body = t[s:e]
    digits = sum(map(str.isdigit, body))
    shape = re.sub(r"[a-z\u00df-\u00ff]+", "a", re.sub(r"[A-Z\u00c0-\u00de]", "A", re.sub(r"[0-9]+", "0", body)))
    names = [f"k{kind}", f"{kind}n{min(12, (e - s) // 4)}", f"{kind}d{4 * digits // len(body)}", f"{kind}s{shape}", f"{kind}p{t[s - 1] if s else ''}", f"{kind}w{before[-1] if before else ''}"]
    names += [f"{kind}q{len(set(body)) // 4}", f"{kind}x{sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:])) // 3}"]
    names += [f"{kind}t{body[i : i + 3].lower()}" for i in range(len(body) - 2)] if kind == 6 else []
    return sorted({xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) % HASHED for n in names})


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind, start, end, votes, features) of the proposed spans outside base ones, none of which
    overlap, by start. One sweep over both lists."""
    found = _proposed(t)
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, last, at = [], 0, 0
    for (kind, s, e), who in sorted(found.items(), key=lambda x: (x[0][1], -x[0][2], x[0][0])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        # the first base span that ends behind s begins before all later ones
        if s < last or at < len(taken) and taken[at][0] < e:
            continue
        last = e
        before = [w.lower() for w in _WORD.findall(t[max(0, s - 40) : s])][-4:]
        out.append((kind, s, e, _votes(kind, t[s:e], before, who), _features(kind, t, s, e, before)))
    return out


def reliabilities(counts: dict[int, float], labelers: int = 3, rounds: int = 50) -> tuple[float, np.ndarray, dict[int, float]]:
    """EM over vote patterns: prior, P(vote | class) for each labeler, posterior of each pattern."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    votes = np.array([[c // 3 ** (labelers - 1 - j) % 3 for j in range(labelers)] for c in codes]).reshape(len(codes), labelers)
    score = (votes == 2).sum(1) - (votes == 1).sum(1)
    post = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    table = np.zeros((labelers, 2, 3))
    prior = 0.5
    for _ in range(rounds):
        # a weak prior that votes are right keeps few spans from turning the classes round
        prior = float(np.clip(((n * post).sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        for j in range(labelers):
            for v, (yes, no) in enumerate(((2, 2), (1, 3), (3, 1))):
                at = votes[:, j] == v
                table[j, 1, v], table[j, 0, v] = (n * post)[at].sum() + yes, (n * (1 - post))[at].sum() + no
            table[j] /= table[j].sum(axis=1, keepdims=True)
            # a labeler is never worse than chance
            if table[j, 1, 2] < table[j, 0, 2]:
                table[j, :, 2] = table[j, :, 2].mean()
        like = [np.log(p) + sum(np.log(table[j, c, votes[:, j]]) for j in range(labelers)) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return prior, table, dict(zip(codes, post.tolist()))


def train_classifier(rows: list[tuple[list[int], float, float]], rounds: int = 300) -> np.ndarray:
    """Weights of the hashed features from (features, soft label, weight) by accelerated gradient."""
    w = np.zeros(HASHED)
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    n = n / n.sum()
    most = max(len(r[0]) for r in rows)
    momentum, step, ridge = w.copy(), 4.0 / most, 1e-4
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, momentum[at], len(rows)), -30, 30)))
        grad = np.bincount(at, (n * (p - y))[of], HASHED) + ridge * momentum
        new = momentum - step * grad
        momentum, w = new + k / (k + 3) * (new - w), new
    return w


def accepts(weights: np.ndarray, features: list[int]) -> bool:
    return bool(weights[features].sum() > 0)


_SPAN = "array<struct<kind:int,s:int,e:int>>"
_CAND = "array<struct<kind:int,s:int,e:int,votes:int,f:array<int>>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base spans, proposed spans of whole texts."""
    arrow_ready(docs.sparkSession)
    span = pa.list_(pa.struct([(k, pa.int32()) for k in ("kind", "s", "e")]))
    cand = pa.list_(pa.struct([*[(k, pa.int32()) for k in ("kind", "s", "e", "votes")], ("f", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for t in b.column(1).to_pylist():
                found = base_spans(t or "")
                base.append([dict(zip(("kind", "s", "e"), x)) for x in found])
                more.append([dict(zip(("kind", "s", "e", "votes", "f"), x)) for x in candidates(t or "", found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(more, cand)], names=["doc_id", "base", "more"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id long, base {_SPAN}, more {_CAND}")


def learn(scanned: DataFrame) -> np.ndarray:
    """Weights of the span classifier from a materialised table of scan()."""
    spans = scanned.select(F.explode("more").alias("x")).select("x.kind", "x.votes", "x.f")
    # at most 27 patterns of a kind
    counts = spans.groupBy("kind", "votes").count().collect()
    post = {}
    for kind in sorted({r["kind"] for r in counts}):
        _, _, p = reliabilities({r["votes"]: float(r["count"]) for r in counts if r["kind"] == kind})
        post |= {(kind, v): x for v, x in p.items()}
    # equal spans count once each with their number; the sample is bounded, and the same in every run
    few = spans.groupBy("kind", "votes", "f").count().orderBy(F.xxhash64("kind", "votes", "f"), "kind", "votes", "f").limit(TRAIN_SPANS).collect()
    rows = sorted((tuple(r["f"]), r["kind"], r["votes"], r["count"]) for r in few)
    return train_classifier([(list(f), post[k, v], float(n) ** 0.5) for f, k, v, n in rows])


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"], x["e"])), ",")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    with scope() as keep:
        found = keep(materialize(scan(docs), "spans"))
        weights = learn(found)
    # HASHED numbers as one constant
    known = F.from_json(F.lit(json.dumps(weights.tolist())), "array<double>")
    sure = F.filter("more", lambda x: F.aggregate(x["f"], F.lit(0.0), lambda total, i: total + F.get(known, i)) > 0)
    keep_ = F.array_sort(sure)
    spans = F.concat_ws(",", *[F.nullif(_joined(x), F.lit("")) for x in (F.col("base"), keep_)])
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets, n_chars brought up to date."""
    spark = docs.sparkSession
    with scope():
        weights = learn(materialize(scan(docs), "spans"))
    cols = docs.columns
    at, n_at = cols.index("text"), cols.index("n_chars") if "n_chars" in cols else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], b.column(n_at).to_pylist() if n_at >= 0 else []
            for i, t in enumerate(b.column(at).to_pylist()):
                base = base_spans(t or "")
                spans = sorted((s, -e, k) for k, s, e in [*base, *(x[:3] for x in candidates(t or "", base) if accepts(weights, x[4]))])
                if spans:
                    parts, done = [], 0
                    for s, e, k in spans:
                        if s >= done:
                            parts += [t[done:s], f"<{KINDS[k].upper()}>"]
                        done = max(done, -e)
                    t = "".join([*parts, t[done:]])
                    if n_at >= 0:
                        sizes[i] = len(t)
                texts.append(t)
            out = list(b.columns)
            out[at] = pa.array(texts, b.schema.field(at).type)
            if n_at >= 0:
                out[n_at] = pa.array(sizes, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    arrow_ready(spark)
    return docs.mapInArrow(run, docs.schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(spark, load(spark, sf_dir, "documents"))
