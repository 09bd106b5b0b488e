r"""Quality rules: a decision list learned by sequential covering, applied as SQL conditions.

Everything that touches rows is a DataFrame or SQL expression. The learner sees only a table of
counts: labelled rows are binned at class quantiles, and the number of good and bad rows in each
combination of bins is gathered (at most BINS ** len(FEATURES) combinations, whatever the input).
Rules are grown on two thirds of the labelled rows, pruned on the rest, and end up as an ordered
CASE of threshold conjunctions, each of which rejects.

Defined results: a null or blank text has zero words and fails the base rule; without labelled
rows of both kinds no rule is learned and only the base rule decides; repeated rows are judged
alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, load, materialize

BINS = 8
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "mean_word": "word_chars / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
}
SPACES = r"[\\x20\\x09-\\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """SQL that works out value once and uses it in body by name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Words in 3-word windows seen twice or more: windows in order of hash, then the places of
#: those equal to a neighbour, then the words that these cover.
REPEATED = _let(
    "__w",
    "w",
    _let(
        "if(size(w) < 4, array(), sort_array(transform(sequence(0, greatest(size(w) - 3, 0)), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as i))))",
        "s",
        _let(
            "sort_array(transform(filter(s, (x, j) -> x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h), x -> x.i))",
            "p",
            "aggregate(transform(p, (x, j) -> if(j + 1 < size(p), least(3, get(p, j + 1) - x), 3)), 0L, (a, x) -> a + x)",
        ),
    ),
)


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each text that the base rule and the learned rules look at."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.expr(f"transform(filter(split(__t, '{SPACES}'), w -> w <> ''), w -> xxhash64(w))"))
    d = d.withColumn("__l", F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_upper": (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
            "n_marks": (F.length("__t") - F.length(F.translate("__t", "!?", ""))).cast("long"),
            "n_repeat_words": F.expr(REPEATED),
        }
    )
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _feature(name: str) -> Column:
    return F.expr(f"coalesce(try_divide({FEATURES[name].replace(' / ', ', ')}), 0D)")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = _feature(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def learn(stats: DataFrame, labels: DataFrame, min_precision: float = 0.9, min_support: int = 5, max_rules: int = 16, max_conditions: int = 4) -> list[Rule]:
    """Ordered reject rules from stats (doc_id, counts) and labels (doc_id, quality 0 or 1)."""
    lab = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q in (0, 1)")
    rows = stats.filter(~base_failed()).join(lab, "doc_id").select("doc_id", "q", *[_feature(f).alias(f) for f in FEATURES])
    rows = materialize(rows, "labelled")
    at = [0.02, 0.2, 0.5, 0.8, 0.98, 0.999]
    quant = rows.groupBy("q").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).collect()
    if {r["q"] for r in quant} != {0, 1}:
        drop(rows)
        return []
    good, bad = (next(r for r in quant if r["q"] == q) for q in (1, 0))
    cuts = {}
    for f in FEATURES:
        # between the classes where they part, else at the good rows' tails and the bad rows' middle
        c = {good[f][0], good[f][4], good[f][5], bad[f][0], bad[f][1], bad[f][2], (good[f][5] + bad[f][1]) / 2}
        cuts[f] = sorted(c)[: BINS - 1]
    binned = rows.select("q", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[sum(((F.col(f) > x).cast("int") for x in cuts[f]), F.lit(0)).alias(f) for f in FEATURES])
    cells = binned.groupBy("held", *FEATURES).agg(F.sum((F.col("q") == 0).cast("long")).alias("bad"), F.sum((F.col("q") == 1).cast("long")).alias("good")).collect()
    drop(rows)
    names = list(FEATURES)
    x = np.array([[r[f] for f in names] for r in cells]).reshape(len(cells), len(names))
    n = np.array([[r["bad"], r["good"]] for r in cells], float).reshape(-1, 2)
    held = np.array([r["held"] for r in cells], bool)
    return cover(x, n, held, names, cuts, min_precision, min_support, max_rules, max_conditions)


def cover(x, n, held, names, cuts, min_precision, min_support, max_rules, max_conditions) -> list[Rule]:
    """Sequential covering over cells: x bins, n counts of (bad, good), held: cells to prune on."""
    left = np.ones(len(x), bool)
    options = [(j, above, k) for j, f in enumerate(names) for k in range(len(cuts[f])) for above in (True, False)]
    masks = {o: (x[:, o[0]] > o[2]) == o[1] for o in options}
    rules: list[Rule] = []

    def count(m):
        return n[m].sum(axis=0)

    while len(rules) < max_rules:
        rule, inside = [], left & ~held
        p, q = count(inside)
        while q > 0 and p > 0 and len(rule) < max_conditions:
            best, gain = None, 1e-9
            for o in options:
                p1, q1 = count(inside & masks[o])
                if p1 > 0:
                    g = p1 * (np.log2(p1 / (p1 + q1)) - np.log2(p / (p + q)))
                    if g > gain:
                        best, gain = o, g
            if best is None:
                break
            rule.append(best)
            inside = inside & masks[best]
            p, q = count(inside)
        if not rule:
            break

        def matches(conds, where):
            m = where.copy()
            for o in conds:
                m &= masks[o]
            return m

        def worth(conds):
            p1, q1 = count(matches(conds, left & held))
            return (p1 - q1) / (p1 + q1) if p1 + q1 else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        all_p, all_q = count(matches(rule, left))
        held_p, held_q = count(matches(rule, left & held))
        if all_p < min_support or all_p < min_precision * (all_p + all_q) or held_p + held_q == 0 or held_p < min_precision * (held_p + held_q):
            break
        rules.append(tuple(Condition(names[j], above, float(cuts[names[j]][k])) for j, above, k in rule))
        left &= ~matches(rule, left)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    out = None
    for rule in rules:
        c = rule[0].column()
        for cond in rule[1:]:
            c = c & cond.column()
        out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def op6(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = materialize(statistics(docs), "quality")
    rules = learn(stats, labels)
    failed = base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
