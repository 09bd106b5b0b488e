"""Duplicate titles: exact groups, near pairs in neighbouring prefix blocks by deletions and pieces, field overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_title, round2
from ..plans.shared import written


def exact(nodes: DataFrame) -> DataFrame:
    """(norm, n, id): the members of each normalised title that two or more nodes have."""
    norm = nodes.select("id", normal_title(F.col("title")).alias("norm"))
    shared = norm.groupBy("norm").agg(F.count("*").alias("n")).filter("n > 1")
    return norm.join(shared, "norm").select("norm", "n", "id")


#: Edits up to which titles meet by what is left after deletions, and the longest titles that do;
#: others meet by pieces.
DELETIONS, SHORT_TITLE = 2, 24


def near(nodes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of titles that no other node has, from the same 3-letter block or the
    next existing one, with threshold <= similarity < 1.

    Pairs of a block, or of a block and the next, are found without a look at all of them. What all their
    titles begin with is left out first, as it changes no distance. Titles that may differ in k edits
    meet if they are equal after k deletions or fewer from each (up to DELETIONS), or if one of k + 1
    pieces of the shorter stands in the longer, no further from its place than the edits allow. The
    distance is worked out for those only. Frequent pieces make large join partitions, which Spark splits.
    """
    close = _edits(threshold)
    pairs = _candidates(_members(nodes), threshold)
    longest = F.greatest(F.length("na"), F.length("nb"))
    far = F.levenshtein("ta", "tb")
    pairs = pairs.withColumn("far", far).filter((F.col("far") > 0) & (F.col("far") <= close(longest)))
    pairs = pairs.withColumn("sim", 1 - F.col("far") / longest).filter(F.col("sim") >= threshold)
    return pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), round2(F.col("sim")).alias("similarity"))


def _edits(threshold: float):
    """Edits that titles of such a similarity differ in at most, by the length of the longer."""
    return lambda length: F.floor((1 - threshold) * length + 1e-9).cast("int")


def _members(nodes: DataFrame) -> DataFrame:
    """(group, side, id, norm, tail): each title in the group of its block, and in those of its block
    and the next (side 0) and the one before (side 1); tail is what differs inside the group."""
    norm = nodes.select("id", normal_title(F.col("title")).alias("norm"))
    single = norm.groupBy("norm").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("id", "norm").withColumn("block", F.substring("norm", 1, 3))
    # the table of blocks is small (3 letters), so one window over it is fine
    order = Window.orderBy("block")
    blocks = single.groupBy("block").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    blocks = blocks.select("block", "low", "high", F.dense_rank().over(order).alias("ord"), F.lead("high").over(order).alias("next_high"), F.lag("low").over(order).alias("before_low"))
    # titles between two that begin alike begin so too
    groups = F.array(
        F.struct(F.concat(F.lit("="), F.col("ord").cast("string")).alias("group"), F.lit(-1).alias("side"), _common("low", "high").alias("skip")),
        F.when(F.col("next_high").isNotNull(), F.struct(F.concat(F.lit(">"), F.col("ord").cast("string")).alias("group"), F.lit(0).alias("side"), _common("low", "next_high").alias("skip"))),
        F.when(F.col("before_low").isNotNull(), F.struct(F.concat(F.lit(">"), (F.col("ord") - 1).cast("string")).alias("group"), F.lit(1).alias("side"), _common("before_low", "high").alias("skip"))),
    )
    blocks = blocks.select("block", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g")).select("block", "g.*")
    return single.join(blocks, "block").select("group", "side", "id", "norm", F.expr("substring(norm, skip + 1)").alias("tail"))


def _common(a: str, b: str) -> Column:
    """Characters that two texts begin with alike."""
    n = f"least(length({a}), length({b}))"
    return F.expr(f"if({n} = 0, 0, coalesce(array_min(filter(sequence(1, greatest({n}, 1)), i -> substring({a}, i, 1) != substring({b}, i, 1))) - 1, {n}))")


def _candidates(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (ia, na, ta, ib, nb, tb) that may be near, each once; b is the longer title."""
    t, n = repr(threshold), "length(norm)"
    edits = lambda length: f"cast(floor((1 - {t}) * ({length}) + 1e-9) as int)"
    longest = f"cast(floor({n} / {max(threshold, 0.05)!r} + 1e-9) as int)"
    short = lambda length: f"({length} <= {SHORT_TITLE} and {edits(length)} <= {DELETIONS})"
    # as the longer title of a pair, and as the shorter one of pairs with lengths up to `longest`
    as_long = f"if({short(n)}, {_deleted('tail', edits(n))}, array())"
    most = f"array_max(transform(filter(sequence({n}, greatest({longest}, {n})), x -> {short('x')}), x -> {edits('x')}))"
    as_short = f"if({short(n)}, {_deleted('tail', f'coalesce({most}, 0)')}, array())"

    # pieces: (length of the shorter tail, edits, number, text)
    def piece(m: str, k: str, i: str) -> tuple[str, str]:
        size, left = f"cast(floor({m} / ({k} + 1)) as int)", f"({k} + 1 - {m} % ({k} + 1))"
        return f"({i} * {size} + greatest(0, {i} - {left}))", f"({size} + if({i} >= {left}, 1, 0))"

    start, size = piece("m", "k", "i")
    own = f"""flatten(transform(array_distinct(transform(filter(sequence({n}, greatest({longest}, {n})), x -> not {short('x')}), x -> {edits('x')})), k ->
        transform(sequence(0, k), i -> concat_ws('|', m, k, i, substring(tail, {start} + 1, {size})))))"""
    own = f"get(transform(array(length(tail)), m -> {own}), 0)"
    at = f"greatest(0, {start} - i, {start} + (long - m) - (k - i))"
    end = f"least(long - {size}, {start} + i, {start} + (long - m) + (k - i))"
    places = f"if({end} < {at}, array(), transform(sequence({at}, greatest({end}, {at})), p -> concat_ws('|', m, k, i, substring(tail, p + 1, {size}))))"
    others = f"flatten(transform(sequence(greatest(0, long - k), long), m -> flatten(transform(sequence(0, k), i -> {places}))))"
    others = f"if({short(n)}, array(), get(transform(array({edits(n)}), k -> get(transform(array(length(tail)), long -> array_distinct({others})), 0)), 0))"

    keys = lambda deleted, pieces: f"concat(transform({deleted}, x -> xxhash64('d', x)), transform({pieces}, x -> xxhash64('p', x)))"
    a = members.select("group", F.col("side").alias("sa"), F.col("id").alias("ia"), F.col("norm").alias("na"), F.col("tail").alias("ta"), F.explode(F.array_distinct(F.expr(keys(as_short, own)))).alias("key"))
    b = members.select("group", F.col("side").alias("sb"), F.col("id").alias("ib"), F.col("norm").alias("nb"), F.col("tail").alias("tb"), F.explode(F.array_distinct(F.expr(keys(as_long, others)))).alias("key"))
    shorter = (F.length("na") < F.length("nb")) | ((F.length("na") == F.length("nb")) & (F.col("ia") < F.col("ib")))
    apart = F.length("nb") - F.length("na") <= _edits(threshold)(F.length("nb"))
    # inside a block the two are told apart by their ids, across two blocks by their sides
    met = a.join(b, ["group", "key"]).filter(shorter & apart & ((F.col("sa") < 0) | (F.col("sa") != F.col("sb"))))
    return met.select("ia", "na", "ta", "ib", "nb", "tb").distinct()


def _deleted(text: str, most: str) -> str:
    """SQL of a text with up to `most` (of DELETIONS) characters left out, in all ways."""
    n = f"length({text})"
    cut = lambda t, i: f"concat(substring({t}, 1, {i} - 1), substring({t}, {i} + 1))"
    one = f"if({most} >= 1 and {n} >= 1, transform(sequence(1, greatest({n}, 1)), i -> {cut(text, 'i')}), array())"
    two = f"if({most} >= 2 and {n} >= 2, flatten(transform(sequence(2, greatest({n}, 2)), j -> transform(sequence(1, j - 1), i -> {cut(cut(text, 'j'), 'i')}))), array())"
    return f"array_distinct(concat(array({text}), {one}, {two}))"


def groups(nodes: DataFrame, threshold: float = 0.8, limit: int = 50) -> tuple[DataFrame, int]:
    """The most similar groups (similarity, ids, reason), exact ones first, and how many there are.

    Exact groups come in order of their smallest ids, so that the ids are gathered of the groups that
    are returned only.
    """
    same = exact(nodes)
    sizes = same.groupBy("norm").agg(F.min("id").alias("first"))
    alike = near(nodes, threshold).select("similarity", F.array("a", "b").alias("ids"), F.lit("similar title").alias("reason"))
    alike = written(alike, "near-titles")
    best = written(sizes.orderBy("first").limit(limit), "exact-titles")
    ids = same.join(best.select("norm"), "norm", "left_semi").groupBy("norm").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ids = ids.select(F.lit(1.0).alias("similarity"), "ids", F.lit("identical normalized title").alias("reason"))
    return ids.unionByName(alike).orderBy(F.desc("similarity"), "ids").limit(limit), sizes.count() + alike.count()


def field_overlap(pairs: DataFrame, fields: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with 0.7 * similarity + 0.3 * share of equal fields, those under threshold dropped."""
    f = fields.select("node_id", "key", "value_text")
    a = pairs.select("a", "b").join(f.withColumnRenamed("node_id", "a"), "a").withColumnRenamed("value_text", "va")
    b = pairs.select("a", "b").join(f.withColumnRenamed("node_id", "b"), "b").withColumnRenamed("value_text", "vb")
    share = a.join(b, ["a", "b", "key"], "full").groupBy("a", "b").agg(F.avg(F.when(F.col("va") == F.col("vb"), 1.0).otherwise(0.0)).alias("overlap"))
    out = pairs.join(share, ["a", "b"], "left")
    return out.select("a", "b", round2(0.7 * F.col("similarity") + 0.3 * F.coalesce("overlap", F.lit(0.0))).alias("score")).filter(F.col("score") >= threshold)
