r"""Benchmark decontamination: a prefix-filtered set join of item-sized windows with whole texts.

An item's windows are its runs of WINDOW words (a shorter item is one window of its own size). A
window is held as the set of its shingles, runs of SHINGLE words (or of the whole window, if that
is shorter), each with its place in the window:

1. One pass over the texts turns every word into a row and keeps the places whose shingle is one of
   a window's, with the words around them. Whatever the number of places, nothing else is carried on.
2. The shingles of a window are ordered by rarity, that is by the number of such places. As a window
   must be contained whole, its necessary prefix is one shingle, the rarest; a window with a shingle
   that stands nowhere is dropped.
3. Prefixes are joined with the places. The shingle's place in the window fixes where the window would
   start, which must not lie before the text's first word (positional bound) and not leave fewer words
   than the window has (length bound).
4. What is left is verified word by word.

Everything is a DataFrame expression. Frequent shingles are dealt to many tasks; the shingles
of the windows are broadcast up to BROADCAST of them and joined by a shuffle beyond.

Defined results: null, empty and wordless texts have no words and hit nothing, and such items have no
windows; items that are equal, or share windows, are all counted; an item_id on several rows is one
item with the windows of all of them, a null item_id counts as an item and is left out of items_sha256;
repeated rows and rows with a null doc_id get a row each; empty tables give no rows, or rows that hit
nothing; extra columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PARTS, keyed, load, materialize, narrow

#: Words of a window, and of the shingles that it is a set of.
WINDOW, SHINGLE = 10, 5
#: Letters, digits, and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct shingles of all windows (12 bytes each) up to which they are broadcast.
BROADCAST = 4_000_000


def words(text: Column) -> Column:
    """Words with A-Z in lower case. lower() does just that, and faster, where all is ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_ids): each distinct window as its words, and the items that it stands in."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("window"))
    # collect_set leaves nulls out
    return each.groupBy("window").agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("item_ids"))


def _hash(at, size: int) -> Column:
    """Of the `size` words from a place on."""
    return F.xxhash64(F.lit(size), *[at(k) for k in range(size)])


def _shingles(w: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: _hash(lambda k: F.get(w, i + k), size))


def occurrences(docs: DataFrame, found: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(__key, doc_id, n_words, start, size, set_id): a row for each of docs (__key, doc_id, text), with
    null places, and one for each place where a window of found (window, set_id) starts."""
    sizes = sorted({min(r[0], shingle) for r in found.select(F.size("window")).distinct().collect()}, reverse=True)
    of_window = F.lit(None).cast("array<long>")
    for s in sizes:  # a window shorter than a shingle is one shingle of its own size
        of_window = F.when(F.least(F.size("window"), F.lit(shingle)) == s, _shingles("window", s)).otherwise(of_window)
    sets = materialize(found.select("window", "set_id", F.posexplode(of_window).alias("place", "h")), "window-shingles")
    n_sets = sets.count()
    keys = sets.select("h").distinct().withColumn("known", F.lit(True))
    if n_sets <= BROADCAST:
        keys = F.broadcast(keys)

    # 1. places of the windows' shingles; the row of each text's first word also stands for the text
    each = docs.select("__key", "doc_id", words(F.col("text")).alias("w")).select("*", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "__w"))
    hits = None
    for s in sizes or [shingle]:
        near = window - shingle if s == shingle else 0
        h = F.when(F.col("pos") + s <= F.col("n_words"), _hash(lambda k: F.get("w", F.col("pos") + k), s))
        is_text = F.coalesce(F.col("pos"), F.lit(0)) == 0 if hits is None else F.lit(False)
        got = each.withColumn("h", h).join(keys, "h", "left").filter(is_text | F.col("known"))
        first = F.greatest(F.col("pos") - near, F.lit(0))
        around = F.when(F.col("known"), F.slice("w", first + 1, F.lit(near + s + near)))
        got = got.select("__key", "doc_id", "n_words", is_text.alias("is_text"), "pos", F.when(F.col("known"), F.col("h")).alias("h"), first.alias("first"), around.alias("around"))
        hits = got if hits is None else hits.unionByName(got)
    hits = materialize(hits, "window-places")

    # 2. the rarest shingle of each window
    count = hits.filter("h is not null").groupBy("h").count()
    rare = sets.join(count, "h", "left").groupBy("set_id", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "h", "place")).alias("p"))
    prefixes = materialize(narrow(rare.filter("p.n > 0").select("p.h", "p.n", "p.place", "window", "set_id"), n_sets, 100_000), "prefixes")

    # 3. and 4.
    met = _dealt(hits.filter("h is not null").drop("is_text"), prefixes)
    start, size = F.col("pos") - F.col("place"), F.size("window")
    met = met.filter((start >= 0) & (start + size <= F.col("n_words")))
    met = met.filter(F.slice("around", start - F.col("first") + 1, size) == F.col("window"))
    texts = hits.filter("is_text").withColumns({c: F.lit(None).cast(t) for c, t in (("start", "int"), ("size", "int"), ("set_id", "string"))})
    rows = ("__key", "doc_id", "n_words", "start", "size", "set_id")
    return texts.select(*rows).unionByName(met.withColumns({"start": start, "size": size}).select(*rows))


def _dealt(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """places joined with prefixes by h, frequent shingles dealt to several tasks.

    At most PARTS shingles have more than a PARTS-th of all places, so that the driver may know them.
    """
    total = places.count()
    most = max(1, -(-total // PARTS))
    hot = {r["h"]: r["n"] for r in prefixes.filter(F.col("n") > most).select("h", "n").distinct().collect()}
    if not hot:
        return places.join(prefixes, "h")
    salts = -(-max(hot.values()) // most)
    is_hot = F.col("h").isin(list(hot))
    left = places.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("__key", "pos"), F.lit(salts)).cast("int")).otherwise(0))
    right = prefixes.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["h", "salt"]).drop("salt")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) of each row of docs (doc_id, text) against items (item_id,
    text): spans are (start, end) in words, end exclusive, in order and apart; item_ids in order."""
    docs, _ = keyed(docs.select("doc_id", "text"))
    # windows of the same items share a set, which is all that a document has to know of them
    found = materialize(windows(items, window).withColumn("set_id", F.sha2(F.to_json("item_ids"), 256)), "windows")
    hits = materialize(occurrences(docs, found.select("window", "set_id"), window, shingle), "window-hits")
    at = hits.filter("start is not null")

    # a text's windows in order; a span begins where one starts after all before it have ended
    order = Window.partitionBy("__key").orderBy("start")
    each = at.groupBy("__key", "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    each = each.groupBy("__key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = each.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    sets = found.groupBy("set_id").agg(F.first("item_ids").alias("item_ids"))
    ids = at.select("__key", "set_id").distinct().join(sets, "set_id").select("__key", F.explode("item_ids").alias("i"))
    ids = ids.groupBy("__key").agg(F.array_sort(F.collect_set("i")).alias("item_ids"))
    out = hits.filter("start is null").join(spans, "__key", "left").join(ids, "__key", "left")
    no_spans, no_ids = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast(f"array<{items.schema['item_id'].dataType.simpleString()}>")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce(F.transform("item_ids", lambda x: x["item_id"]), no_ids).alias("item_ids"))


def op13(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform(F.filter("item_ids", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = scan(docs, items).select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
