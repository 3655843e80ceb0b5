"""Operator 9 [native]: benchmark passages in documents, by a prefix-filtered set join in DataFrame operations only.

Each item gives windows of `window` consecutive words (a shorter item is one window). The shingles of a window, k
words each (all words of a shorter window), are ordered by rarity: how often they occur in all documents. A document
holds a window only if it holds all its shingles, so one prefix token, the rarest, is enough to find it. A match at
place p of a document with offset o in the window is kept if the window's `len` words fit around it,
0 <= p - o and p - o + len <= n_words, and then the words themselves are compared.

One scan of the documents looks every k-word place up among the shingles of all items and keeps the places that hit,
with the words around them: from it come the corpus counts that order the shingles, and the join. Words are compared
with full lower-casing first, word by word on both sides (a capital sigma is lowered by what stands around it), so that
equal words stay equal, and exactly, with A-Z lowered only, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, cut, drop, text_keys

WINDOW = 10
SHINGLE = 4
#: Distinct item shingles that may be broadcast (12 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Everything that parts words, before A-Z are lowered.
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PARTS), "")


def _key(ws: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(ws, at + i) for i in range(n)))


def windows(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """Distinct windows: w (exact words), len, item ids, and for each shingle its length, key and offset."""
    ws = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("raw")).where("size(raw) > 0")
    ws = ws.select("item_id", F.transform("raw", lambda x: F.translate(x, UPPER, LOWER)).alias("ws"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - window)))
    each = ws.withColumn("start", start).select("item_id", F.slice("ws", F.col("start") + 1, window).alias("w"))
    return each.groupBy("w").agg(F.collect_set("item_id").alias("items")).select("w", F.size("w").alias("len"), F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(5), "w").alias("w2"), "items")


def _shingles(wins: DataFrame, k: int) -> DataFrame:
    low = F.transform("w", lambda x: F.lower(x))
    m = F.least(F.lit(k), F.col("len"))
    base = wins.withColumn("low", low).withColumn("m", m).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("len") - m)))
    key = reduce(lambda got, n: F.when(F.col("m") == n, _key(F.col("low"), F.col("o"), n)).otherwise(got), range(k - 1, 0, -1), _key(F.col("low"), F.col("o"), k))
    return base.select("w1", "w2", "w", "len", "m", "o", key.alias("key"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences (k1, k2, start, len, w1, w2) of windows in the texts with those keys, distinct; and the windows."""
    spark = docs.sparkSession
    wins, _ = cut(windows(items, item_id, item_text, window, k), "windows")
    shingle, shingle_path = cut(_shingles(wins, k), "item_shingles")
    keys = shingle.select("key").distinct()
    small = bounded(keys, BROADCAST_ROWS)
    lengths = sorted(r[0] for r in shingle.select("m").distinct().collect())  # at most k numbers
    t = F.coalesce(F.col(text), F.lit(""))
    ws = docs.select(*text_keys(text), words(t).alias("raw"), F.transform(words(t), lambda x: F.lower(x)).alias("low"))
    places = ws.select("*", F.posexplode_outer("low").alias("p", "x"))  # not posexplode: the filter inferred for it would split each text again
    size = F.size("raw")
    if len(lengths) == 1:
        places = places.withColumn("key", F.when(F.col("p") + lengths[0] <= size, _key(F.col("low"), F.col("p"), lengths[0])))
    else:
        each = F.array(*(F.when(F.col("p") + n <= size, _key(F.col("low"), F.col("p"), n)) for n in lengths)) if lengths else F.array(F.lit(None).cast("long"))
        places = places.withColumn("key", F.explode(each))
    around = F.greatest(F.lit(0), F.col("p") - window)
    parts = ["k1", "k2", "key", "p", size.alias("n_words"), around.alias("from"), F.slice("raw", around + 1, 2 * window + k).alias("near")]
    # whole word lists never leave the stage that made them
    found = places.join(F.broadcast(keys), "key").select(*parts) if small else places.select(*parts).join(keys, "key")
    found, found_path = cut(found, "places")
    often = found.groupBy("key").agg(F.count("*").alias("times"))
    # the rarest shingle of each window is its prefix; one that no document holds has count 0 and matches nothing
    rank = shingle.join(often, "key", "left").groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key", "o")).alias("r"), F.first("w").alias("w"), F.first("len").alias("len"))
    prefix = rank.where("r.times > 0").select("w1", "w2", "w", "len", F.col("r.key").alias("key"), F.col("r.o").alias("o"))
    prefix, prefix_path = cut(prefix, "prefix")
    begin = F.col("p") - F.col("o")
    met = found.join(F.broadcast(prefix) if bounded(prefix, BROADCAST_ROWS // 10) else prefix, "key").where((begin >= 0) & (begin + F.col("len") <= F.col("n_words")))
    # the words around a hit reach `window` to either side
    there = F.transform(F.slice("near", begin - F.col("from") + 1, F.col("len")), lambda x: F.translate(x, UPPER, LOWER))
    met = met.where(there == F.col("w")).select("k1", "k2", begin.alias("start"), "len", "w1", "w2").distinct()
    met, _ = cut(met, "hits")
    drop(spark, shingle_path, found_path, prefix_path)
    return met, wins


def per_text(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """k1, k2, n_hit, n_items, names (sorted ids, comma-joined) of each distinct text with a hit."""
    met, wins = hits(docs, items, window, k, item_id, text, item_text)
    # words under the union of [start, start + len) of one text
    order = Window.partitionBy("k1", "k2").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = met.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    covered = spans.withColumn("upto", F.coalesce(F.max("end").over(order), F.lit(0))).groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).alias("n_hit"))
    named = met.select("k1", "k2", "w1", "w2").distinct().join(wins.select("w1", "w2", F.explode("items").alias("item")), ["w1", "w2"]).select("k1", "k2", "item").distinct()
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = covered.join(named, ["k1", "k2"], "left")
    per, _ = cut(per.select("k1", "k2", "n_hit", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.array_join("items", ",").alias("names")), "per_text")
    return per


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs without any hit word, with all their columns as they are."""
    found = per_text(docs, items, window, k, item_id, text, item_text).select("k1", "k2")
    found = F.broadcast(found) if bounded(found, BROADCAST_ROWS) else found
    marked = docs.select(F.struct(F.lit(True).alias("given"), *(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_keys(text))
    return marked.join(found, ["k1", "k2"], "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A word is hit if it lies in any occurrence of an item's window. Null and empty texts have no words and no hits;
    null, empty and wordless items have no windows; null item ids are not named. Repeated items name their id once,
    repeated documents give repeated rows. Empty tables give no rows, or rows without hits. Other columns of either
    table are not looked at.
    """
    per = per_text(docs, items, window, k, item_id, text, item_text)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_keys(text), F.size(words(t)).cast("long").alias("n_words"))
    if bounded(per, BROADCAST_ROWS // 10):
        per = F.broadcast(per)
    out = rows.join(per, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.when(F.col("n_items") > 0, F.col("n_items")), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
