"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only (operator 10).

Rows: one per document row, judged by its own text, so rows that repeat an id, or have none, are
judged one by one. Null and word-free texts have no words and no hits; null and word-free items have
no windows; items without an id are left out, and items that repeat an id count as one. Very long
texts are read whole, and what is kept of them is bounded by the windows that they may hold. An empty
table of documents gives an empty result, an empty benchmark gives no hits. Extra columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: What lies between words: ASCII other than digits and letters.
BETWEEN = "".join(chr(i) for i in range(128) if chr(i) not in digits + ascii_lowercase + ascii_uppercase)
#: Words of a shingle, the token of the prefix join; shorter windows are one shingle.
SHINGLE = 3
#: Bytes up to which a side is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null. One translation folds A-Z and blanks what lies between."""
    blanked = F.translate(text, ascii_uppercase + BETWEEN, ascii_lowercase + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(blanked, " "), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, row_bytes: Column | int = 48) -> DataFrame:
    """df with a broadcast hint if its measured size is within the bound."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(window, item): each item's runs of `size` consecutive words; a shorter item is one window."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("i"))
    return starts.select(F.slice("words", F.col("i"), F.lit(size)).alias("window"), "item").distinct()


def _token(words: str, at: Column, k: int) -> Column:
    """64-bit hash of k words from place `at` on. It only chooses candidates, the words decide."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated, items, hits) of each document;
    hits are the maximal runs (start, size) of words that lie in windows.

    A window's shingles are ordered by their number in all documents; whatever holds the window
    holds its rarest one, so that one alone is joined (the prefix of an exact containment). The
    place of the shingle gives the only place where the window can lie; bounds on it and the
    length drop what cannot fit, and the words of what is left are compared in full. Every text is
    split once for its shingles, and those that have a candidate once more for the comparison.
    """
    named = settle(benchmark_windows(benchmark, item_col, item_text_col, size))
    windows = settle(named.select("window").distinct().withColumn("win", F.monotonically_increasing_id()).withColumn("size", F.size("window")))
    items = named.join(windows, "window").select("win", "item")
    lengths = [row[0] for row in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    tokens = None
    for k in lengths:
        part = windows.where(F.least("size", F.lit(SHINGLE)) == k).select("win", "size", "window", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("offset"))
        part = part.select("win", "size", F.lit(k).alias("k"), "offset", _token("window", F.col("offset"), k).alias("token"))
        tokens = part if tokens is None else tokens.union(part)

    # The place -1 stands for the document itself, so that one pass gives both its facts and its shingles.
    texts = documents.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own")).alias("doc"), words_of(F.col(text_col)).alias("words"))
    places = texts.select("doc", "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    mark = lambda k, token: F.struct(F.lit(k).alias("k"), token.alias("token"))
    marks = F.when(F.col("at") < 0, F.array(mark(0, F.col("doc.own")))).otherwise(F.array(*[mark(k, _token("words", F.col("at"), k)) for k in lengths]) if lengths else F.array().cast("array<struct<k:int,token:bigint>>"))
    found = places.select("doc", "n_words", "at", F.explode(marks).alias("m")).select("doc", "n_words", "at", "m.k", "m.token").where("at + k <= n_words")
    if tokens is None:
        seen = settle(found)
        tokens = windows.select("win", "size", F.lit(0).alias("k"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("token"))
    else:
        tokens = settle(tokens)
        known = tokens.select("k", "token").distinct().withColumn("known", F.lit(True))
        seen = settle(found.join(_small(known), ["k", "token"], "left").where("k = 0 or known").select("doc", "n_words", "at", "k", "token"))
    occurring = seen.where("k > 0")
    rarity = occurring.groupBy("token", "k").agg(F.count("*").alias("df"))
    # A window one of whose shingles occurs nowhere occurs nowhere itself.
    prefix = tokens.join(rarity, ["token", "k"], "left").groupBy("win", "size", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("rarest")).where("rarest.df > 0")
    prefix = settle(prefix.select("win", "size", "k", "rarest.token", "rarest.offset"))
    candidates = occurring.join(_small(prefix), ["token", "k"]).withColumn("start", F.col("at") - F.col("offset")).where("start >= 0 and start + size <= n_words")
    candidates = settle(candidates.select("doc", "start", "size", "win").distinct())
    # Texts that have candidates are shuffled as they are, and split once they have arrived.
    wanted = _small(candidates.select("doc").distinct())
    held = documents.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own")).alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc", "left_semi")
    held = held.groupBy("doc").agg(F.first("text").alias("text")).select("doc", words_of(F.col("text")).alias("words"))
    tried = candidates.join(_small(windows.select("win", "window"), F.octet_length(F.concat_ws(" ", "window")) + 64), "win")
    hits = settle(held.join(tried, "doc").where(F.slice("words", F.col("start") + 1, F.col("size")) == F.col("window")).select("doc", "start", "size", "win"))
    before = Window.partitionBy("doc").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.select("doc", "start", "size").distinct().withColumn("fresh", F.coalesce(F.col("start") > F.max(F.col("start") + F.col("size")).over(before), F.lit(True)).cast("long"))
    runs = fresh.withColumn("run", F.sum("fresh").over(Window.partitionBy("doc").orderBy("start", "size"))).groupBy("doc", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    runs = runs.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("size")))).alias("hits"))
    by_item = hits.select("doc", "win").distinct().join(items, "win").select("doc", "item").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = seen.where("k = 0").select("doc", "n_words").join(runs.join(by_item, "doc"), "doc", "left")
    none = F.array().cast("array<string>")
    named_items, n_hit = F.coalesce("items", none), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc.id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(named_items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named_items).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), named_items.alias("items"), F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"),
    )
