"""Benchmark decontamination in DataFrame operations only: items are partitioned by size, each partition keeps a
bottom-k MinHash sketch just long enough that a document holding the required share of an item must hold a
sketch value, and every nomination is verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of sketches and items, by a generous estimate, up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of the lower-cased (A-Z) text, split at ASCII white space; null and blank texts have none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: inside a lambda, an inlined expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The value as a generated column, which no later filter is pushed through or copied into."""
    return F.explode_outer(F.array(value))


def shingle_strings(words: Column, width: int) -> Column:
    """Distinct word shingles; a shorter sequence is one shingle, an empty one gives an empty string."""
    return let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, width), " "))))


def shingle_hashes(words: Column, width: int) -> Column:
    """Distinct hashes of the same shingles; places past the end are null, which hashing leaves out."""
    return let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))))


def flat_of(words: Column) -> Column:
    """The words with one space before, between and behind them."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def item_sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(item, item_id, n, shingles, hashes, sketch): a row per item with its k smallest shingle hashes; `item` names id and text.

    Size partition p holds items of 2^p to 2^(p+1) - 1 shingles and shares one k, that of its largest size: a
    document may miss n - ceil(threshold * n) shingles of an item, so one more sketch value than that cannot all
    be missing. k never exceeds the item's own shingles.
    """
    named = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    words = named.select("item", "item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    base = words.select("item", "item_id", shingle_strings(F.col("words"), width).alias("shingles"), shingle_hashes(F.col("words"), width).alias("hashes"))
    sized = base.withColumn("n", F.size("shingles")).where("n > 0")
    sized = sized.withColumn("part", F.floor(F.log2("n")).cast("int"))
    top = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    sized = sized.withColumn("k", F.least("n", (F.floor(top - F.ceil(top * threshold - 1e-9)) + 2).cast("int")))
    return sized.withColumn("sketch", F.slice(F.sort_array("hashes"), 1, F.col("k"))).select("item", "item_id", "n", "shingles", "hashes", "sketch")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document holding `threshold` of an item's shingles.

    Shingles are `width` consecutive words of the lower-cased whole text, each counted once; a text of fewer
    words is one shingle. Null or blank documents and items match nothing. Equal item texts under several ids
    each get their rows. A repeated document row repeats its rows, a repeated item row does not. Other columns
    are not read.

    Only (hash, item) rows are sketch rows; an item's arrays stand in one row. If all of it fits BROADCAST_BYTES,
    documents are probed and verified where they lie; otherwise only (hash, document) rows meet the sketch, and
    the texts of nominated documents alone are verified. Both ways nominate and verify alike.
    """
    table = item_sketches(items, width, threshold)
    size = F.size("sketch") * 64 + F.size("hashes") * 80 + F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s)) + 200
    small = (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    least = F.ceil(F.col("n") * threshold - 1e-9)
    # Of its sketch values a document may miss as many as it may miss shingles.
    rows = table.select(F.explode("sketch").alias("hash"), "item", (F.size("sketch") - F.col("n") + least).alias("need"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if small:
        hashed = base.select("doc_id", words_of(F.col("text")).alias("words"))
        hashed = hashed.select("doc_id", flat_of(F.col("words")).alias("flat"), shingle_hashes(F.col("words"), width).alias("hashes"))
        probed = hashed.select("doc_id", "flat", F.col("hashes").alias("own"), F.explode_outer("hashes").alias("hash"))
        met = probed.join(F.broadcast(rows), "hash").join(F.broadcast(table), "item")
        # A document meets an item through several sketch values; only the smallest one it holds goes on.
        first = F.expr("element_at(filter(sketch, s -> array_contains(own, s)), 1) = hash")
        # Filters on generated columns stay where they stand, so each count is made once.
        near = once(F.when(first, F.size(F.array_intersect("hashes", "own"))))
        nominated = met.select("doc_id", "item_id", "flat", "shingles", "n", near.alias("near")).where(F.col("near") >= least)
    else:
        named = base.withColumn("doc", F.xxhash64("doc_id", "text"))
        words = named.select("doc", words_of(F.col("text")).alias("words"))
        probed = words.select("doc", F.explode(shingle_hashes(F.col("words"), width)).alias("hash"))
        # Equal document rows make equal pairs, which count together; of each pair one goes on.
        met = probed.join(rows.hint("merge"), "hash").groupBy("doc", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
        pairs = met.where("hits >= need").select("doc", "item")
        found = named.join(pairs.hint("merge"), "doc").select("doc_id", "item", flat_of(words_of(F.col("text"))).alias("flat"))
        nominated = found.join(table.select("item", "item_id", "shingles", "n").hint("merge"), "item")
    padded = lambda s: F.concat(F.lit(" "), s, F.lit(" "))
    held = F.filter("shingles", lambda s: F.when(F.size(F.split(s, " ")) < width, F.col("flat") == padded(s)).otherwise(F.instr(F.col("flat"), padded(s)) > 0))
    checked = nominated.select("doc_id", "item_id", "n", once(F.size(held)).alias("n_shared")).where(F.col("n_shared") >= least)
    return checked.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n")).alias("containment"))
