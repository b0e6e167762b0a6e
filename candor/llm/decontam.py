"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in DataFrame functions only.

Test texts become windows of `size` words (a shorter text is one window). Each window is filed under the hash of its
longest two neighbouring words (of its only word, if it has one), so the broadcast relation is a hash table from such
pairs to whole windows; few windows share one, even where a word is common. Documents are scanned once: every pair of
neighbouring words probes the table, and only where it is found the window around it is compared with the test window,
word by word. Only hits leave the scan. A test set of more than `block` windows, or of more than BLOCK_BYTES, is
broadcast in several blocks, each with a scan of its own, so no broadcast exceeds those bounds (one longer window
excepted). Single words probe in a scan of their own, if any test text is a single word.

Defined results: null and blank texts have no words and no hits, in documents and in tests; a document repeated under
one doc_id gets the hits of all rows of that id, and decontaminate() keeps or drops these together; rows without a doc_id are never hit; empty tables give no hits; extra
columns of documents are kept by decontaminate() and ignored by contamination().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.shared import unused, without

#: ASCII without digits and lower-case letters separates words; everything beyond ASCII belongs to them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Windows in one broadcast, some 300 bytes each in memory, and bytes of their words.
BLOCK, BLOCK_BYTES = 200_000, 32 << 20


def split_words(text: Column) -> Column:
    """Lower-cased words in order; the first and the last may be an empty string, where the text starts or ends with a separator."""
    # lower() is quick and means the same when all is ASCII
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower())), SEPARATORS)


def count_words(words: Column) -> Column:
    empty = lambda at, least: F.when((F.size(words) > least) & (F.element_at(words, at) == ""), 1).otherwise(0)
    return F.coalesce(F.size(words) - empty(1, 0) - empty(-1, 1), F.lit(0)).cast("long")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, gram, anchor, ahead): each window, the hash of its longest two neighbouring words, and how many words
    stand before them."""
    words = benchmark.select("item_id", F.filter(split_words(F.col("text")), lambda w: w != "").alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("gram")).distinct()
    following = lambda i: F.get("gram", i + 1)
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct((F.length(w) * following(i).isNotNull().cast("int") + F.coalesce(F.length(following(i)), F.lit(0))).alias("size"), (-i).alias("place"))))
    placed = grams.select("item_id", "gram", (-longest["place"]).alias("ahead"))
    return placed.select("item_id", "gram", "ahead", pair_hash(F.get("gram", F.col("ahead")), F.get("gram", F.col("ahead") + 1)).alias("anchor"))


def pair_hash(word: Column, following: Column) -> Column:
    """Of a word and the one behind it; a null isn't hashed, so a single word has the hash of itself alone."""
    return F.xxhash64(word, following)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, len, item_id): the occurrences of test windows; start counts from split_words()' first element."""
    grams = item_windows(benchmark, size)
    size_of = F.aggregate("gram", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w))
    found = grams.groupBy((F.size("gram") == 1).alias("single")).agg(F.count(F.lit(1)).alias("n"), F.sum(size_of).alias("bytes")).collect()  # two rows
    words = docs.where("doc_id is not null").select("doc_id", split_words(F.col("text")).alias("words"))
    scanned = words.select("doc_id", "words", F.posexplode("words").alias("pos", "word"))

    def probe(some: DataFrame, single: bool) -> DataFrame:
        around = F.when(F.col("pos") >= F.col("ahead"), F.slice("words", F.col("pos") - F.col("ahead") + 1, F.size("gram")) == F.col("gram"))
        key = pair_hash(F.col("word"), F.lit(None).cast("string") if single else F.get("words", F.col("pos") + 1))
        found = scanned.join(F.broadcast(some), (key == F.col("anchor")) & around)
        return found.select("doc_id", (F.col("pos") - F.col("ahead")).alias("start"), F.size("gram").alias("len"), "item_id")

    parts = []
    for r in found:
        kind, count = grams.where((F.size("gram") == 1) == r["single"]), max(1, -(-r["n"] // block), -(-r["bytes"] // BLOCK_BYTES))
        parts += [probe(kind if count == 1 else kind.where(F.pmod(F.xxhash64("gram"), F.lit(count)) == k), r["single"]) for k in range(count)]
    return reduce(DataFrame.unionByName, parts) if parts else probe(grams, False)


def hit_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """(doc_id, places, items) of documents with hits: the word places hit, and the items."""
    found = hits(docs, benchmark, size, block).groupBy("doc_id").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("item_id").alias("items"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    return found.select("doc_id", places.alias("places"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    counted = docs.select("doc_id", split_words(F.col("text")).alias("words")).select("doc_id", count_words(F.col("words")).alias("n_words"))
    digest = hit_documents(docs, benchmark, size, block).select("doc_id", F.size("places").alias("n_hit"), F.size("items").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("named"))
    return counted.join(digest, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("named", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", block: int = BLOCK) -> DataFrame:
    """docs without contaminated documents; or, with remove="spans", with the words hit cut from their texts (the
    other words of such a text are then joined by spaces, in their own case and without what stood between them)."""
    if remove == "documents":
        return without(docs, hits(docs, benchmark, size, block).select(F.col("doc_id").alias("gone_id")).distinct())
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove}")
    raw = F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    hit, places = unused(docs, "hit_id"), unused(docs, "places")
    found = hit_documents(docs, benchmark, size, block).select(F.col("doc_id").alias(hit), F.col("places").alias(places))
    kept = F.filter(raw, lambda w, i: (w != "") & ~F.array_contains(places, i))
    joined = docs.join(found, docs["doc_id"] == found[hit], "left")
    return joined.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).drop(hit, places)


ORACLE_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
