"""Benchmark decontamination by winnowing, in DataFrame functions only.

Documents and items are sequences of words. Each keeps, for every window of consecutive k-grams, the
smallest k-gram hash (the first of equals) with its position. A window of ``span`` words holds
``span - k + 1`` k-grams; with that as the winnowing window, two texts that share ``span`` words
keep the same k-gram of them at the same place, so the join of fingerprints misses no shared
span. Each match gives an alignment (document, item, offset), which is then extended: the item is laid
over the document and runs of at least ``span`` equal words are what is shared.

Items shorter than a span are one window of all their words and are found by that one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm.native import let, lower_az, row_key, small
from ketframe.session import saved



def _word(parts: list[range]) -> str:
    """Runs of characters outside the ASCII ranges; each one named, as Java's engine tests a list of characters by one look-up but ranges in turn."""
    return "[^" + "".join(f"\\x{c:02X}" for r in parts for c in r) + "]+"


#: Words: runs of a-z, 0-9 and all characters beyond ASCII (fixed ranges of what parts them); the same before A-Z are lowered.
WORD = _word([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])
_WORD_ANY_CASE = _word([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])
#: Low bits of a fingerprint that hold its position; a text has fewer words than that.
_PLACE = 28
#: Bytes of a fingerprint's or short item's row.
_ROW = 48


def hashes(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _grams(h: Column, n: int, make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: make(F.xxhash64(*[F.get(h, i + j) for j in range(n)]), i))


def _placed_grams(n: int):
    return lambda h: F.when(F.size(h) >= n, _grams(h, n, lambda x, i: F.struct(x.alias("hash"), i.alias("offset"))))


def fingerprints(text: Column, span: int, k: int) -> Column:
    """Winnowed k-gram hashes of a text: the hash's high bits over the position; null if it has under ``span`` words."""
    window = span - k + 1
    packed = lambda x, i: F.shiftleft(F.shiftright(x, _PLACE), _PLACE).bitwiseOR(i.cast("long"))
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda i: F.array_min(F.slice(g, i, window))))
    return let(hashes(text), lambda h: F.when(F.size(h) >= span, let(_grams(h, k, packed), least)))


def _opened(df: DataFrame, prints: Column) -> DataFrame:
    place = F.col("print").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    return df.withColumn("print", F.explode(prints)).withColumn("place", place).withColumn("hash", F.shiftright("print", _PLACE)).drop("print", "text")


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``.

    With ``keep`` those columns stand beside them, else ``doc_id``. A null text has no words; a
    text without shared windows has n_hit 0, no items and the hash of an empty string. Rows that
    share an id and text are looked at once. Items without words take no part; items that share an
    id count once. Empty tables give empty or clean results.
    """
    body = F.col(text).cast("string").alias("text")
    source = docs.select(*row_key(doc_id, text), body)
    bench = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    bench = bench.filter("item is not null and text is not null").withColumn("item_key", F.xxhash64("item", "text"))
    words = saved(bench.select("item", "item_key", hashes(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).dropDuplicates(["item_key"]), "items")

    long = saved(_opened(bench.select("item_key", "text"), fingerprints(F.col("text"), span, k)).distinct(), "item_prints")
    found = _opened(source, fingerprints(F.col("text"), span, k)).join(small(long.toDF("item_key", "item_place", "hash"), _ROW), "hash")
    found = found.select("key_id", "key_text", "item_key", (F.col("place") - F.col("item_place")).alias("offset"))
    for n in [r["n"] for r in words.select(F.size("item_words").alias("n")).filter(f"n < {span}").distinct().collect()]:  # under `span` of them
        short = saved(words.filter(F.size("item_words") == n).select("item_key", F.xxhash64(*[F.get("item_words", F.lit(j)) for j in range(n)]).alias("hash")), "short_items")
        grams = let(hashes(F.col("text")), _placed_grams(n))
        each = source.select("key_id", "key_text", F.inline(grams)).join(small(short, _ROW), "hash")
        found = found.union(each.select("key_id", "key_text", "item_key", "offset"))
    found = saved(found.distinct(), "aligned")

    # lay each item over its document and keep the runs of equal words
    # an item's words come once to a document, however many alignments there are
    per_item = found.groupBy("key_id", "key_text", "item_key").agg(F.collect_list("offset").alias("offsets"))
    laid = per_item.join(small(words, 64 + 8 * F.size("item_words")), "item_key").groupBy("key_id", "key_text").agg(F.collect_list(F.struct("item", "offsets", "item_words")).alias("laid"))

    def runs(h: Column) -> Column:
        def at(item_words: Column, offset: Column) -> Column:
            size = F.size(item_words)
            need = F.least(F.lit(span), size)
            same = lambda j: F.coalesce(F.get(h, offset + j) == F.get(item_words, j), F.lit(False))
            equal = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.when(same(j), "1").otherwise("0")), "")
            begins = lambda e: F.filter(F.sequence(F.lit(0), size - need), lambda j: F.substring(e, j + 1, need) == F.repeat(F.lit("1"), need))
            places = lambda begin: F.flatten(F.transform(begin, lambda j: F.sequence(offset + j, offset + j + need - 1)))
            return let(equal, lambda e: F.array_distinct(places(begins(e))))

        def one(c: Column) -> Column:
            return F.struct(c["item"].alias("item"), F.array_distinct(F.flatten(F.transform(c["offsets"], lambda o: at(c["item_words"], o)))).alias("places"))

        return F.filter(F.transform(F.col("laid"), one), lambda r: F.size(r["places"]) > 0)

    keys = ["key_id", "key_text"]
    columns = keep if keep is not None else [doc_id]
    joined = docs.select(*row_key(doc_id, text), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)], body).join(laid, keys, "left")
    hits = F.when(F.col("laid").isNotNull(), let(hashes(F.col("text")), runs))
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long")
    out = joined.select(*[c for c in joined.columns if c.startswith("kept_")], n_words.alias("n_words"), hits.alias("hits"))
    items_of = F.array_sort(F.array_distinct(F.coalesce(F.col("hits.item"), F.array().cast("array<string>"))))
    n_hit = F.coalesce(F.size(F.array_distinct(F.flatten(F.col("hits.places")))), F.lit(0))
    n_hit = F.when(F.col("hits").isNull(), 0).otherwise(n_hit).cast("long")
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)], "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
