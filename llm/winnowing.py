"""Benchmark decontamination [native]: winnowed fingerprints, a join, and hits extended to whole windows.

DataFrame functions only. Words are runs of digits, letters a-z (A-Z are lowered)
and characters beyond ASCII. Of each text's k-grams of words the smallest hash in
every sliding window of ``length - k + 1`` k-grams is kept: two texts that share
``length`` consecutive words share such a window, and so its smallest hash. The kept
hashes of documents meet those of the benchmark; around each meeting the windows of
``length`` words that hold the k-gram are cut out and compared word for word with the
benchmark's windows. So what is found is exact, and every shared span of ``length``
words or more is found. Items of fewer words are one window each: for every such
length that occurs, all of a document's k-grams of that length are fingerprints.

Defined cases: null and empty texts have no words and neither hit nor are hit; an
item without an id counts as an item named ""; an id with several texts is one item;
repeated rows and rows with null ids are rows of their own; an empty benchmark hits
nothing; columns besides the named ones change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import cut, only_wanted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, as characters and as a pattern (after A-Z are lowered).
APART = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE = 28  # low bits of a packed fingerprint: the k-gram's place; above them: bits of its hash
LIMIT = 1 << 18  # rows of a table that is broadcast
LIMIT_BYTES = 64 << 20


def words(text: Column) -> Column:
    # lower() is exact for ASCII and much cheaper
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    bare = F.btrim(F.coalesce(low, F.lit("")), F.lit(APART))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, PATTERN))


def _each(n: Column, size: int, make) -> Column:
    """make(i) for every place of a run of ``size`` among ``n``; none if there are fewer."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), make)).otherwise(F.array().cast("array<bigint>"))


def _packed(size: int):
    """A k-gram's hash above its place."""
    return lambda i: F.xxhash64(F.lit(size), *[F.get("hashes", i + j) for j in range(size)]).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("bigint"))


def with_fingerprints(texts: DataFrame, text: str, length: int, k: int, short: list[int]) -> DataFrame:
    """``texts`` with ``words``, ``n`` and ``prints``: winnowed k-grams, and all k-grams of each size in ``short``."""
    width = length - k + 1
    n = F.col("n")
    hashed = texts.withColumn("words", words(F.col(text))).drop(text).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("hashes"))
    grams = hashed.withColumn("grams", F.when(n >= length, _each(n, k, _packed(k))).otherwise(F.array().cast("array<bigint>")))
    lowest = _each(F.size("grams"), width, lambda i: F.least(*[F.get("grams", i + j) for j in range(width)]) if width > 1 else F.get("grams", i))
    kept = grams.withColumn("prints", F.array_distinct(lowest)).drop("grams")
    for size in short:
        kept = kept.withColumn("prints", F.concat("prints", _each(n, size, _packed(size))))
    return kept.drop("hashes")


def _small(df: DataFrame, text: str | None = None) -> bool:
    """Whether a written table is of a size that may be broadcast."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return rows <= LIMIT and (size or 0) <= LIMIT_BYTES


class Benchmark:
    """The benchmark's tables, written once: ``windows(window, size, text)``, ``owners(window, item)`` and ``prints(value, size)``."""

    def __init__(self, items: DataFrame, length: int, k: int):
        cleaned = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
        split = cut(cleaned.select("item", words(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
        n, whole = F.size("words"), F.array_join("words", " ")
        texts = F.when(n < length, F.array(whole)).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))), lambda i: F.array_join(F.slice("words", i + 1, length), " ")))
        every = cut(split.select("item", F.least(n, F.lit(length)).alias("size"), F.explode(texts).alias("text")).distinct(), "itemwindows")
        self.windows = cut(every.select("size", "text").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
        self.owners = cut(every.join(self.windows, ["size", "text"]).select("window", "item"), "owners")
        self.short = sorted(r.size for r in every.where(F.col("size") < length).select("size").distinct().collect())  # fewer than ``length``
        rejoined = split.select(F.array_join("words", " ").alias("text"), F.size("words").alias("size"))
        long = with_fingerprints(rejoined.where(F.col("size") >= length), "text", length, k, []).select(F.explode_outer("prints").alias("print"), F.lit(length).alias("size"))
        prints = long
        for size in self.short:  # one k-gram, the whole item
            own = with_fingerprints(rejoined.where(F.col("size") == size), "text", length, k, [size])
            prints = prints.union(own.select(F.explode_outer("prints").alias("print"), F.lit(size).alias("size")))
        self.prints = cut(prints.where("print is not null").select(F.shiftright("print", PLACE).alias("value"), "size").distinct(), "prints")


def matched_windows(docs: DataFrame, bench: Benchmark, length: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows(row, doc_id, n_words) has every row of ``docs``; hits(row, start, size, window) every
    place where one of the benchmark's windows occurs, each once.

    Scale: one pass over the documents, in which the benchmark's fingerprints (or, if these are over LIMIT, a
    bitmap of them) are broadcast; only meetings and the ``2 * length`` words around them are written. Each
    meeting becomes at most length - k + 1 windows, however often a k-gram occurs in the benchmark."""
    width = length - k + 1
    base = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    made = with_fingerprints(base, "text", length, k, bench.short)
    # a row's first print is null and meets nothing: every row stays. Outer: the optimiser would test for empty
    # arrays first, with all expressions of the array once more
    spread = made.select("row", "doc_id", "n", "words", F.explode_outer(F.concat(F.array(F.lit(None).cast("bigint")), "prints")).alias("print"))
    spread = spread.withColumn("value", F.shiftright("print", PLACE)).withColumn("at", F.col("print").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    few = _small(bench.prints)
    if few:
        met = spread.join(F.broadcast(bench.prints), "value", "left").where("print is null or size is not null")
    else:
        slots = 1 << 18
        h = F.xxhash64("value")
        slot, bit = F.pmod(F.shiftrightunsigned(h, 6), F.lit(slots)).alias("slot"), h.bitwiseAND(F.lit(63)).cast("int")
        bits = bench.prints.select(slot, bit.alias("bit")).groupBy("slot").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
        met = spread.withColumn("slot", slot).withColumn("bit", bit).join(F.broadcast(bits), "slot", "left").where(
            F.col("print").isNull() | F.coalesce(F.call_function("getbit", "bits", "bit") == 1, F.lit(False)))
    # the widest window that may hold the k-gram begins ``width`` - 1 words before it
    first = F.greatest(F.col("at") - (width - 1), F.lit(0))
    near = met.select("row", "doc_id", "n", "value", "at", *(["size"] if few else []), first.alias("first"), F.slice("words", first + 1, 2 * length).alias("near"))
    near = cut(near, "meetings")
    rows, seeds = near.where("at is null").select("row", "doc_id", F.col("n").cast("bigint").alias("n_words")), near.where("at is not null")
    if not few:
        seeds = seeds.join(bench.prints, "value")
    whole = F.col("size") == length
    begin, end = F.when(whole, F.col("first")).otherwise(F.col("at")), F.when(whole, F.least("at", F.col("n") - length)).otherwise(F.col("at"))
    starts = seeds.select("row", "size", "first", "near", F.explode(F.sequence(begin, end)).alias("start"))
    tried = starts.select("row", "start", "size", F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, F.col("size")), " ").alias("text")).distinct()
    windows = F.broadcast(bench.windows) if _small(bench.windows, "text") else bench.windows
    return rows, cut(tried.join(windows, ["size", "text"]).select("row", "start", "size", "window"), "hits")


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, k: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for every row of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    n_hit counts the words inside any hit; items has the ids, as strings in order, of the items with a hit."""
    bench = Benchmark(items, length, k)
    rows, hits = matched_windows(docs, bench, length, k)
    order = Window.partitionBy("row").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("row", F.greatest(end - F.greatest("start", before), F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    owners = F.broadcast(bench.owners) if _small(bench.owners, "item") else bench.owners
    named = hits.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.join(named, "row")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def contamination_digests(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return contamination(docs, items, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
