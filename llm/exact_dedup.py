"""Exact dedup: an extendible-hash index on shared files.

Texts are equal when they are the same characters after every space, tab, line
feed, vertical tab, form feed and carriage return is deleted. Each text's 64-bit
hash is its key. The directory maps the first bits of a key to a bucket; it
starts with one bucket and doubles whenever an overfull bucket needs one more
bit than the directory has. Each bucket is a range of keys with one owner task,
which chains the different texts that share a key by comparing their bytes and
writes the bucket's file into the shared folder.

Defined cases: a null text counts as empty; all empty texts are one group; of a
group the row with the most code points in its original text stays, then the
smallest doc_id (null first); rows repeated with one doc_id are members like any others: ``exact_groups``
marks every row with the keeper's doc_id as kept, ``drop_copies`` keeps one of them. Other columns are left alone.
"""

from __future__ import annotations

from math import ceil, log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import cut, with_rows, write_shared

WHITE = " \t\n\x0b\x0c\r"
KEY_BITS = 64
MOST_OWNERS = 1 << 16  # tasks of one stage


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def build_directory(loads: dict[int, int], max_bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """(prefix, bucket, local depth) for every directory entry of ``max_bits`` bits.

    ``loads`` has the number of entries by their first ``max_bits`` bits. A bucket
    above ``capacity`` splits on its next bit; needing more bits than the
    directory has doubles the directory (each entry becomes two). A bucket that is
    overfull at ``max_bits`` goes on splitting below its entry, which keeps only the
    local depth it needs: keys are hashes, so their next bits halve it each time."""
    depth, directory, local = 0, [0], {0: 0}
    load = {0: sum(loads.values())}
    members = {0: dict(loads)}
    todo = [0]
    while todo:
        bucket = todo.pop()
        if load[bucket] <= capacity:
            continue
        if local[bucket] == max_bits:
            local[bucket] += ceil(log2(load[bucket] / capacity))
            continue
        if local[bucket] == depth:
            directory = [b for b in directory for _ in range(2)]
            depth += 1
        twin = len(local)
        local[bucket] += 1
        local[twin] = local[bucket]
        shift = max_bits - local[bucket]
        high = {p: n for p, n in members[bucket].items() if p >> shift & 1}
        low = {p: n for p, n in members[bucket].items() if not p >> shift & 1}
        members[bucket], members[twin] = low, high
        load[bucket], load[twin] = sum(low.values()), sum(high.values())
        own = [i for i, b in enumerate(directory) if b == bucket]
        for i in own:
            if i >> (depth - local[bucket]) & 1:
                directory[i] = twin
        todo += [bucket, twin]
    return [(p, b, local[b]) for p, b in ((p, directory[p >> (max_bits - depth)]) for p in range(1 << max_bits))]


def _collapse(batches):
    """Equal texts of a batch become one row: their number and the best of them."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        # the best of a text comes first: most code points, then smallest id with nulls first, then row
        order = pc.sort_indices(t, sort_keys=[("points", "descending"), ("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start")
        g = t.take(order).group_by(["key", "norm"], use_threads=False).aggregate(
            [("points", "first"), ("doc_id", "first"), ("row", "first"), ("points", "count")])
        out = pa.table({"key": g["key"], "norm": g["norm"], "points": g["points_first"], "doc_id": g["doc_id_first"], "row": g["row_first"], "n": g["points_count"].cast(pa.int64())})
        yield from out.to_batches()


def build_index(docs: DataFrame, max_bits: int = 14, capacity: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(index, entries): the index's rows as read from its files, and every document's key.

    index(key, chain, keep_id, keep_row, group_size, text_sha256) has one row per distinct
    text (keep_row: 0 where ``docs`` has no column row__), in one file per bucket under the shared folder; chain numbers the
    texts of one key. entries(doc_id, key, text_sha256) has one row per document.
    The directory has 2**max_bits entries whatever the corpus holds; an entry
    whose keys exceed ``capacity`` stands for as many buckets, on its keys' next
    bits, as they need. Loads are distinct keys, so copies overfill no bucket.
    """
    spark = docs.sparkSession
    base = docs.select(
        "doc_id", (F.col("row__") if "row__" in docs.columns else F.lit(0).cast("long")).alias("row"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normal(F.col("text")).alias("norm"))
    base = base.withColumn("key", F.xxhash64("norm"))
    entries = cut(base.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "entries")
    prefix = F.shiftrightunsigned("key", KEY_BITS - max_bits)
    # bounded: one row per prefix
    loads = {r.p: r.n for r in entries.groupBy(prefix.alias("p")).agg(F.approx_count_distinct("key").alias("n")).collect()}
    directory = build_directory(loads, max_bits, capacity)
    entry_buckets = len({b for _, b, _ in directory})
    more = {b: max(depth - max_bits, 0) for _, b, depth in directory}
    buckets = sum(1 << bits for bits in more.values())
    lookup = spark.createDataFrame([(p, b, more[b]) for p, b, _ in directory], "p long, entry long, more int")
    # a bucket's number: its entry's, and the bits below the entry
    own_bits = F.call_function("shiftrightunsigned", F.col("key"), F.lit(KEY_BITS - max_bits) - F.col("more"))
    bucket = F.col("entry") + F.pmod(own_bits, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more"))) * entry_buckets

    # copies collapse batch by batch before the texts move, so a group that holds a third of all rows stays small
    few = base.mapInArrow(_collapse, "key long, norm string, points long, doc_id long, row long, n long")
    owners = max(min(buckets, MOST_OWNERS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    owned = few.join(F.broadcast(lookup), prefix == F.col("p")).withColumn("bucket", bucket).drop("p", "entry", "more").repartition(owners, "bucket")
    # one owner holds all of a bucket (and, beyond MOST_OWNERS buckets, several): both groupings below find their rows in place
    texts = owned.groupBy("bucket", "key", "norm").agg(
        F.sum("n").alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), "doc_id", "row")).alias("best"))
    chained = texts.select(
        "bucket", "key", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("best")).alias("chain"),
        F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.sha2("norm", 256).alias("text_sha256"))
    path = write_shared(chained, "exthash", "bucket")
    return spark.read.schema(chained.drop("bucket").schema).parquet(path), entries


def exact_groups(docs: DataFrame, hot_share: float = 0.001, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs(doc_id, text)``.

    Groups above ``hot_share`` of all rows are at most 1 / hot_share, so they
    are broadcast; the others meet their documents by a join on the key."""
    index, entries = build_index(docs, **options)
    index = index.select("key", "text_sha256", "keep_id", "group_size")
    least = entries.count() * hot_share
    big, small = index.where(F.col("group_size") > least), index.where(F.col("group_size") <= least)
    names = big.select("key", "text_sha256", F.col("keep_id").alias("k1"), F.col("group_size").alias("g1"), F.lit(True).alias("hit"))
    marked = entries.join(F.broadcast(names), ["key", "text_sha256"], "left")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    found = marked.where("hit").select("doc_id", F.col("k1").alias("keep_id"), F.col("g1").alias("group_size"), "text_sha256").union(
        marked.where("hit is null").select("doc_id", "key", "text_sha256").join(small, ["key", "text_sha256"]).select(*out))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are; rows are told apart by
    a key of their own, so a repeated row of the keeper's doc_id goes like any other copy."""
    keyed = with_rows(docs)
    kept = build_index(keyed, **options)[0].select(F.col("keep_row").alias("row__"))
    return keyed.join(kept, "row__", "left_semi").select(*docs.columns)
