"""Merkle manifest: a tree of digests for each source, and over the sources one root.

A leaf is the digest of a row's five columns. Of each source the leaves ascend by
doc_id; every FAN consecutive nodes (the last run may be shorter) become one, until
one is left, the subroot. The subroots, ordered by source, become the root in the
same way. A row's proof is its siblings on the way to the root.

Rows are numbered within their source by a range sort and the counts of its
partitions, so that no source meets in one task. Blocks of FAN ** height leaves are
reduced by the executors; what is left is the small top tree. The driver builds it
and broadcasts, for each block, the suffix of its rows' paths; executors rebuild the
levels of a block, complete its rows' proofs and fold them. A top of over ``top``
nodes (very many rows, or very many sources) is reduced by the executors in the same
way, round by round, until it is small, and its suffixes are joined.

Defined cases: null and empty values have different leaves ("-" and "0:"); rows
without a source are a source of their own that comes first; null doc_ids come first
in their source; rows of one source and doc_id are ordered by their leaves, and equal
rows are leaves of their own; columns besides the five change nothing; an empty
table has no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "subroot string, root string, before array<string>, after array<string>"


def leaf_digest(text: Column) -> Column:
    """The leaf of a row whose text is ``text``: a binary digest of 32 bytes."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":")), F.lit("-")), F.coalesce(value, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


def grow(nodes: list[str], steps: int) -> list[list[str]]:
    """``nodes`` and ``steps`` levels above them."""
    levels = [nodes]
    for _ in range(steps):
        levels.append([node(levels[-1][i:i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    return levels


def way_up(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """For each level but the last, what stands before and after node ``i``'s ancestor in its run."""
    before, after = [], []
    for level in levels[:-1]:
        run = i // FAN * FAN
        before.append("".join(level[run:i]))
        after.append("".join(level[i + 1:run + FAN]))
        i //= FAN
    return before, after


def fold(digest: str, before: list[str], after: list[str]) -> str:
    """The root that follows from a leaf and its siblings."""
    for b, a in zip(before, after, strict=True):
        digest = node([b, digest, a])
    return digest


def small(df: DataFrame, limit: int) -> DataFrame:
    """A written table of at most ``limit`` rows is broadcast, a larger one left to the planner."""
    return F.broadcast(df) if df.count() <= limit else df


def numbered(df: DataFrame, seq: str, order: list[str], bound: int) -> DataFrame:
    """``df`` with ``pos``, a row's number within its ``seq``, and ``n``, the number of rows of it.

    Rows are dealt by ranges of (seq, *order), so a large sequence is many tasks. Where a sequence
    starts in a partition follows from counts, one for each partition and each sequence in it."""
    ranked = cut(df.repartitionByRange(seq, *order).sortWithinPartitions(seq, *order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    starts = ranked.groupBy(F.col(seq), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of = Window.partitionBy(seq)
    starts = cut(starts.select(
        seq, "part", F.sum("rows").over(of).alias("n"),
        (F.coalesce(F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift")), "starts")
    return ranked.withColumn("part", part).join(small(starts, bound), [seq, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def in_blocks(nodes: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """(seq, block, n, *columns): runs of ``width`` consecutive nodes, each column as an array in order."""
    runs = nodes.groupBy("seq", F.floor(F.col("pos") / width).alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("run"))
    return cut(runs.select("seq", "block", "n", *[F.col(f"run.{c}").alias(c) for c in columns]), "blocks")


def _reduced(height: int, digests: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tops = batch["n"].to_pylist(), []
            for of, own in zip(n, batch[digests], strict=True):
                tops.append(grow([d.hex() for d in own.as_py()], min(height, height_of(of)))[-1][0])
            yield pa.RecordBatch.from_pydict({
                "seq": batch["seq"], "pos": batch["block"], "n": pa.array([-(-x // FAN ** height) for x in n], pa.int64()),
                "digest": pa.array([bytes.fromhex(d) for d in tops], pa.binary())})
    return run


def reduced(blocks: DataFrame, height: int, digests: str) -> DataFrame:
    """One node (seq, pos, n, digest) of each block, ``height`` levels up or where its sequence ends."""
    return cut(blocks.mapInArrow(_reduced(height, digests), "seq string, pos long, n long, digest binary"), "nodes")


def top_paths(nodes: list[tuple[str, int, str]], over_sources: bool) -> list[tuple]:
    """(seq, pos, subroot, root, before, after) of every node of the small top tree."""
    found, subroots = [], []
    for seq, own in groupby(sorted(nodes), key=lambda x: x[0]):
        digests = [d for _, _, d in own]
        levels = grow(digests, height_of(len(digests)))
        found += [(seq, i, levels, len(subroots)) for i in range(len(digests))]
        subroots.append(levels[-1][0])
    above = grow(subroots, height_of(len(subroots)) if over_sources else 0)
    paths = []
    for seq, i, levels, source in found:
        (b, a), (b2, a2) = way_up(levels, i), way_up(above, source)
        paths.append((seq, i, levels[-1][0], above[-1][0], b + b2, a + a2))
    return paths


def _finished(height: int, digests: str, keep: list[str], others: str | None):
    """Rebuild the levels of each block and complete its rows' ways up with the block's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own = [d.hex() for d in block[digests]]
                levels = grow(own, min(height, height_of(block["n"])))
                paths = [way_up(levels, i) for i in range(len(own))]
                out = {"subroot": [block["subroot"]] * len(own), "root": [block["root"]] * len(own),
                       "before": [b + block["before"] for b, _ in paths], "after": [a + block["after"] for _, a in paths]}
                for c in keep:
                    out[c] = block[c]
                if others:
                    out["leaf"] = own
                    # an unchanged row is folded like a changed one: the fold is what is checked
                    out["folded_root"] = [fold(o.hex() if o else d, b, a) for o, d, b, a in zip(block[others], own, out["before"], out["after"], strict=True)]
                else:
                    width = FAN ** height
                    out["seq"], out["pos"] = [block["seq"]] * len(own), [block["block"] * width + i for i in range(len(own))]
                yield out
    def arrow(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            for i in range(0, len(out["root"]), 1024):
                yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name][i:i + 1024], f.type) for f in schema}, schema=schema)
    return arrow


def _finish(blocks: DataFrame, paths: DataFrame, height: int, digests: str, keep: list[tuple[str, str]], others: str | None = None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = ", ".join(f"{c} {kind}" for c, kind in keep) + (", " if keep else "")
    ddl = f"{names}leaf string, folded_root string, {PATH}" if others else f"seq string, pos long, {PATH}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    run = _finished(height, digests, [c for c, _ in keep], others)
    joined = blocks.join(paths.withColumnRenamed("pos", "block"), ["seq", "block"])
    return joined.mapInArrow(lambda batches: run(batches, schema), ddl)


def upper_paths(nodes: DataFrame, height: int, top: int, over_sources: bool = True) -> DataFrame:
    """(seq, pos, subroot, root, before, after): the way from each node of ``nodes(seq, pos, n, digest)`` to the root.

    Up to ``top`` nodes the driver builds the tree and the paths are broadcast; more are reduced here once more."""
    spark, ddl = nodes.sparkSession, f"seq string, pos long, {PATH}"
    count, largest = nodes.agg(F.count("*"), F.max("n")).first()
    if count <= top:
        rows = [(r.seq, r.pos, bytes(r.digest).hex()) for r in nodes.collect()]
        return F.broadcast(spark.createDataFrame(top_paths(rows, over_sources), ddl))
    if largest > 1:
        blocks = in_blocks(nodes, FAN ** height, ["digest"])
        above = upper_paths(reduced(blocks, height, "digest"), height, top, over_sources)
        return cut(_finish(blocks, above, height, "digest", []), "paths")
    # each source is one node by now: the sources in order are a sequence of their own
    ordered = cut(numbered(nodes.select("seq", "digest", F.lit("").alias("all")), "all", ["seq"], top).withColumnRenamed("seq", "source"), "sources")
    above = upper_paths(ordered.select(F.col("all").alias("seq"), "pos", "n", "digest"), height, top, False)
    paths = ordered.select("source", "digest", "pos").join(above.drop("seq", "subroot"), "pos")
    return cut(paths.select(F.col("source").alias("seq"), F.lit(0).cast("long").alias("pos"), F.lower(F.hex("digest")).alias("subroot"), "root", "before", "after"), "paths")


def manifest(docs: DataFrame, altered: Column | None = None, height: int = 3, top: int = 4096) -> DataFrame:
    """(doc_id, leaf, folded_root, subroot, root, before, after) for every row of ``docs`` (its columns FIELDS).

    ``altered`` is the text that a row has by now, or null where it is unchanged; ``folded_root`` is what
    follows from the leaf of that text and the original siblings. ``before`` and ``after`` hold, level by
    level up to the root, the siblings on either side as one hex text each.

    Scale: one read of the documents writes 32 bytes a row (64 if altered); only these are sorted and grouped, in
    blocks of 16 ** height rows. The driver gets at most ``top`` digests and the broadcast has as many paths.
    """
    other = F.when(altered.isNotNull(), leaf_digest(altered)) if altered is not None else F.lit(None).cast("binary")
    leaves = cut(docs.select(
        # null comes first and no source is empty here
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("leaf"), other.alias("other"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    ranked = numbered(leaves, "seq", ["doc_id", "leaf", "row"], 1 << 16)
    blocks = in_blocks(ranked, FAN ** height, ["doc_id", "leaf", "other"])
    paths = upper_paths(reduced(blocks, height, "leaf"), height, top)
    return _finish(blocks, paths, height, "leaf", [("doc_id", "bigint")], "other")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def proofs_and_folds(docs: DataFrame, **options) -> DataFrame:
    """Digests of ``manifest``'s proofs, with the text's capitals A-Z lowered where 5 divides the crc32 of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, F.when(hit, lower_ascii(F.col("text"))), **options)
    siblings = F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), "")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
