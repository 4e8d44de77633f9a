"""Mixing sources to target weights: hierarchical budgets over domain, language and source.

A total of tokens is handed down a tree. At each node the children share its
budget by weight; a child that holds less (its tokens times the allowed epochs)
gives its shortage to its siblings, and only what all siblings together cannot
take returns to the level above, where the next ancestor's children share it.
Each leaf then takes a prefix of its token stream: whole epochs first, then the
documents of one more epoch in an order seeded by epoch and doc_id until the
budget is reached.

Defined cases: null language, source or domain form the leaf with the empty
name; null and blank texts have no tokens and are never selected; repeated rows
are separate rows of the stream in the order of their doc_id and then of their
text's hash; a leaf without weight counts as ``default_weight``; a corpus with fewer tokens than the total
is taken whole, ``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import bounded_rows, cut

SLICES = 4096  # of a leaf's order: a running sum meets only one slice of a leaf in one task


def share(budget: float, wants: dict, weights: dict) -> dict:
    """Divide ``budget`` among siblings by weight, no one above what it ``wants``; shortages go to the others."""
    got, open_ = dict.fromkeys(wants, 0.0), {k for k, v in wants.items() if v > 0 and weights[k] > 0}
    left = min(budget, sum(wants[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if wants[k] - got[k] <= left * weights[k] / total + 1e-9}
        if not full:
            for k in open_:
                got[k] += left * weights[k] / total
            break
        for k in full:
            left -= wants[k] - got[k]
            got[k] = wants[k]
        open_ -= full
    return got


def leaf_budgets(tokens: dict[tuple, int], total: float, weights: dict[tuple, float], max_epochs: int, default_weight: float = 1.0) -> dict[tuple, float]:
    """Budget of each leaf path. ``weights`` has relative weights by path prefix, e.g. ('web',), ('web', 'en')."""

    def down(prefix: tuple, budget: float, leaves: list[tuple]) -> dict[tuple, float]:
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: budget}
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[:len(prefix) + 1], []).append(leaf)
        wants = {c: float(sum(tokens[x] for x in own) * max_epochs) for c, own in children.items()}
        got = share(budget, wants, {c: weights.get(c, default_weight) for c in children})
        out: dict[tuple, float] = {}
        for c, own in children.items():
            out |= down(c, got[c], own)
        return out

    return down((), float(total), sorted(tokens)) if tokens else {}


def default_domain(source: Column) -> Column:
    """The documents table has no domain: sources fall into four by their number."""
    return F.concat(F.lit("domain"), (F.coalesce(F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")), F.lit(0)) % 4).cast("int").cast("string"))


def leaf_columns(domain: Column | None = None) -> list[Column]:
    """domain, lang and source of a document, without nulls."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return [F.coalesce(domain if domain is not None else default_domain(source), F.lit("")), F.coalesce("lang", F.lit("")), source]


def token_stream(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, key, n_tokens): words counted in the JVM, texts left behind.

    key is a hash of leaf and text: rows with one doc_id and key are told apart by nothing here."""
    leaf = leaf_columns(domain)
    return docs.select(
        "doc_id", leaf[0].alias("domain"), leaf[1].alias("lang"), leaf[2].alias("source"), F.xxhash64(*leaf, "text").alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"))


def mix(docs: DataFrame, total: float | None = None, fraction: float = 0.5, weights: dict[tuple, float] | None = None,
        max_epochs: int = 2, seed: int = 1, domain: Column | None = None, max_leaves: int = 100_000) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, taken), one row per document and epoch that it is selected in.

    ``total`` tokens (default: ``fraction`` of what there is). taken is n_tokens,
    or less for the one document in which a leaf's prefix ends. Leaves are
    bounded by ``max_leaves``; only their sums reach the driver. A leaf may hold
    most rows: its order is cut into SLICES by the hash itself, sums of slices
    are combined before the shuffle, and running sums within slices are
    windows over (leaf, slice).
    """
    return _choices(docs, total, fraction, weights, max_epochs, seed, domain, max_leaves)[1].drop("key")


def _choices(docs: DataFrame, total: float | None = None, fraction: float = 0.5, weights: dict[tuple, float] | None = None,
             max_epochs: int = 2, seed: int = 1, domain: Column | None = None, max_leaves: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The token stream, and the rows of ``mix`` with their key in it."""
    spark = docs.sparkSession
    leaf = ["domain", "lang", "source"]
    rows = cut(token_stream(docs, domain).where("n_tokens > 0"), "stream")
    sums = bounded_rows(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("n")), max_leaves, "the tree of sources")
    tokens = {(r.domain, r.lang, r.source): r.n for r in sums}
    budgets = leaf_budgets(tokens, total if total is not None else fraction * sum(tokens.values()), weights or {}, max_epochs)
    plan = [(*k, min(int(b // tokens[k]), max_epochs), int(b - tokens[k] * min(int(b // tokens[k]), max_epochs))) for k, b in budgets.items()]
    table = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, whole int, rest long"))
    joined = rows.join(table, leaf)
    whole = joined.where("whole > 0").select(
        "doc_id", *leaf, "key", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    # the seeded order of the last epoch: the first hex digits choose the slice
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.col("doc_id")))
    part = joined.where("rest > 0").withColumn("h", order).withColumn("slice", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    by_slice = part.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = by_slice.select(
        *leaf, "slice", (F.sum("in_slice").over(Window.partitionBy(*leaf).orderBy("slice")) - F.col("in_slice")).alias("before"))
    # slices that begin beyond the budget are not needed at all
    some = part.join(before, [*leaf, "slice"]).where("before < rest")
    within = Window.partitionBy(*leaf, "slice").orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")
    last = some.withColumn("start", start).where("start < rest").select(
        "doc_id", *leaf, "key", F.col("whole").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("start")).alias("taken"))
    return rows, whole.union(last)


def select_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` repeated once for each epoch that selects the document; whole texts, all columns as they are.

    Choices are counted by doc_id (null too), leaf and text. Equal rows stand
    side by side in a leaf's order, so all of them are chosen equally often but
    for at most one such set in a leaf, in which the budget ends; only there the
    rows are numbered."""
    stream, chosen = _choices(docs, **options)
    both = stream.select("doc_id", "key", F.lit(1).alias("m"), F.lit(0).alias("c")).union(chosen.select("doc_id", "key", F.lit(0), F.lit(1)))
    sums = both.groupBy(F.col("doc_id").alias("id__"), F.col("key").alias("key__")).agg(F.sum("m").alias("m"), F.sum("c").alias("c")).where("c > 0")
    times = cut(sums.select("id__", "key__", F.expr("cast(c div m as int)").alias("each__"), F.expr("cast(c % m as int)").alias("more__")), "times")
    keyed = docs.withColumn("row__", F.xxhash64(*leaf_columns(options.get("domain")), "text"))

    def met(wanted: DataFrame) -> DataFrame:
        return keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("row__") == F.col("key__")))

    def repeated(rows: DataFrame, n: Column) -> DataFrame:
        return rows.withColumn("copy__", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)

    out = repeated(met(times.where("more__ = 0")), F.col("each__"))
    ends = times.where("more__ > 0")
    if ends.isEmpty():
        return out
    numbered = met(F.broadcast(ends)).withColumn("n__", F.row_number().over(Window.partitionBy("id__", "key__").orderBy(F.lit(0))))
    return out.union(repeated(numbered, F.col("each__") + (F.col("n__") <= F.col("more__")).cast("int")))
