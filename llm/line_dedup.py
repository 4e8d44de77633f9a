"""Fuzzy line dedup [native]: SimHash of normalised lines, pigeonhole blocks, edit similarity, components.

DataFrame functions only. A line is a piece of a text between line feeds. It is
normalised to lower case with every run of other characters than letters, marks
and digits as one space. Its words fall into BLOCKS classes by their hash, and
each block of the SimHash is made of the words of its own class: so an edit of
one word changes at most two blocks, and by the pigeonhole principle the others
are equal for certain, while many edits in a long line still leave most bits of
a block as they are. Lines are compared when they agree in some choice of
blocks: all but two for lines of up to 10 words, any three for longer and any two
for the longest ones (CHOICES; around a border both). A choice counts when its
classes hold enough words, or half of a shorter line. Lines are linked when the edit similarity of their
normal forms, 1 - levenshtein / longer length, reaches ``similarity``. Of each
connected group the occurrence with the smallest (doc_id, line_no) stays.

So one word replaced is found for certain in lines whose other words fill the
choice; more edits are found by chance, as the README's measured recall says.

Defined cases: a null text has no lines; lines whose normal form is empty carry
no wording and always stay, each its own group; repeated lines inside one
document count as occurrences like any others; rows with a null doc_id take
part and order first; of rows that repeat a whole document one row's
occurrences stay; a line of one word meets equal lines only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import components, cut, only_wanted, with_rows

BLOCKS, BITS = 6, 15  # 60 bits of SimHash
#: Blocks that must agree, for lines of so many different words, and the words that these blocks must hold.
CHOICES = ((BLOCKS - 2, 1, 10, 3), (3, 9, 32, 5), (2, 28, None, 6))
LANES = 5  # a long holds three counters of 21 bits each: a class may have two million words of a line
MASK = 1 | 1 << 21 | 1 << 42
TILE = 2000  # lines of a key that meet in one go
NEIGHBOURS = 8  # lines of a larger key that each of its lines meets before all others
STEP, ANCHOR, PIECE = 48, 12, 800  # characters: where lines are cut to be compared, what both have there, a piece at most
FAR = 300  # a bound from which on an anchor is looked for as far away as the bound allows


def normal(text: Column) -> Column:
    """The normal form of a line, or of a text's lines, whose line feeds stay (and spaces beside them)."""
    # a single space before a letter is not matched: a match costs more than the rest of the pass
    return F.trim(F.regexp_replace(F.lower(text), r" [^\p{L}\p{M}\p{N}\n]+|[^\p{L}\p{M}\p{N} \n][^\p{L}\p{M}\p{N}\n]*", " "))


def with_simhash(lines: DataFrame) -> DataFrame:
    """lines(id, norm) -> (id, len, p0, p1, n0, n1), one row per id: length, bits of the blocks and their different words, three blocks to a long.

    Each different word (a long line's common words would outvote the rest) adds its hash's bits to counters packed three to a long, in the
    block that other bits of the hash name; a bit is set when over half of the
    block's words have it, and a block without words has the value 0, others 1 and more.
    Equal lines meet with the 18 bits of each word that count, half as many bytes as their text."""
    hashed = lines.select("id", F.char_length("norm").alias("len"), F.expr("array_distinct(transform(split(norm, ' '), w -> xxhash64(w)))").alias("h"))
    bits = "(x & 31L) | (shiftrightunsigned(x, 16) & 992L) | (shiftrightunsigned(x, 32) & 31744L)"
    packed = hashed.select("id", "len", F.expr(f"transform(h, x -> cast({bits} | shiftleft(pmod(shiftrightunsigned(x, 20), {BLOCKS}L), 15) as int))").alias("h"))
    words = packed.dropDuplicates(["id"]).select("id", "len", F.explode("h").alias("w")).select(
        "id", "len", F.shiftright("w", 15).alias("g"), F.expr("(w & 31L) | shiftleft(w & 992L, 16) | shiftleft(w & 31744L, 32)").alias("h"))
    sums = words.groupBy("id").agg(F.first("len").alias("len"), *[F.expr(f"count_if(g = {k})").alias(f"n_{k}") for k in range(BLOCKS)], *[
        F.expr(f"sum(if(g = {k}, shiftrightunsigned(h, {i}) & {MASK}L, 0L))").alias(f"s{k}_{i}") for k in range(BLOCKS) for i in range(LANES)])

    def above_half(k: int) -> Column:
        # adding 2**20 - 1 - n // 2 to a counter carries into its top bit when it is over n / 2
        raised, out = (F.lit((1 << 20) - 1) - F.shiftright(F.col(f"n_{k}"), 1)) * F.lit(MASK), F.lit(0).cast("long")
        for i in range(LANES):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{k}_{i}") + raised, 20).bitwiseAND(F.lit(MASK)), i))
        return out.alias(f"v{k}")

    def block(k: int) -> Column:
        # lanes at 0, 21 and 42 move together: 15 bits side by side
        v = F.col(f"v{k}")
        side = v.bitwiseAND(F.lit(31)).bitwiseOR(F.shiftrightunsigned(v, 16).bitwiseAND(F.lit(31 << 5))).bitwiseOR(F.shiftrightunsigned(v, 32).bitwiseAND(F.lit(31 << 10)))
        return F.when(F.col(f"n_{k}") > 0, side + 1).otherwise(0).cast("long").alias(f"b{k}")

    # small steps: the engine compiles no method of over 8,000 bytes
    kept, blocks = ["id", "len", *[f"n_{k}" for k in range(BLOCKS)]], sums
    for k in range(BLOCKS):
        later = [f"s{j}_{i}" for j in range(k + 1, BLOCKS) for i in range(LANES)]
        blocks = blocks.select(*kept, *[f"v{j}" for j in range(k)], above_half(k), *later)
    blocks = blocks.select(*kept, *[block(k) for k in range(BLOCKS)])
    three = lambda v, k: F.col(f"{v}{k}").bitwiseOR(F.shiftleft(F.col(f"{v}{k + 1}"), 21)).bitwiseOR(F.shiftleft(F.col(f"{v}{k + 2}"), 42))
    return blocks.select("id", "len", three("b", 0).alias("p0"), three("b", 3).alias("p1"), three("n_", 0).alias("n0"), three("n_", 3).alias("n1"))


def block_keys(distinct: DataFrame) -> DataFrame:
    """Rows of ``with_simhash`` -> (id, key): lines that agree in a choice of blocks share a key.

    A choice is a mask over the bits and the counts, so one short expression serves them all."""
    lane, spec = (1 << 21) - 1, []
    for size, low, high, most in CHOICES:
        for chosen in combinations(range(BLOCKS), size):
            masks = [sum(lane << 21 * (k % 3) for k in chosen if k // 3 == half) for half in (0, 1)]
            spec.append(f"struct({masks[0]}L as m0, {masks[1]}L as m1, {low}L as low, {(1 << 40) if high is None else high}L as high, {most}L as most, {len(spec)}L as tag)")

    def total(x: str, y: str) -> Column:
        return F.expr(" + ".join(f"(shiftright({v}, {21 * k}) & {lane}L)" for v in (x, y) for k in range(3)))

    rows = distinct.select("id", "p0", "p1", "n0", "n1", total("n0", "n1").alias("words"), F.expr(f"explode(array({', '.join(spec)}))").alias("c"))
    fitting = rows.where("words between c.low and c.high").where(total("(n0 & c.m0)", "(n1 & c.m1)") >= F.least("c.most", F.shiftright(F.col("words") + 1, 1)))
    # 40 bits of hash and the choice: what is shuffled packs better than whole hashes, and a rare clash is only compared
    return fitting.select("id", (F.shiftrightunsigned(F.xxhash64(F.expr("p0 & c.m0"), F.expr("p1 & c.m1")), 24) + F.shiftleft(F.col("c.tag"), 40)).alias("key"))


def _bound(na: Column, nb: Column, most: Column) -> Column:
    """An upper bound of the edit distance: the sum over pieces, cut where ANCHOR characters of ``na`` at each STEP occur near the same place in ``nb``.

    A lambda argument holds what is used twice; beyond ``most`` the sum stays as it is."""
    def bind(x: Column, use) -> Column:
        return F.get(F.transform(F.array(x), use), F.lit(0))

    def cost(x: Column, y: Column) -> Column:
        longer = lambda v: F.greatest(F.char_length(v["x"]), F.char_length(v["y"]))
        return bind(F.struct(x.alias("x"), y.alias("y")), lambda v: F.when(v["x"] == v["y"], 0).when(longer(v) > PIECE, longer(v)).otherwise(F.levenshtein(v["x"], v["y"])))

    def state(p: Column, q: Column, total: Column) -> Column:
        return F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), total.cast("int").alias("total"))

    def step(was: Column, p: Column) -> Column:
        anchor, gone = F.substr(na, p, F.lit(ANCHOR)), p - was["p"]
        ahead = was["q"] + gone

        def look(low: Column, size: Column, other: Column) -> Column:
            def cut_at(at: Column) -> Column:
                q = at["low"] + at["i"] - 1
                return F.when(at["i"] > 0, state(p, q, was["total"] + cost(F.substr(na, was["p"], gone), F.substr(nb, was["q"], q - was["q"])))).otherwise(other)

            place = bind(F.greatest(was["q"], low), lambda x: F.struct(x.alias("low"), F.call_function("locate", anchor, F.substr(nb, x, size + ANCHOR)).alias("i")))
            return bind(place, cut_at)

        # from where nothing was added or lost onwards first: in a line that repeats itself the anchor is in many places
        reach = F.lit(ANCHOR) + F.floor(gone / 4).cast("int")
        # one long run of a word may be longer or shorter by nearly the whole bound
        far = F.when(most < FAR, was).otherwise(look(ahead, most - was["total"], look(was["q"], gone, was)))
        return F.when(was["total"] > most, was).otherwise(look(ahead, reach, look(ahead - reach, reach, far)))

    one = F.lit(1)
    starts = F.filter(F.sequence(F.lit(1 + STEP), F.greatest(F.char_length(na), F.lit(1 + STEP)), F.lit(STEP)), lambda p: p <= F.char_length(na) - ANCHOR)
    rest = lambda v, at: F.substr(v, at, F.char_length(v))
    return F.aggregate(starts, state(one, one, F.lit(0)), step, lambda was: was["total"] + cost(rest(na, was["p"]), rest(nb, was["q"])))


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """Those of pairs(a, b) where the edit similarity of their normal forms reaches the threshold.

    Two lines lose the words that they share at both ends first, which changes no distance. The distance
    of what is left takes time by the square of its length, so it is taken in pieces first, whose distances
    add up to the whole one or more. Where that passes the bound, the whole one decides. All answers are
    written before any is dropped: the optimiser would move a filter below the steps here and write each out at every use of it."""
    ta = texts.select(F.col("id").alias("a"), F.col("norm").alias("na"))
    tb = texts.select(F.col("id").alias("b"), F.col("norm").alias("nb"))
    longer = F.greatest(F.char_length("na"), F.char_length("nb"))
    most = F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    same = lambda x, y: x.eqNullSafe(y)
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", most.alias("most"), F.split("na", " ").alias("wa"), F.split("nb", " ").alias("wb"))
    head = both.withColumn("head", F.array_position(F.zip_with("wa", "wb", same), False) - 1)
    tail = head.withColumn("tail", F.array_position(F.zip_with(F.reverse("wa"), F.reverse("wb"), same), False) - 1)
    # what both ends share may not overlap in the shorter one
    ends = tail.withColumn("tail", F.least(F.col("tail"), F.least(F.size("wa"), F.size("wb")) - F.col("head")))
    rest = lambda w: F.array_join(F.slice(w, F.col("head") + 1, F.size(w) - F.col("head") - F.col("tail")), " ")
    cored = ends.select("a", "b", "most", rest("wa").alias("na"), rest("wb").alias("nb"))
    tried = cored.withColumn("near", _bound(F.col("na"), F.col("nb"), F.col("most")) <= F.col("most"))
    return cut(tried.select("a", "b", F.expr("case when near then true else levenshtein(na, nb, most) >= 0 end").alias("ok")), name).where("ok").select("a", "b")


def fuzzy_line_groups(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(doc_id, line_no, line_id, group_id, kept) for every non-empty line of ``docs(doc_id, text)``.

    line_id is the 64-bit hash of the normal form, group_id the smallest line_id
    of the connected group. Scale: equal lines meet once by a map-side combined
    aggregate, so a line that a third of all documents repeat is one row from
    there on. Inside a block key every line meets the key's smallest line first.
    Then lines of one key that are in different connected groups by now meet:
    a few neighbours each, and where these leave groups apart all others, in
    tiles of TILE lines a side. A link inside a group changes no group, so a key
    shared by many near copies costs a few pairs for each of its lines.
    """
    return _groups(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), similarity).drop("row")


def _groups(docs: DataFrame, similarity: float) -> DataFrame:
    """As fuzzy_line_groups, for rows told apart by ``row``, with that column."""
    # whole texts are normalised, as a filter or hash of what is made for each line would make it again
    raw = cut(docs.select("doc_id", "row", F.posexplode(F.split(normal(F.col("text")), "\n")).alias("line_no", "line")).select(
        "doc_id", "row", "line_no", F.trim("line").alias("norm")).where("norm <> ''").withColumn("id", F.xxhash64("norm")), "rawlines")

    distinct = cut(with_simhash(raw.select("id", "norm")), "simhashes")
    # one exchange and one sort by a number: a key's lines meet its smallest
    met = cut(block_keys(distinct).withColumn("low", F.min("id").over(Window.partitionBy("key"))).where("id <> low"), "met")

    near = F.least("len", "len2") >= F.greatest("len", "len2") * F.lit(similarity) - F.lit(1e-9)
    size = distinct.select("id", "len")
    lows = size.select(F.col("id").alias("low"), F.col("len").alias("len2"))
    star = cut(met.select("id", "low").distinct().join(size, "id").join(lows, "low").where(near).select(
        F.col("low").alias("a"), F.col("id").alias("b")), "star")
    texts = cut(_texts(raw, star.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
    found = _similar(star, texts, similarity, "first")
    # lines of a key that are in one group by now need no other pairs
    so_far = components(found).select(F.col("a").alias("id"), F.col("b").alias("group"))
    counts = met.groupBy("key").agg((F.count("*") + 1).alias("n")).where("n > 2")
    lines = met.select("key", "id").union(met.select("key", F.col("low").alias("id")).distinct()).join(counts, "key")
    many = cut(lines.join(size, "id").join(so_far, "id", "left").select(
        "key", "id", "n", "len", F.coalesce("group", "id").alias("group")), "many")
    # first each line meets the lines just before it in a key: what they link needs no other pairs either
    before = [F.lag(F.struct("id", "len", "group"), j).over(Window.partitionBy("key").orderBy("id")) for j in range(1, NEIGHBOURS + 1)]
    apart = lambda x: (x["group"] != F.col("group")) & (F.least(x["len"], F.col("len")) >= F.greatest(x["len"], F.col("len")) * F.lit(similarity) - F.lit(1e-9))
    met_next = _mixed(many).where(F.col("n") > NEIGHBOURS).withColumn("before", F.array(*before)).select("id", "group", F.explode(F.filter("before", apart)).alias("x"))
    close = cut(met_next.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b"), F.col("group").alias("ga"), F.col("x.group").alias("gb")).dropDuplicates(["a", "b"]), "close")
    near_by = _similar(close, _with_missing(raw, texts, close), similarity, "near_by").join(close, ["a", "b"])
    merged = components(near_by.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("a").alias("group"), F.col("b").alias("now"))
    many = cut(many.join(merged, "group", "left").select("key", "id", "n", "len", F.coalesce("now", "group").alias("group")), "regrouped")
    tiled = cut(_mixed(many).withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles")), "tiled")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rest = tiled.where("group <> one").select("key", F.col("id").alias("a"), F.col("len").alias("len2"), F.col("group").alias("group2"), F.col("tile").alias("ta"), tiles.alias("tb"))
    others = tiled.select("key", F.col("id").alias("b"), "len", "group", F.col("tile").alias("tb"), tiles.alias("ta"))
    pairs = cut(rest.join(others, ["key", "ta", "tb"]).where((F.col("group") != F.col("group2")) & near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    second = _similar(pairs, _with_missing(raw, texts, pairs), similarity, "second")
    edges = found.union(near_by.select("a", "b")).union(second)

    lead = components(edges).select(F.col("a").alias("id"), F.col("b").alias("lead"))
    # the first occurrence of each group: a combined minimum per line, then per group
    per_line = raw.groupBy("id").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("at")).join(lead, "id", "left").select(
        "id", F.coalesce("lead", "id").alias("group_id"), "at")
    per_group = per_line.groupBy("group_id").agg(F.min("at").alias("first_at"))
    verdict = per_line.join(per_group, "group_id").select("id", "group_id", F.col("first_at.row").alias("first_row"), F.col("first_at.line_no").alias("first_line"))
    return raw.select("doc_id", "row", "line_no", "id").join(verdict, "id").select(
        "doc_id", "line_no", F.col("id").alias("line_id"), "group_id",
        ((F.col("row") == F.col("first_row")) & (F.col("line_no") == F.col("first_line"))).alias("kept"), "row")


def _texts(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """The normal form of each wanted line, one row each."""
    return only_wanted(raw.select("id", "norm"), wanted).groupBy("id").agg(F.min("norm").alias("norm"))


def _with_missing(raw: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``texts`` and those that only ``pairs`` want."""
    missing = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id", "left_anti")
    return texts.unionByName(_texts(raw, missing))


def _mixed(many: DataFrame) -> DataFrame:
    """Rows of keys whose lines are in several groups, with the first of these as ``one``."""
    mixed = many.groupBy("key").agg(F.min("group").alias("one"), F.max("group").alias("other")).where("one <> other").select("key", "one")
    return many.join(mixed, "key")


def drop_fuzzy_lines(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """``docs`` with the text rebuilt from its kept lines (and its lines without wording); other columns as they are."""
    keyed = with_rows(docs)
    marks = _groups(keyed.select("doc_id", F.col("row__").alias("row"), "text"), similarity).where("not kept").groupBy(
        F.col("row").alias("row__")).agg(F.collect_set("line_no").alias("gone__"))
    pieces = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains(F.col("gone__"), i), x)), lambda x: x.isNotNull())
    return keyed.join(marks, "row__", "left").withColumn(
        "text", F.when(F.col("gone__").isNull(), F.col("text")).otherwise(F.array_join(pieces, "\n"))).select(*docs.columns)
