"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from llm.common import table


def op1_mixing(spark, sf_dir):
    from llm.mixing import mix

    weights = {("domain0",): 3.0, ("domain1",): 2.0, ("domain0", "en"): 2.0, ("domain1", "de"): 3.0}
    return mix(table(spark, sf_dir, "documents"), fraction=0.6, weights=weights, max_epochs=2)


def op2_exact_dedup(spark, sf_dir):
    from llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    from llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op4_toxicity(spark, sf_dir):
    from llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark, sf_dir):
    from llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_vector_dedup(spark, sf_dir):
    from llm.vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark, sf_dir):
    from llm.wordpiece_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark, sf_dir):
    from llm.pieces import encode_and_decode, token_digests

    return token_digests(encode_and_decode(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard(spark, sf_dir):
    from llm.ngram_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_line_dedup(spark, sf_dir):
    from llm.line_dedup import fuzzy_line_groups

    return fuzzy_line_groups(table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    from llm.merkle import proofs_and_folds

    return proofs_and_folds(table(spark, sf_dir, "documents"))


def op12_decontamination(spark, sf_dir):
    from llm.winnowing import contamination_digests

    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark, sf_dir):
    from llm.periodic_runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_exact_dedup, op3_url_filter, op4_toxicity, op5_html_text, op6_vector_dedup, op7_token_counts,
    op8_sentencepiece, op9_ngram_jaccard, op10_line_dedup, op11_merkle, op12_decontamination, op13_periodic_runs, pipeline)}

#: crc32 of a short ASCII text in SQL: bytes, then bits.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_leaf = lambda text: "sha256(" + " || ".join(
    f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
WORDS = "regexp_extract_all(" + LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

ORACLE = {
    "op2_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    # the tree level by level: nodes(tree 0: rows of a source, tree 1: subroots), then each row's way up
    "op11_merkle": f"""
        WITH RECURSIVE t AS (
          SELECT doc_id, source, {_leaf('text')} AS leaf,
                 CASE WHEN {CRC32.format('doc_id::varchar')} % 5 = 0 THEN {_leaf(LOWER.format('text'))} END AS other
          FROM documents),
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t),
        low AS (
          SELECT 0 AS level, coalesce('s' || source, '') AS seq, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM numbered
          UNION ALL
          SELECT level + 1, seq, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16
          FROM low WHERE n > 1 GROUP BY level, seq, pos // 16),
        subroots AS (SELECT seq, digest, row_number() OVER (ORDER BY seq) - 1 AS pos, level AS height FROM low WHERE n = 1),
        high AS (
          SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
          UNION ALL
          SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16
          FROM high WHERE n > 1 GROUP BY level, pos // 16),
        root AS (SELECT digest AS root FROM high WHERE n = 1),
        runs AS (
          SELECT 0 AS part, seq, level, pos, pos // 16 AS run, digest FROM low WHERE n > 1
          UNION ALL SELECT 1, '', level, pos, pos // 16, digest FROM high WHERE n > 1),
        sides AS (
          SELECT part, seq, level, pos,
                 coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                 coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
          FROM runs WINDOW w AS (PARTITION BY part, seq, level, run ORDER BY pos)),
        walk AS (
          SELECT doc_id, seq, s.pos AS source_pos, n.pos AS leaf_pos, leaf, height, s.digest AS subroot, 0 AS step, n.pos AS pos, coalesce(other, leaf) AS folded, '' AS proof
          FROM (SELECT *, coalesce('s' || source, '') AS seq FROM numbered) n JOIN subroots s USING (seq)
          UNION ALL
          SELECT k.doc_id, k.seq, source_pos, leaf_pos, leaf, height, subroot, step + 1,
                 CASE WHEN step + 1 = height THEN source_pos ELSE k.pos // 16 END, sha256(b || folded || a), proof || b || a
          FROM (SELECT *, CASE WHEN step = height AND height = 0 THEN source_pos ELSE pos END AS own FROM walk) k
          JOIN sides d ON d.part = (k.step >= height)::int AND d.seq = CASE WHEN k.step >= height THEN '' ELSE k.seq END
            AND d.level = CASE WHEN k.step >= height THEN k.step - height ELSE k.step END AND d.pos = own)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM walk, root WHERE step = height + (SELECT max(level) FROM high)""",
    "op12_decontamination": f"""
        WITH items AS (
          SELECT coalesce(item_id::varchar, '') AS item, {WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (
          SELECT DISTINCT item, least(len(w), 10) AS size,
                 unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(len(w) - 9), lambda i: w[i + 1 : i + 10]) END) AS g
          FROM items WHERE len(w) > 0),
        docs AS (
          SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        places AS (
          SELECT r, size, unnest(list_transform(range(len(w) - size + 1), lambda i: {{'i': i, 'g': w[i + 1 : i + size]}})) AS x
          FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
        hits AS (SELECT r, p.size, x.i AS i, item FROM places p JOIN windows v ON v.size = p.size AND v.g = x.g),
        covered AS (
          SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
        named AS (
          SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    # runs as islands of equal words p apart
    "op13_periodic_runs": f"""
        WITH raw AS (
          SELECT row_number() OVER () AS r, doc_id, {CRC32.format('doc_id::varchar')} AS h,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        planned AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
        docs AS (
          SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE
                 a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM planned),
        words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
        same AS (
          SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
        islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM same),
        stretches AS (
          SELECT r, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
        runs AS (SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
        lines AS (
          SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS txt FROM runs GROUP BY r),
        -- length / period exactly: 2^62 / 10^5 leaves room for 13 decimal digits
        best AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length * 10000000000000 // period DESC, start, period) AS k FROM runs) WHERE k = 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::DOUBLE AS start, length::DOUBLE AS length, period::DOUBLE AS period,
               (1000 * length // period)::DOUBLE AS exponent_milli,  -- doubles: whole numbers or null, as a data frame holds them
               sha256(coalesce(txt, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM docs LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
}
