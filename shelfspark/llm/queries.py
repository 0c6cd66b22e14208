"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_scan, decontaminate, divergence, html_extract, langid, pfp_dedup, pii, quality_bt, spelling, stream_dedup, toxicity
from .common import is_fold, ship_package, table
from .mixing import curriculum_mix, ordered_mix
from .simhash_dedup import near_duplicates


def op1_toxicity_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_mix_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    mix = ordered_mix(curriculum_mix(table(spark, folder, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_prefix_free(spark: SparkSession, folder: str) -> DataFrame:
    found = pfp_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_density(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def op6_decontaminate_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


def op7_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"), pii.train())
    counts = [F.regexp_count("base", F.lit(f"(?:^|,){kind}:")).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_quality_bradley_terry(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality_bt.score(docs, quality_bt.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_ann_dimension_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = ann_scan.usable(table(spark, folder, "embeddings"))
    return ann_scan.nearest(rows, rows.filter("vec_id % 100 = 0"))


def op10_langid_centroids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op11_spelling_gram(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op12_dedup_stream(spark: SparkSession, folder: str) -> DataFrame:
    found = stream_dedup.exact_duplicates(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_divergence_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)
    return run


_ALL = {
    "op1_toxicity_viterbi": op1_toxicity_viterbi,
    "op2_mix_curriculum": op2_mix_curriculum,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_suffix_prefix_free": op4_suffix_prefix_free,
    "op5_html_density": op5_html_density,
    "op6_decontaminate_simhash": op6_decontaminate_simhash,
    "op7_pii_crf": op7_pii_crf,
    "op8_quality_bradley_terry": op8_quality_bradley_terry,
    "op9_ann_dimension_scan": op9_ann_dimension_scan,
    "op10_langid_centroids": op10_langid_centroids,
    "op11_spelling_gram": op11_spelling_gram,
    "op12_dedup_stream": op12_dedup_stream,
    "op13_divergence_one_hot": op13_divergence_one_hot,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _shipped(query) for name, query in _ALL.items()}

ORACLE_SQL = {
    "op2_mix_curriculum": """
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighted AS (
            SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
            FROM sources),
        -- With the k sources of the lowest ratio full, the others share what is left.
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM weighted),
        levels AS (
            SELECT k, most / weight AS ratio,
                   (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) AS budget,
                   coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
                   sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_weight
            FROM ranked),
        level AS (
            SELECT (budget - full_words) / free_weight AS level FROM levels
            WHERE (budget - full_words) / free_weight < ratio ORDER BY k LIMIT 1),
        targets AS (
            SELECT source, source_size,
                   least(weight * coalesce((SELECT level FROM level), 1e308), most) AS target
            FROM weighted),
        placed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(greatest(least(size, floor(target) - start), 0)
                    + greatest(least(size, floor(target) - start - source_size), 0) AS BIGINT) AS taken
        FROM placed""",
    # The checksum byte by byte from its table of 256, near words by what is left without one code point.
    "op11_spelling_gram": """
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_concat([i], range(8)),
                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
                FROM (SELECT unnest(range(256)) AS i))),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL),
        hashed AS (
            SELECT run, n, length(run) AS size, xor(4294967295, list_reduce(list_concat([4294967295],
                    list_transform(range(strlen(doc_id || ':' || run)),
                        lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
            FROM runs, crc_table),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
                   CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        path AS (
            SELECT word, word AS at, form AS next FROM formed
            UNION ALL SELECT p.word, p.next, f.form FROM path p JOIN formed f ON p.next = f.word)
        SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path p ON p.word = f.word AND p.next IS NULL""",
    "op12_dedup_stream": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # Every term of a language against every group, zeros included.
    "op13_divergence_one_hot": """
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[a-z\\x{80}-\\x{10FFFF}]+') AS found
            FROM documents),
        counts AS (
            SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(found) AS term FROM docs) GROUP BY ALL),
        kept AS (
            SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counts GROUP BY ALL HAVING count(*) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        cells AS (
            SELECT lang, source, term, CAST(sum(c.n) AS HUGEINT) AS n FROM counts c JOIN kept k USING (lang, term) GROUP BY ALL),
        groups AS (
            SELECT g.lang, g.source, coalesce(s.total, 0) AS total
            FROM (SELECT DISTINCT lang, source FROM docs) g
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source),
        priced AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // CAST(g.total + l.v AS HUGEINT) AS HUGEINT) AS p,
                   CAST(1 + 1000000000::HUGEINT * (k.n + 1) // CAST(l.total + l.v AS HUGEINT) AS HUGEINT) AS lang_p
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
        pairs AS (
            SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
            FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                       FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) d
                ON d.lang = g.lang AND d.source = g.source AND d.item = o.source),
        terms AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT) AS value
            FROM priced WHERE n > 0 AND p > lang_p)
        SELECT lang, source, part, item, value, rank FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        WHERE part = 'pair' OR rank <= 200""",
}
