"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchengine.llm import decontaminate as dc
from matchengine.llm import byte_dedup, jaccard, langid, line_dedup, mixing, packing, quality, quotations, source_audit, token_files
from matchengine.durable import own_folder
from matchengine.llm.tokens import tokenizer_path
from matchengine.llm.urls import UrlRule, filter_urls

URL_RULES = [
    UrlRule("allow", "org"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotations.link_quotations(table(spark, sf_dir, "conversations"))
    return linked.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)).cast("long")).withColumn("reply_path", F.array_join(F.col("reply_path").cast("array<string>"), "/"))


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = dc.item_names()
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), dc.contaminated().alias("contaminated"))


def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op8_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op9_byte_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quotation_linking, op3_adaptive_quality, op4_harmonic_packing, op5_url_trie, op6_suffix_decontamination, op7_range_coder, op8_string_kernel_language, op9_byte_suffix_dedup, op10_jaccard_tiles, op11_source_divergence, op12_pareto_mixing)}


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": r"""
            WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents WHERE text IS NOT NULL),
            l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM s),
            w AS (
              SELECT doc_id, p, 3 AS size, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS key FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)
              UNION ALL SELECT doc_id, p, 1, line FROM l WHERE length(line) >= 200 OR n >= 50
              UNION ALL SELECT doc_id, p, 2, CASE WHEN n + lead(n) OVER o >= 50 THEN line || chr(10) || lead(line) OVER o END FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
            again AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY size, key ORDER BY doc_id, p) AS place FROM w WHERE key IS NOT NULL),
            gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS p FROM again WHERE place > 1),
            kept AS (
              SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN line END, chr(10) ORDER BY l.p), '') AS text
              FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
            SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
            FROM documents d LEFT JOIN kept k USING (doc_id)""",
        "op2_quotation_linking": r"""
            WITH m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS lines FROM conversations),
            l AS (SELECT conv_id, turn, role, text, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM m),
            p AS (
              SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks, length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) AS level FROM l),
            q AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(substr(line, length(marks) + 1)), '\s+', ' ', 'g')) AS key FROM p WHERE level > 0),
            own AS (SELECT conv_id, turn, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key FROM p WHERE level = 0),
            parent AS (
              SELECT q.conv_id, q.turn, arg_min(o.turn, struct_pack(a := q.level, b := -o.turn)) AS up
              FROM q JOIN own o ON o.conv_id = q.conv_id AND o.key = q.key AND o.turn < q.turn WHERE q.key <> '' GROUP BY ALL)
            SELECT m.conv_id, m.turn, m.role, coalesce(p.up, -1) AS parent_turn, coalesce(p.up, m.turn) AS thread_turn, CAST(CASE WHEN p.up IS NULL THEN 0 ELSE 1 END AS BIGINT) AS depth, CASE WHEN p.up IS NULL THEN '' ELSE p.up || '/' END || m.turn AS reply_path,
                   CAST(len(list_filter(m.lines, lambda x: regexp_matches(x, '^(?:[ \t]*>)+'))) AS BIGINT) AS n_quoted,
                   array_to_string(list_filter(m.lines, lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)) AS text
            FROM m LEFT JOIN parent p ON p.conv_id = m.conv_id AND p.turn = m.turn""",
        "op3_adaptive_quality": r"""
            WITH d AS (
              SELECT doc_id, lang, source, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
              FROM documents),
            win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
            twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM win) WHERE n > 1),
            repeated AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM twice) GROUP BY doc_id),
            c AS (
              SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
                     CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
              FROM d LEFT JOIN repeated r USING (doc_id)),
            b AS (
              SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                     1000 * n_symbols // nullif(word_chars, 0) AS r0, 1000 * n_dup_lines // nullif(n_lines, 0) AS r1, 1000 * n_repeat_words // nullif(n_words, 0) AS r2, 10 * word_chars // nullif(n_words, 0) AS r3
              FROM c),
            v AS (SELECT lang, source, unnest([0, 1, 2, 3]) AS ratio, unnest([r0, r1, r2, r3]) AS x FROM b WHERE NOT base_failed),
            t AS (SELECT lang, source, ratio, CASE WHEN x < 1024 THEN x ELSE (x >> (length(bin(x)) - 11)) << (length(bin(x)) - 11) END AS x FROM v WHERE x IS NOT NULL),
            g AS (SELECT *, row_number() OVER (PARTITION BY lang, source, ratio ORDER BY x) AS k, count(*) OVER (PARTITION BY lang, source, ratio) AS n FROM t),
            h AS (SELECT *, row_number() OVER (PARTITION BY lang, ratio ORDER BY x) AS k, count(*) OVER (PARTITION BY lang, ratio) AS n FROM t),
            gq AS (SELECT lang, source, ratio, max(n) AS n, min(x) FILTER (1000 * k >= 250 * n) AS a, min(x) FILTER (1000 * k >= 500 * n) AS m, min(x) FILTER (1000 * k >= 750 * n) AS u, min(x) FILTER (1000 * k >= 800 * n) AS e, min(x) FILTER (1000 * k >= 980 * n) AS z FROM g GROUP BY ALL),
            hq AS (SELECT lang, ratio, min(x) FILTER (1000 * k >= 250 * n) AS a, min(x) FILTER (1000 * k >= 500 * n) AS m, min(x) FILTER (1000 * k >= 750 * n) AS u, min(x) FILTER (1000 * k >= 800 * n) AS e, min(x) FILTER (1000 * k >= 980 * n) AS z FROM h GROUP BY ALL),
            q AS (
              SELECT gq.lang, gq.source, gq.ratio, (n * gq.a + 100 * hq.a) // (n + 100) AS a, (n * gq.m + 100 * hq.m) // (n + 100) AS m, (n * gq.u + 100 * hq.u) // (n + 100) AS u,
                     (n * gq.e + 100 * hq.e) // (n + 100) AS e, (n * gq.z + 100 * hq.z) // (n + 100) AS z
              FROM gq JOIN hq ON gq.lang IS NOT DISTINCT FROM hq.lang AND gq.ratio = hq.ratio),
            lim AS (
              SELECT lang, source, max(e + 8 * greatest(e - m, 1)) FILTER (ratio = 0) AS h0, max(z + 2 * greatest(z - m, 1)) FILTER (ratio = 1) AS h1, max(z + 2 * greatest(z - m, 1)) FILTER (ratio = 2) AS h2,
                     max(u + 8 * greatest(u - a, 1)) FILTER (ratio = 3) AS h3, max(a - 8 * greatest(u - a, 1)) FILTER (ratio = 3) AS l3
              FROM q GROUP BY ALL)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                   NOT base_failed AND NOT coalesce(r0 > h0, false) AND NOT coalesce(r1 > h1, false) AND NOT coalesce(r2 > h2, false) AND NOT coalesce(r3 > h3 OR r3 < l3, false) AS kept
            FROM b LEFT JOIN lim ON b.lang IS NOT DISTINCT FROM lim.lang AND b.source IS NOT DISTINCT FROM lim.source""",
        "op5_url_trie": r"""
            WITH parts AS (
              SELECT page_id,
                     translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
              FROM pages),
            rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
            fits AS (
              SELECT page_id, rhost || rpath AS rule, verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
              FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
            SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
            FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1""",
        "op6_suffix_decontamination": rf"""
            WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
            b AS (SELECT item_id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
            win AS (
              SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key
              FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT size FROM win),
            place AS (
              SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
            hit AS (SELECT p.doc_id, p.i, p.size, win.item_id FROM place p JOIN win ON win.size = p.size AND win.key = p.key),
            covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM hit) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
                   sha256(coalesce(i.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
            FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
        "op10_jaccard_tiles": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (
              SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS key
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.key = y.key AND x.doc_id <> y.doc_id GROUP BY ALL),
            link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
            reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id
            FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY ALL""",
        "op11_source_divergence": rf"""
            WITH d AS (
              SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
            g AS (SELECT DISTINCT lang, source FROM d),
            t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
            kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
            c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
            dense AS (
              SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.total
              FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
            rated AS (
              SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER o + 5 * count(*) OVER o) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (sum(total) OVER o + 5 * count(*) OVER o) AS q
              FROM dense WINDOW o AS (PARTITION BY lang, source)),
            f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM rated x JOIN rated y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
            parts AS (
              SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
              FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT 'term', lang, source, term, p - q FROM rated WHERE n > 0 AND p > q),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    }
