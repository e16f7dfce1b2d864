"""Registered queries of the text operators, and plain SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskbridge.llm import bpe, columns, decontaminate, dialogues, exact_dedup, html_text, hyperminhash, language_id, pii, simhash, spans, toxicity, variants
from riskbridge.llm.common import table

VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {
        "op1_html": lambda spark, sf: html_text.extract(table(spark, sf, "pages")),
        "op2_pii": lambda spark, sf: pii.personal_data(table(spark, sf, "documents")),
        "op3_language": lambda spark, sf: language_id.language_of(table(spark, sf, "documents")),
        "op4_spans": lambda spark, sf: spans.span_digests(table(spark, sf, "documents")),
        "op5_simhash": lambda spark, sf: simhash.near_duplicates(table(spark, sf, "documents")),
        "op6_toxicity": lambda spark, sf: toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op7_columns": lambda spark, sf: columns.byte_digests(table(spark, sf, "documents")),
        "op9_bpe": lambda spark, sf: bpe.token_digests(table(spark, sf, "documents"), vocabulary_path()),
        "op8_decontaminate": lambda spark, sf: decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
        "op10_exact_dedup": lambda spark, sf: exact_dedup.exact_groups(table(spark, sf, "documents")),
        "op11_hyperminhash": lambda spark, sf: hyperminhash.near_duplicates(table(spark, sf, "documents")),
        "op12_dialogues": lambda spark, sf: dialogues.repaired_digests(table(spark, sf, "conversations")),
        "op13_variants": lambda spark, sf: variants.spelling_variants(table(spark, sf, "documents")),
    }


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')"""


def _leads(key: str, rows: str) -> str:
    """Each word's place, the number of words, and the list of it and the nine words after it."""
    after = ", ".join(f"lead(word, {i}) OVER o" for i in range(1, 10))
    return f"""SELECT {key}, p, n_all, [word, {after}] AS ws
    FROM (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n_all FROM {rows}) WINDOW o AS (PARTITION BY {key} ORDER BY p)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_spans": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
win AS (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS body FROM p),
first AS (SELECT body, min(doc_id) AS m FROM win WHERE p + 12 <= n GROUP BY body),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN first USING (body) WHERE p + 12 <= n AND doc_id > m),
k AS (SELECT p.doc_id, count(*) FILTER (hit.p IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.p) FILTER (hit.p IS NULL) AS kept
    FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.p = hit.p GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
        "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bl AS ({_leads("item_id", "b")}),
bw AS (SELECT DISTINCT item_id, least(n_all, 10) AS n, array_to_string(list_slice(ws, 1, least(n_all, 10)), ' ') AS body FROM bl WHERE p + least(n_all, 10) - 1 <= n_all),
sizes AS (SELECT DISTINCT n FROM bw),
dl AS ({_leads("doc_id", "d")}),
hit AS (SELECT doc_id, p AS s, n, array_to_string(list_slice(ws, 1, n), ' ') AS body FROM dl, sizes
    WHERE p + n - 1 <= n_all AND array_to_string(list_slice(ws, 1, n), ' ') IN (SELECT body FROM bw)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM (SELECT DISTINCT doc_id, body FROM hit) JOIN bw USING (body) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)""",
        "op11_hyperminhash": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) END) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE a.doc_id < b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, b.y FROM reach r JOIN pairs b ON b.x = r.other)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, t.doc_id = min(other) AS kept
FROM t JOIN reach USING (doc_id) LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
    }
