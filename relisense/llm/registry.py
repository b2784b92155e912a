"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relisense.llm import bpe, decontaminate, filter_audit, html_text, langid, neardup, packing, pii, quality, sharding, token_counts, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_html_text": html_text.op2_html_text,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_sharding": sharding.op5_sharding,
        "op6_near_dedup": neardup.op6_near_dedup,
        "op7_language_id": langid.op7_language_id,
        "op8_pii": pii.op8_pii,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_warc": warc.op10_warc,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_bpe": bpe.op12_bpe,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Near-duplicates by brute force: all pairs that share a shingle, then the transitive closure.
_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = c.doc_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""
_WARC = """
WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS k FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN page_id < k THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < k THEN k END AS refers_to
FROM q LEFT JOIN m ON q.payload_digest = m.payload_digest AND payload_bytes >= 1000"""


def oracle_sql() -> dict[str, str]:
    """The others hash, tokenise or fit in ways that SQL has no words for; tests hold them against brute force."""
    return {"op6_near_dedup": _NEAR, "op10_warc": _WARC, "op11_vector_codes": vector_codes.SQL, "op13_filter_audit": filter_audit.SQL}
