"""Queries of this package, each over its whole table, and their SQL where DuckDB can express it."""

from __future__ import annotations

from . import bpe, classifier, dedup, langid, media, mixing, quality_rules, secrets, sharding, warc

QUERIES = {
    "op1_site_classifier": classifier.query,
    "op2_warc_index": warc.query,
    "op3_sketch_dedup": dedup.query,
    "op4_language_spans": langid.query,
    "op5_bpe_codec": bpe.query,
    "op6_wav_fingerprints": media.query,
    "op7_secret_scan": secrets.query,
    "op8_robust_outliers": quality_rules.query,
    "op9_byte_shards": sharding.query,
    "op10_source_mix": mixing.query,
}

#: All pairs that share a shingle, and the closure of those that are similar.
DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN low ON low.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

ORACLES: dict[str, str] = {
    "op2_warc_index": warc.ORACLE,
    "op3_sketch_dedup": DEDUP,
}
