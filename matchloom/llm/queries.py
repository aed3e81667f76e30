"""Queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from matchloom.llm.bpe_codec import op9_bpe_codec
from matchloom.llm.chat_quotes import op8_chat_quotes
from matchloom.llm.dart_dedup import op10_minhash_dedup
from matchloom.llm.langid import op5_language_id
from matchloom.llm.pii import op6_pii
from matchloom.llm.quality_qda import op1_quality_classifier
from matchloom.llm.quality_rules import op7_quality_rules
from matchloom.llm.rlz_dedup import op4_rlz_dedup
from matchloom.llm.suffix_dedup import op2_suffix_dedup
from matchloom.llm.tiling_decontam import op3_tiling_decontam

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_suffix_dedup, op3_tiling_decontam, op4_rlz_dedup, op5_language_id, op6_pii, op7_quality_rules, op8_chat_quotes, op9_bpe_codec, op10_minhash_dedup)}

ORACLES = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, md5(substring(h, 2 * i::BIGINT + 1, 400)) AS k FROM d, unnest(range(0, greatest(n - 199, 0))) AS t(i)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (k)),
run AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM hit),
gone AS (SELECT doc_id, no, min(i) AS s, max(i) + 200 AS e FROM run GROUP BY doc_id, no),
gap AS (SELECT doc_id, no, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY no), 0) AS s, s AS e FROM gone),
kept AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(g.e - g.s)::BIGINT AS before, string_agg(substring(h, 2 * g.s::BIGINT + 1, 2 * (g.e - g.s)::BIGINT), '' ORDER BY no) AS x FROM gap AS g JOIN d USING (doc_id) GROUP BY doc_id),
tail AS (SELECT doc_id, max(e)::BIGINT AS e, sum(e - s)::BIGINT AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN e IS NULL THEN h ELSE x || substring(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN tail USING (doc_id)
""",
    "op4_rlz_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS t(i)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS places FROM win SEMI JOIN twice USING (h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, j: NOT coalesce(list_contains(places, j::BIGINT), false)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
}
