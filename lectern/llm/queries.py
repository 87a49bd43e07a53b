"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm.decontamination import op4_decontamination
from lectern.llm.embedding_dedup import op8_embedding_dedup
from lectern.llm.hard_negatives import op12_hard_negatives
from lectern.llm.jaccard_join import op10_jaccard_join
from lectern.llm.language_id import op3_language_id
from lectern.llm.license_scan import op6_license_scan
from lectern.llm.line_dedup import op1_line_dedup
from lectern.llm.perplexity import op5_quality
from lectern.llm.pieces import op7_sentencepiece
from lectern.llm.source_mix import op13_source_mix
from lectern.llm.spelling_groups import op11_spelling_groups
from lectern.llm.suffix_dedup import op2_suffix_dedup
from lectern.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mix": op13_source_mix,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The smallest id that each node reaches over links (a, b), both ways; nodes without links reach themselves.
_REACH = "reach AS (SELECT a AS node, a AS goal FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.goal), least AS (SELECT node, min(goal) AS component FROM reach GROUP BY 1)"

#: Only what SQL can express on whole tables; the others are tested against brute force, held-out accuracy or a round trip.
ORACLES: dict[str, str] = {
    "op8_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.95), {_REACH}
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) c ON c.a = vec_id""",
    "op10_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), both AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM both JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)), {_REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON node = d.doc_id""".replace(" both AS (", " pairs AS MATERIALIZED (").replace("FROM both JOIN", "FROM pairs JOIN"),
    "op12_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, list_dot_product(a.q, r.q)::BIGINT AS score, a.label = r.label AS same FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10""",
}
