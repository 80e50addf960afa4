"""The views of ``sources/views.py`` as common table expressions."""

from __future__ import annotations

import re

from ..schema import FACETS, STAGE_NAMES, STAGES, TOPICS


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_COMPAT = "CASE WHEN {s} BETWEEN 0 AND 5 THEN [CASE WHEN k = {s} THEN 1.0::DOUBLE WHEN abs(k - {s}) = 1 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(6)] ELSE [0.35::DOUBLE FOR k IN range(6)] END"

VIEWS = {
    "chunks": f"""
  SELECT doc_id, 'C' || lpad(doc_id::VARCHAR, 6, '0') AS chunk_id, text, {_list(TOPICS)}[(doc_id % 9) + 1] AS topic,
    {_COMPAT.format(s='(doc_id % 7)')} AS compat, ((doc_id * 37) % 101) / 100.0::DOUBLE AS authority_score,
    {_list((*FACETS, 'general'))}[((doc_id // 9) % 5) + 1] AS facet, source AS source_id,
    CASE WHEN quality = 1 THEN 'reviewed' WHEN quality = 0 THEN 'machine_curated_pending_domain_review' ELSE 'unreviewed' END AS review_status,
    coalesce(quality, 0) = 1 AS production_eligible, coalesce(toxic, 0) = 1 AS restricted_action,
    CASE WHEN doc_id % 4 = 0 THEN []::VARCHAR[] ELSE ['r' || (doc_id % 3)::VARCHAR] END AS region,
    CASE WHEN doc_id % 5 = 0 THEN ['general'] WHEN doc_id % 5 = 1 THEN []::VARCHAR[] ELSE ['v' || (doc_id % 2)::VARCHAR] END AS varieties,
    lang AS language
  FROM documents LEFT JOIN labels USING (doc_id)""",
    "logits": """
  SELECT vec_id, (label % 6)::INTEGER AS truth,
    [10.0 * embedding[k + 1]::DOUBLE + CASE WHEN label % 6 = k AND vec_id % 4 <> 0 THEN 2.5 ELSE 0.0 END FOR k IN range(6)] AS logits,
    CASE WHEN vec_id % 5 = 0 THEN 'validation' WHEN vec_id % 5 = 1 THEN 'test' ELSE 'train' END AS split
  FROM embeddings WHERE embedding IS NOT NULL""",
    "exps": "SELECT *, [exp(v - list_max(logits)) FOR v IN logits] AS e FROM logits",
    "beliefs": """
  SELECT vec_id, truth, logits, split, [v / list_sum(e) FOR v IN e] AS belief,
    (list_position(e, list_max(e)) - 1)::INTEGER AS predicted, list_max(e) / list_sum(e) AS confidence FROM exps""",
    "manifest": f"""
  SELECT vec_id, 'img' || lpad(vec_id::VARCHAR, 6, '0') AS image_id,
    's' || label::VARCHAR || '/p' || lpad((vec_id // 3)::VARCHAR, 5, '0') || '_subset_overlap_' || (vec_id % 3)::VARCHAR || '.jpg' AS image_path,
    'p' || lpad((vec_id // 3)::VARCHAR, 5, '0') AS parent_image_id, label::VARCHAR AS capture_session,
    {_list(STAGE_NAMES)}[(label % 6) + 1] AS macro_stage FROM embeddings""",
    "hashes": """
  SELECT vec_id, label, [CASE WHEN v::DOUBLE > list_sum([w::DOUBLE FOR w IN embedding]) / len(embedding) THEN 1 ELSE 0 END FOR v IN embedding] AS bits FROM embeddings""",
    "pairs": """
  SELECT a.vec_id AS a, b.vec_id AS b, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.bits, b.bits)])::INTEGER AS distance
  FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id""",
    "queries": f"SELECT item_id AS query_id, text AS query, {_list(TOPICS)}[(item_id % 9) + 1] AS topic FROM benchmark",
    "tokens": """
  SELECT chunk_id, topic, unnest(regexp_extract_all(lower(text), '([0-9A-Za-zÀ-ỹĐđ]+)', 1)) AS term FROM chunks""",
    "lengths": "SELECT chunk_id, len(regexp_extract_all(lower(text), '([0-9A-Za-zÀ-ỹĐđ]+)', 1))::BIGINT AS dl FROM chunks",
    "posts": "SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM tokens JOIN lengths USING (chunk_id) GROUP BY ALL",
    "idfs": """
  SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts GROUP BY term""",
    "qterms": """
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '([0-9A-Za-zÀ-ỹĐđ]+)', 1)) AS term FROM queries) GROUP BY ALL""",
    "bm25": """
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lengths)))), 6) AS bm25
  FROM posts JOIN idfs USING (term) JOIN qterms USING (term) GROUP BY ALL""",
    "eligible": """
  SELECT q.query_id, c.chunk_id FROM queries q JOIN chunks c
  ON c.topic IN (q.topic, 'general_crop_care') OR NOT EXISTS (SELECT 1 FROM chunks x WHERE x.topic IN (q.topic, 'general_crop_care'))""",
    "lexical": """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id)::INTEGER AS bm25_rank
  FROM (SELECT query_id, chunk_id, coalesce(bm25, 0.0) AS bm25 FROM eligible LEFT JOIN bm25 USING (query_id, chunk_id)) QUALIFY bm25_rank <= 50""",
    "units": """
  SELECT vec_id, CASE WHEN n > 0 THEN [x / n FOR x IN v] ELSE [0.0::DOUBLE FOR x IN v] END AS u
  FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings))""",
    "dense": """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INTEGER AS dense_rank FROM (
    SELECT q.query_id, c.chunk_id, round(list_dot_product(a.u, b.u), 6) AS cosine
    FROM queries q JOIN units a ON a.vec_id = q.query_id JOIN chunks c ON true JOIN units b ON b.vec_id = c.doc_id
    JOIN eligible e ON e.query_id = q.query_id AND e.chunk_id = c.chunk_id) QUALIFY dense_rank <= 50""",
    "fused": """
  SELECT query_id, chunk_id, max(b) AS bm25_rank, max(d) AS dense_rank, coalesce(1.0::DOUBLE / (60 + max(b)), 0) + coalesce(1.0::DOUBLE / (60 + max(d)), 0) AS rrf
  FROM (SELECT query_id, chunk_id, bm25_rank AS b, NULL::INTEGER AS d FROM lexical UNION ALL SELECT query_id, chunk_id, NULL, dense_rank FROM dense) GROUP BY ALL""",
    "based": """
  SELECT f.*, CASE WHEN max(rrf) OVER w - min(rrf) OVER w <= 1e-12 THEN 1.0 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END AS base
  FROM fused f WINDOW w AS (PARTITION BY query_id)""",
    "asked": """
  SELECT b.*, c.compat, c.authority_score, c.restricted_action, v.belief, v.confidence, v.predicted, v.truth
  FROM based b JOIN chunks c USING (chunk_id) JOIN beliefs v ON v.vec_id = b.query_id""",
}
#: The same retrieval for queries that name the predicted stage: its views have names in "_x".
VIEWS |= {
    "queries_x": f"""
  SELECT query_id, topic, predicted, 'Rice ' || replace(topic, '_', ' ') || ' evidence applicable to ' || {_list(d for _, d, _ in STAGES)}[predicted + 1] || ', BBCH ' || {_list(b for _, _, b in STAGES)}[predicted + 1] || '.' AS query
  FROM queries JOIN beliefs ON vec_id = query_id""",
    "lexical_x": VIEWS["lexical"].replace("FROM eligible LEFT JOIN bm25", "FROM eligible SEMI JOIN queries_x USING (query_id) LEFT JOIN bm25_x"),
    "asks_x": """
  SELECT query_id, topic, CASE WHEN n > 0 THEN [x / n FOR x IN v] ELSE v END AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (
    SELECT query_id, topic, list_transform(embedding, lambda x, i: x::DOUBLE + (i = predicted + 1)::INT) AS v FROM queries_x JOIN embeddings ON vec_id = query_id))""",
    "dense_x": """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INTEGER AS dense_rank FROM (
    SELECT a.query_id, c.chunk_id, round(list_dot_product(a.u, b.u), 6) AS cosine
    FROM asks_x a JOIN chunks c ON true JOIN units b ON b.vec_id = c.doc_id
    JOIN eligible e ON e.query_id = a.query_id AND e.chunk_id = c.chunk_id) QUALIFY dense_rank <= 50""",
}
for _name in ("qterms", "bm25", "fused", "based", "asked"):
    VIEWS[f"{_name}_x"] = re.sub(r"\b(FROM|JOIN) (queries|qterms|lexical|dense|fused|based)\b", r"\1 \2_x", VIEWS[_name])
#: Which views a view needs.
_NEEDS = {
    "exps": ["logits"], "beliefs": ["exps"], "pairs": ["hashes"], "tokens": ["chunks"], "lengths": ["chunks"], "posts": ["tokens", "lengths"], "idfs": ["posts", "chunks"],
    "qterms": ["queries"], "bm25": ["posts", "idfs", "qterms", "lengths"], "eligible": ["queries", "chunks"], "lexical": ["eligible", "bm25"], "dense": ["queries", "units", "chunks", "eligible"],
    "fused": ["lexical", "dense"], "based": ["fused"], "asked": ["based", "chunks", "beliefs"],
    "queries_x": ["queries", "beliefs"], "qterms_x": ["queries_x"], "bm25_x": ["posts", "idfs", "qterms_x", "lengths"], "lexical_x": ["eligible", "queries_x", "bm25_x"], "asks_x": ["queries_x"],
    "dense_x": ["asks_x", "units", "chunks", "eligible"], "fused_x": ["lexical_x", "dense_x"], "based_x": ["fused_x"], "asked_x": ["based_x", "chunks", "beliefs"],
}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    # materialised, as most are used more than once
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n not in ('tokens',) else ''}({VIEWS[n]})" for n in order) + "\n" + sql
