"""The fixture views of :mod:`tessellate.plans.fixtures` as DuckDB SQL.

Each entry is the body of a CTE; :func:`with_views` prefixes a query with the
CTEs it names.  Kept deliberately independent of the Spark code so the oracle
is a second implementation, not a transcription of the same expression tree.
"""

from __future__ import annotations

from .fixtures import FIX_DATASETS, FIX_SPELLINGS


def _lit_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {
    "preds": """
SELECT CASE l_returnflag WHEN 'A' THEN 'chsimsv2' WHEN 'N' THEN 'mosei_senti' ELSE 'meld' END AS dataset,
       CAST((l_partkey + l_linenumber) % 7 AS BIGINT) AS y_true,
       CAST(CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey + l_linenumber) % 7
                 ELSE (l_suppkey + l_linenumber) % 9 END AS BIGINT) AS y_pred
FROM lineitem""",
    "emo_preds": """
SELECT CASE l_returnflag WHEN 'A' THEN 'cremad' WHEN 'N' THEN 'meld_emotion' ELSE 'tess' END AS dataset,
       CAST((l_partkey + l_linenumber) % 7 + 7 AS BIGINT) AS y_true,
       CAST(CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey + l_linenumber) % 7 + 7
                 ELSE (l_suppkey + l_linenumber) % 9 + 7 END AS BIGINT) AS y_pred
FROM lineitem""",
    "binary_preds": """
SELECT d.source AS dataset, CAST(l.quality AS BIGINT) AS y_true, CAST(l.toxic AS BIGINT) AS y_pred
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "samples": """
SELECT doc_id AS sample_id,
       CASE doc_id % 4 WHEN 0 THEN '<audio>' || text WHEN 1 THEN text
            WHEN 2 THEN '<video>' || text || ' <image>' ELSE text || '<audio><audio>' END AS problem,
       CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS answer,
       lang AS ground_truth,
       CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['img/' || doc_id || '.png']
            ELSE ['img/' || doc_id || 'a.png', 'img/' || doc_id || 'b.png'] END AS images,
       CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['vid/' || doc_id || '.mp4']
            ELSE ['vid/' || doc_id || 'a.mp4', 'vid/' || doc_id || 'b.mp4'] END AS videos,
       CASE WHEN doc_id % 2 = 0 THEN
            CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['aud/' || doc_id || '.wav']
                 ELSE ['aud/' || doc_id || 'a.wav', 'aud/' || doc_id || 'b.wav'] END
       END AS audios,
       source AS dataset,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE lang || CASE WHEN doc_id % 5 = 0 THEN '_qa' ELSE '_cls' END END AS task,
       lang AS class_label,
       [lang] AS texts,
       CASE doc_id % 10 WHEN 0 THEN 'text_video' WHEN 1 THEN 'text_image' WHEN 2 THEN 'text_video_audio'
            WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'text_Audio' END AS modality_signature,
       CASE WHEN doc_id % 4 = 1 THEN []::VARCHAR[] ELSE ['vf/' || doc_id || '.pt'] END AS ext_video_feats,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE ['af/' || doc_id || '.pt'] END AS ext_audio_feats,
       n_chars
FROM documents""",
    "label_pairs_in": f"""
SELECT doc_id AS row_id,
       ({_lit_list(FIX_DATASETS)})[doc_id % {len(FIX_DATASETS)} + 1] AS dataset,
       ({_lit_list(FIX_DATASETS)})[doc_id % {len(FIX_DATASETS)} + 1]
         || CASE WHEN doc_id % {len(FIX_DATASETS)} >= 13 THEN '_qa' ELSE '_cls' END AS task,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            ELSE ({_lit_list(FIX_SPELLINGS)})[(doc_id // {len(FIX_DATASETS)}) % {len(FIX_SPELLINGS)} + 1] END AS answer
FROM documents""",
    "responses": """
SELECT conv_id, turn, 'd' || (conv_id % 4) AS dataset,
       CASE turn % 5 WHEN 0 THEN 'chat_cls' WHEN 1 THEN 'chat_qa' WHEN 2 THEN 'chat_q&a'
            WHEN 3 THEN 'Chat_QnA_' ELSE NULL END AS task,
       CASE conv_id % 6
            WHEN 0 THEN '<think>' || text || '</think> \\boxed{' || lower(split_part(text, ' ', 1)) || '}'
            WHEN 1 THEN 'Answer: [' || lower(split_part(text, ' ', 1)) || '] ' || text
            WHEN 2 THEN text || ' <answer>' || lower(split_part(text, ' ', 1)) || '</answer>'
            WHEN 3 THEN '<think>x</think>\\boxed{}' || text
            WHEN 4 THEN '< think >' || text || '< /think >\\boxed{ ' || lower(split_part(text, ' ', 1)) || ' }'
            ELSE text END AS response,
       lower(split_part(text, ' ', 1)) AS truth
FROM conversations""",
    "judge_replies": """
SELECT conv_id, turn, 'd' || (conv_id % 4) AS dataset,
       CASE (conv_id + turn) % 5
            WHEN 0 THEN '{"correct": ' || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END
                        || ', "explanation": "turn ' || turn || '"}'
            WHEN 1 THEN E'```json\\n' || '{"correct": ' || CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END
                        || ', "explanation": "turn ' || turn || '"}' || E'\\n```'
            WHEN 2 THEN 'Verdict: TRUE, turn ' || turn
            WHEN 3 THEN 'no. turn ' || turn
            ELSE '{"explanation": "turn ' || turn || '"}' END AS reply
FROM conversations""",
    "pairs": """
SELECT a.vec_id, a.embedding AS emb_a, a.label, b.embedding AS emb_b
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "rollouts": """
SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS step,
       event_id AS rollout_id,
       date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) || '-' || event_type || '-' || (user_id % 8) AS qid,
       event_type AS task,
       'd' || (user_id % 4) AS dataset,
       [value / 2, value / 2] AS token_rewards,
       CASE event_id % 3 WHEN 0 THEN [1, 1, 0] WHEN 1 THEN [1, 0, 0] ELSE [1, 1, 1] END AS response_mask
FROM events""",
    "frames": """
SELECT CAST(label AS BIGINT) AS sample_id, vec_id AS t, embedding AS feat FROM embeddings""",
    "token_rows": """
SELECT p.conv_id, p.turn,
       list_transform(list_filter(regexp_split_to_array(p.text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS prompt_ids,
       list_transform(list_filter(regexp_split_to_array(r.text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS response_ids
FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1
WHERE p.role = 'user'""",
    "metric_history": """
SELECT run, epoch, f1, n_samples, n_tokens, 1.0 - f1 AS loss FROM (
  SELECT event_type AS run, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
         avg(value) / 500.0 AS f1, count(*) AS n_samples, CAST(sum(length(props)) AS BIGINT) AS n_tokens
  FROM events GROUP BY 1, 2)""",
    "scores": """
SELECT vec_id, embedding[1:25] AS scores, CAST(label % 7 AS BIGINT) AS domain_id FROM embeddings""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (names of base
    tables are skipped); ``sql`` may continue the WITH list with ``, x AS``."""
    known = [n for n in names if n in VIEWS]
    body = sql.lstrip()
    if not known:
        return "WITH " + body[1:].lstrip() if body.startswith(",") else sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in known)
    return f"WITH {ctes}\n{sql}"


def _scheme_views() -> dict[str, str]:
    from .. import scheme
    gc = ", ".join(f"({i}, {d}, '{dom}', '{lab}')" for i, d, dom, lab in scheme.global_classes_rows())
    d_ids = {d: i for i, (d, _) in enumerate(scheme.DOMAINS)}
    dd = ", ".join(f"('{ds}', '{dom}', {d_ids[dom]})" for ds, dom in scheme.DATASET_DOMAIN.items())
    syn = [("sentiment_intensity", k, v) for k, v in scheme.SENTIMENT_SYNONYMS.items()]
    syn += [("emotion", k, v) for k, v in scheme.EMOTION_SYNONYMS.items()]
    sy = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in syn)
    return {
        "gclass": f"SELECT CAST(c0 AS BIGINT) AS global_index, CAST(c1 AS BIGINT) AS domain_id, "
                  f"c2 AS domain, c3 AS label FROM (VALUES {gc}) t(c0, c1, c2, c3)",
        "dsdomain": f"SELECT c0 AS dataset, c1 AS domain, CAST(c2 AS BIGINT) AS domain_id "
                    f"FROM (VALUES {dd}) t(c0, c1, c2)",
        "synonyms": f"SELECT c0 AS domain, c1 AS raw_low, c2 AS canonical FROM (VALUES {sy}) t(c0, c1, c2)",
    }


VIEWS.update(_scheme_views())
