"""Flagship: documents → cleaned, filtered, encoded, sorted, batched report."""

from vocable.plans import flagship as fl
from vocable.plans.catalog.sqlbits import SAMPLES, sql_basic_clean
from vocable.plans.registry import register

FLAGSHIP_SQL = f"""
WITH s AS ({SAMPLES}),
k AS (
  SELECT doc_id, audio_length, {sql_basic_clean('text')} AS clean FROM s
  WHERE text_length BETWEEN {fl.MIN_TEXT_LEN} AND {fl.MAX_TEXT_LEN}
    AND audio_length BETWEEN {fl.MIN_AUDIO_LEN} AND {fl.MAX_AUDIO_LEN}
),
ch AS (SELECT DISTINCT unnest(string_split(clean, '')) AS c FROM k),
corp AS (SELECT c FROM ch WHERE c <> '' AND c NOT IN ('!', '''', '(', ')', ',', '-', '.', ':', ';', '?', ' ',
                                                   '<PAD>', '<EOS>', '<BOS>', '<BLNK>')),
nc AS (SELECT count(*) AS n FROM corp),
v AS (
  SELECT c, 3 + row_number() OVER (ORDER BY c) AS id FROM corp
  UNION ALL
  SELECT p.c, 4 + nc.n + p.k AS id
  FROM (SELECT * FROM (VALUES ('!', 0), ('''', 1), ('(', 2), (')', 3), (',', 4), ('-', 5), ('.', 6),
                              (':', 7), (';', 8), ('?', 9), (' ', 10)) t(c, k)) p, nc
),
e AS (SELECT doc_id, unnest(string_split(clean, '')) AS c FROM k),
per_doc AS (
  SELECT k.doc_id, k.audio_length,
         coalesce(sum(v.id), 0) AS id_sum, count(v.id) AS n_ids
  FROM k LEFT JOIN e ON e.doc_id = k.doc_id LEFT JOIN v ON v.c = e.c
  GROUP BY k.doc_id, k.audio_length
),
b AS (SELECT *, (row_number() OVER (ORDER BY audio_length, doc_id) - 1) // {fl.BATCH_SIZE} AS batch_id FROM per_doc)
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n_rows, CAST(max(n_ids) AS BIGINT) AS max_len,
       CAST(sum(n_ids) AS BIGINT) AS sum_len, count(*) * max(n_ids) AS padded_cells,
       round(1.0 - sum(n_ids) / (count(*) * max(n_ids)), 6) AS padding_ratio,
       CAST(sum(id_sum) AS BIGINT) AS id_sum
FROM b GROUP BY batch_id
"""


@register("g3_flagship_batches", FLAGSHIP_SQL)
def flagship_batches(spark, sf_dir):
    return fl.batch_report(spark, sf_dir)
