"""Oracle SQL fragments shared by several registered queries (DuckDB dialect)."""

from vocable.functions.text import WS

# Whitespace class as RE2 reads it (same string as the Spark one).
SQL_WS = WS


def sql_basic_clean(expr: str) -> str:
    return (f"regexp_replace(regexp_replace(lower({expr}), '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g')")


SAMPLES = f"""
SELECT doc_id, text, lang AS language, source AS speaker_name, '/data' AS root_path,
       '/data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_file,
       'docs#' || source || '/' || CAST(doc_id AS VARCHAR) AS audio_unique_name,
       n_chars AS audio_length,
       CAST(len(string_split(text, ' ')) AS BIGINT) AS text_length
FROM documents
"""
