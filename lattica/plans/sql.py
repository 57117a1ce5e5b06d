"""Expressions that several modules of queries use."""

from __future__ import annotations

from lattica.functions.text import STOP_WORDS

STOP = ",".join(f"'{w}'" for w in STOP_WORDS)
TOK = rf"list_filter(string_split_regex(lower(x),'[^\p{{L}}\p{{N}}]+'), lambda w: w<>'' AND w NOT IN ({STOP}))"
POSTINGS = f"""post AS MATERIALIZED (SELECT note_id, term, col, count(*) AS cnt FROM (SELECT id AS note_id, col, unnest({TOK}) AS term FROM (SELECT id, 'title' AS col, title AS x FROM notes UNION ALL SELECT id, 'body', body FROM notes UNION ALL SELECT id, 'tags', array_to_string(tags,' ') FROM notes)) GROUP BY ALL),
wpost AS (SELECT *, cnt*CASE col WHEN 'title' THEN 2.0::DOUBLE WHEN 'tags' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS wc FROM post), tf AS MATERIALIZED (SELECT note_id, term, sum(wc) AS tf FROM wpost GROUP BY ALL)"""
