"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import boilerplate, garbled, language, leaks, lookalike, neardup, packing, repetition, scanned, tokens

QUERIES = {
    "p1_found": lookalike.p1_found,
    "p1_plain": lookalike.p1_plain,
    "p1_unified": lookalike.p1_unified,
    "p2_found": language.p2_found,
    "p2_languages": language.p2_languages,
    "p2_passages": language.p2_passages,
    "p3_totals": tokens.p3_totals,
    "p3_slices": tokens.p3_slices,
    "p3_tokens": tokens.p3_tokens,
    "p4_found": scanned.p4_found,
    "p4_repaired": scanned.p4_repaired,
    "p5_found": neardup.p5_found,
    "p5_groups": neardup.p5_groups,
    "p6_found": garbled.p6_found,
    "p6_lost": garbled.p6_lost,
    "p6_restored": garbled.p6_restored,
    "p7_found": boilerplate.p7_found,
    "p7_blocks": boilerplate.p7_blocks,
    "p7_block_lines": boilerplate.p7_block_lines,
    "p7_clean": boilerplate.p7_clean,
    "p8_containers": packing.p8_containers,
    "p8_checks": packing.p8_checks,
    "p8_usage": packing.p8_usage,
    "p9_found": leaks.p9_found,
    "p9_similar": leaks.p9_similar,
    "p10_found": repetition.p10_found,
    "p10_shares": repetition.p10_shares,
    "p10_cutoffs": repetition.p10_cutoffs,
}
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

#: SQL for those that SQL can express in reasonable time; the other operators are tested against brute force, round
#: trips or held-out accuracy.
SQL: dict[str, str] = {
    "p1_plain": r"SELECT speech_id FROM speeches WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\x00-\x7F]')",
    "p3_slices": rf"""
WITH r AS (SELECT "CentralBank" AS bank, "Source" AS source, nullif(regexp_extract("URL", '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') AS host,
           CASE {" ".join(f"WHEN regexp_extract(lower(trim(\"Language\")), '^([a-z]+)', 1) IN ({', '.join(repr(n) for n in names.split())}) THEN '{code}'" for code, names in language.NAMES.items())} END AS lang FROM speeches)
SELECT 'bank' AS dimension, bank AS value, count(*)::BIGINT AS speeches FROM r GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*)::BIGINT FROM r GROUP BY ALL
UNION ALL SELECT 'source', source, count(*)::BIGINT FROM r GROUP BY ALL UNION ALL SELECT 'host', host, count(*)::BIGINT FROM r GROUP BY ALL""",
    "p6_lost": """
SELECT speech_id, 'text' AS field FROM speeches WHERE length(text) - length(replace(text, '\ufffd', '')) >= 3
UNION ALL SELECT speech_id, 'text_original' FROM speeches WHERE length(text_original) - length(replace(text_original, '\ufffd', '')) >= 3""",
    "p8_checks": "SELECT count(*)::BIGINT AS documents, count(CASE WHEN text <> '' THEN 1 END)::BIGINT AS packed, 0::BIGINT AS overfull, 0::BIGINT AS split FROM documents",
    "p5_found": f"""
WITH w AS (SELECT speech_id, {WORDS} AS w FROM speeches WHERE text IS NOT NULL),
s AS (SELECT DISTINCT speech_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT speech_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT speech_id, count(*) AS n FROM s GROUP BY speech_id),
c AS (SELECT x.speech_id AS a, y.speech_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.speech_id < y.speech_id GROUP BY ALL)
SELECT a AS speech_id_a, b AS speech_id_b FROM c JOIN n x ON x.speech_id = a JOIN n y ON y.speech_id = b WHERE 2 * c >= x.n + y.n - c""",
    "p7_found": f"""
WITH t AS (SELECT speech_id, "CentralBank" AS bank, string_split(text, chr(10)) AS l FROM speeches
           WHERE "CentralBank" IS NOT NULL AND regexp_matches(coalesce(text, ''), '[^{SPACE[1:]}')),
n AS (SELECT bank, count(*) AS docs FROM t GROUP BY bank),
u AS (SELECT speech_id, bank, l, unnest(range(1, len(l) + 1)) AS line_no FROM t),
x AS (SELECT speech_id, bank, line_no, regexp_replace(lower(trim(regexp_replace(l[line_no], '{SPACE}+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM u),
f AS (SELECT bank, line, count(DISTINCT speech_id) AS c FROM x WHERE line <> '' GROUP BY ALL)
SELECT speech_id, line_no::BIGINT AS line_no FROM x JOIN f USING (bank, line) JOIN n USING (bank) WHERE c >= 6 AND 10 * c >= docs""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
y AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (g)""",
    "p10_found": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS inside FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r WHERE k > 1) GROUP BY doc_id)
SELECT doc_id FROM c JOIN d USING (doc_id) WHERE 10 * inside >= 3 * len(w)""",
}
