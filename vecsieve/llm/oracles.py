"""DuckDB SQL that states the operators' results from their contracts alone."""

from __future__ import annotations

from .chat import BODY, END, TURN

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    g AS (SELECT doc_id, o, substr(x, 2 * o + 1, 998) AS x FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199, 300)) AS o FROM d WHERE len(x) >= 400)),
    w AS (SELECT doc_id, o + i AS i, substr(x, 2 * i + 1, 400) AS s FROM (SELECT doc_id, o, x, unnest(range(len(x) // 2 - 199)) AS i FROM g)),
    h AS (SELECT doc_id, i, md5_number(s) AS s FROM w), again AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
    p AS (SELECT doc_id, i, i > lag(i) OVER o + 200 OR lag(i) OVER o IS NULL AS new FROM h JOIN again USING (s) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
    cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
    kept AS (SELECT doc_id, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS n FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    rep AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)),
    reps AS (SELECT doc_id, count(DISTINCT place) AS n FROM rep GROUP BY 1),
    b AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, len(list_filter(w, lambda x: x LIKE '%!')) AS marks
        FROM d JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
    f AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * up > up + low OR 10 * marks > 3 * n_words) AS kept FROM f"""

#: For tables that make one leaf, up to 1,024 documents.
OP5 = rf"""
    WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
    l AS (SELECT *, 3 * source_size::DOUBLE / weight AS ratio FROM s),
    lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM l WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM lev WHERE level <= ratio) * weight, 3.0::DOUBLE * source_size)) AS target FROM lev),
    seats AS (SELECT round(sum(target) / 32)::BIGINT AS n FROM t),
    won AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place FROM t, (SELECT unnest(range((SELECT n FROM seats))) AS k)) WHERE place <= (SELECT n FROM seats) GROUP BY source),
    due AS (SELECT t.*, CASE WHEN target >= 3 * source_size THEN 3 * source_size ELSE least(32 * coalesce(quota, 0), 3 * source_size) END AS due FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source),
    o AS (SELECT d.*, source_size, target, due, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('17-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN due ON d.source IS NOT DISTINCT FROM due.source)
    SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (due // source_size) * size + greatest(0, least(size, due % source_size - before)) END)::BIGINT AS taken FROM o"""

OP7 = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, len(regexp_extract_all(role || chr(0) || text, '<\\*\|')) AS more FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum({len(TURN + BODY + END)} + length(role) + length(text) + more)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

OP9 = rf"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    win AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
    late AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM win),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late WHERE again),
    each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
