"""The same results as DuckDB SQL, where SQL can express them: plain comparisons of everything with everything."""

from __future__ import annotations

import re

from lendscope.llm import fingerprints
from lendscope.llm.license_scan import GAP, MIN_COVER, NEAR, PHRASES, SEPARATORS, TEMPLATES
from lendscope.llm.line_chunks import DIVISOR
from lendscope.llm.nra_search import TERM, TOP
from lendscope.llm.secret_ledger import BASE, EITHER_CASE, RULES

#: A-Z to a-z alone; lower() would change other letters too.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS shingle
    FROM split
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * c >= 80 * (a.n + b.n - c)
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id
GROUP BY r.doc_id
"""

LATTICE_HASHING = """
WITH RECURSIVE fine AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x for x in embedding if x <> 0]) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b
    ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
degrees AS (SELECT x, count(*) AS n FROM edges GROUP BY x),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, e.y FROM reached r JOIN edges e ON e.x = r.other
),
named AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM named c LEFT JOIN degrees d ON d.x = c.vec_id
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_pattern(kind: str) -> str:
    """The rule's pattern with ASCII letters in either case spelled out, as RE2 would fold others too."""
    pattern = RULES[kind][1].replace(r"\s", r"\x09-\x0D\x20")
    if kind not in EITHER_CASE:
        return pattern
    end = pattern.index(")")
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern[:end]) + pattern[end:]


def secret_spans(rank: int, kind: str) -> str:
    """Spans of one kind: a match starts after the gaps and matches before it."""
    pattern, (_, _, _, group, least) = quoted(secret_pattern(kind)), RULES[kind]
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(f.start AS BIGINT) AS start, CAST(f.start + length(f.found) AS BIGINT) AS stop
    FROM (
        SELECT doc_id, unnest([{{'found': m[k],
            'start': list_sum([length(x) for x in g[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0)}}
            for k in range(1, len(m) + 1)]) AS f
        FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, string_split_regex(t, {pattern}) AS g FROM docs)
        WHERE len(m) > 0
    )
    WHERE length(regexp_extract(f.found, {pattern}, {group})) >= {least}"""


def shown(where: str = "true") -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER ({where}), '')"


SECRET_LEDGER = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(secret_spans(i, kind) for i, kind in enumerate(RULES))}),
counted AS (
    SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
        {shown(f"rank < {len(BASE)}")} AS base, {shown("rank IS NOT NULL")} AS spans
    FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT * EXCLUDE (base), sha256(base) AS base_sha256 FROM counted
"""


def template_values() -> str:
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        rows += [
            f"({number}, '{label}', {str(text in PHRASES).lower()}, {len(words) - 1}, {at}, '{a}', '{b}')"
            for at, (a, b) in enumerate(zip(words, words[1:]))
        ]
    return ", ".join(rows)


LICENSE_DIAGONALS = rf"""
WITH templates(template, label, phrase, pairs, place, w, v) AS (VALUES {template_values()}),
split AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
placed AS (
    SELECT doc_id, unnest([{{'pos': i - 1, 'w': words[i], 'v': words[i + 1]}} for i in range(1, len(words))], recursive := true) FROM split
),
votes AS (
    SELECT doc_id, template, label, phrase, pairs, pos - place AS diagonal, min(pos) AS low, max(pos) AS high, list(DISTINCT place) AS ats
    FROM placed JOIN templates USING (w, v) GROUP BY ALL
),
opened AS (
    SELECT *, coalesce(abs(diagonal - lag(diagonal) OVER o) > {NEAR} OR low - lag(high) OVER o > {GAP}, true) AS opens
    FROM votes WHERE NOT phrase WINDOW o AS (PARTITION BY doc_id, template ORDER BY low, diagonal)
),
numbered AS (
    SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id, template ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM opened
),
places AS (
    SELECT doc_id, label, true AS phrase, diagonal AS start, 1.0::DOUBLE AS cover FROM votes WHERE phrase AND len(ats) = pairs
    UNION ALL
    SELECT doc_id, label, false, min(low), len(list_distinct(flatten(list(ats)))) / pairs::DOUBLE
    FROM numbered GROUP BY doc_id, template, label, pairs, span
),
found AS (
    SELECT doc_id, count(DISTINCT (label, start)) FILTER (phrase) AS n_base,
        min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase OR cover >= {MIN_COVER}) AS labels, max(cover) AS score
    FROM places GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
    CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, least(coalesce(score, 0), 1.0::DOUBLE) AS score
FROM split s LEFT JOIN found f ON f.doc_id = s.doc_id
"""

LINE_CHUNKS = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM split
),
hashed AS (SELECT *, CAST('0x' || left(md5(line), 8) AS BIGINT) AS h FROM lines),
ended AS (
    SELECT *, i = n OR coalesce((31 * lag(h) OVER o + h) % {DIVISOR} = 0, false) AS ends
    FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
    FROM ended
),
chunks AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS k FROM numbered GROUP BY doc_id, no),
marked AS (SELECT *, k > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) > 1 AS gone FROM chunks)
SELECT doc_id, CAST(sum(k) AS INT) AS n_lines, CAST(count(*) AS INT) AS n_chunks,
    CAST(coalesce(sum(k) FILTER (gone), 0) AS INT) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""

NRA_SEARCH = rf"""
WITH doc_words AS (
    SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM documents
),
item_words AS (
    SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark
),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_words GROUP BY doc_id),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM item_words GROUP BY item_id, term),
postings AS (SELECT doc_id, term, count(*) AS tf FROM doc_words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, sizes GROUP BY term, total
),
scores AS (
    SELECT item_id, doc_id,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length)))) AS BIGINT) AS score
    FROM postings JOIN lengths USING (doc_id) JOIN weights USING (term) JOIN asked USING (term), sizes
    GROUP BY item_id, doc_id
),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""

def _fingerprints() -> str:
    """Every sample as a column of one aggregate over the words of each text."""
    numbers = fingerprints.multipliers()
    k = range(fingerprints.SAMPLES)
    least = ", ".join(f"min({fingerprints.sample_sql(numbers, 'lw')}) & 2147483647 AS s{i}" for i in k)
    digest = " || ".join(f"printf('%08X', s{i})" for i in k)
    same = lambda a, b: " + ".join(f"CAST({a}.s{i} = {b}.s{i} AS INT)" for i in k)
    near = lambda a, b: (
        f"CASE WHEN {a}.s0 IS NULL AND {b}.s0 IS NULL THEN 1.0 WHEN {a}.s0 IS NULL OR {b}.s0 IS NULL THEN 0.0 "
        f"ELSE ({same(a, b)}) / {fingerprints.SAMPLES}.0 END"
    )
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
turned AS (
    SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
    FROM texts WINDOW w AS (ORDER BY doc_id)
),
pairs AS (
    SELECT *, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM turned
),
bodies AS (SELECT doc_id, 0 AS variant, text AS body FROM pairs UNION ALL SELECT doc_id, 1, edited FROM pairs),
words AS (
    SELECT doc_id, variant, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
    FROM bodies
),
counted AS (SELECT doc_id, variant, word, count(*) AS tf FROM words GROUP BY ALL),
hashed AS (SELECT doc_id, variant, ln(tf) AS lw, CAST('0x' || substring(md5(word), 1, 15) AS BIGINT) AS hash FROM counted),
drawn AS (SELECT doc_id, variant, lw, hash >> 30 AS x, hash & 1073741823 AS y FROM hashed),
least AS (SELECT doc_id, variant, {least} FROM drawn GROUP BY doc_id, variant),
signed AS (SELECT b.doc_id, b.variant, l.* EXCLUDE (doc_id, variant), {digest} AS digest
    FROM bodies b LEFT JOIN least l ON l.doc_id = b.doc_id AND l.variant = b.variant)
SELECT p.doc_id, CAST(p.n AS BIGINT) AS n_chars, sha256(p.edited) AS edited_sha256,
    coalesce(o.digest, '') AS fingerprint, coalesce(e.digest, '') AS edited_fingerprint,
    CAST({near("o", "e")} AS DOUBLE) AS near_edited, CAST({near("o", "f")} AS DOUBLE) AS near_next
FROM pairs p JOIN signed o ON o.doc_id = p.doc_id AND o.variant = 0
JOIN signed e ON e.doc_id = p.doc_id AND e.variant = 1
JOIN signed f ON f.doc_id = p.next_id AND f.variant = 0
"""


ORACLE: dict[str, str] = {
    "op1_secret_ledger": SECRET_LEDGER,
    "op2_license_diagonals": LICENSE_DIAGONALS,
    "op3_jaccard_join": JACCARD_JOIN,
    "op4_lattice_hashing": LATTICE_HASHING,
    "op6_line_chunks": LINE_CHUNKS,
    "op11_nra_search": NRA_SEARCH,
    "op13_weighted_sampling": _fingerprints(),
}
