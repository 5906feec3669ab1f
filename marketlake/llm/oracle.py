"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from marketlake.llm import filter_audit, source_divergence
from marketlake.llm import quality_rules as rules

_SPACE = r"[\x20\x09-\x0D]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _distance(one: str, other: str) -> str:
    """Jensen-Shannon distance of two lists of counts; NULL if one adds up to nothing."""
    p, q = f"({one}[i] / list_sum({one}))", f"({other}[i] / list_sum({other}))"
    middle = f"(({p} + {q}) / 2)"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {middle}) ELSE 0 END"
    total = f"list_sum(list_transform(range(1, len({one}) + 1), lambda i: {term(p)} + {term(q)}))"
    known = f"list_sum({one}) > 0 AND list_sum({other}) > 0"
    return f"CASE WHEN {known} THEN sqrt(greatest({total} / 2, 0)) END"


_LISTED = (
    "CASE lang "
    + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in rules.COMMON_WORDS.items())
    + " END"
)
_CLASSES = len(rules.CLASSES)
_SUMS = ", ".join(f"sum(classes[{i}])" for i in range(1, _CLASSES + 1))
_WORD_SUMS = ", ".join(f"sum(common[{i}])" for i in range(1, rules.BINS + 2))

_QUALITY = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang
    FROM documents),
split AS (
    SELECT *, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        {_LISTED} AS listed
    FROM texts),
windows AS (
    SELECT r, i, ws[i : i + 4] AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
counted AS (
    SELECT s.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        length(t) AS chars,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS ascii_upper,
        length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
        length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')) AS punct,
        length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS beyond,
        list_transform(listed, lambda w: len(list_filter(ws, lambda x: x = w))) AS hits
    FROM split s LEFT JOIN covered c ON s.r = c.r),
shaped AS (
    SELECT *, beyond - (upper - ascii_upper) AS other, chars - word_chars AS space,
        CASE WHEN hits IS NOT NULL THEN list_transform(
            list_append(hits, n_words - list_sum(hits)), lambda x: CAST(x AS DOUBLE)) END AS common,
        n_words < {rules.MIN_WORDS}
            OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
    FROM counted),
histograms AS (
    SELECT *, list_transform(
        [chars - space - upper - digit - punct - n_symbols - other, upper, digit, punct, n_symbols, space, other],
        lambda x: CAST(x AS DOUBLE)) AS classes
    FROM shaped),
reference AS (
    SELECT lang, [{_SUMS}] AS class_sums,
        CASE WHEN sum(common[1]) IS NOT NULL THEN [{_WORD_SUMS}] END AS word_sums
    FROM histograms WHERE NOT base_failed AND n_words >= {rules.COMMON_MIN_WORDS} GROUP BY lang),
measured AS (
    SELECT h.*,
        CASE WHEN n_words >= {rules.CLASS_WORDS} THEN {_distance("classes", "class_sums")} END AS class_distance,
        CASE WHEN n_words >= {rules.COMMON_MIN_WORDS} THEN {_distance("common", "word_sums")} END AS common_distance
    FROM histograms h LEFT JOIN reference f ON h.lang = f.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(class_distance > {rules.MAX_CLASS_DISTANCE}, false)
        AND NOT coalesce(common_distance > {rules.MAX_COMMON_DISTANCE}, false) AS kept
FROM measured
"""

_AUDIT = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT *, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
        min(doc_id) OVER (PARTITION BY t) AS first_id
    FROM texts),
marks AS (
    SELECT doc_id, part, [
        len(ws) < {filter_audit.MIN_WORDS},
        100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(ws),
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {filter_audit.MAX_UPPER_PERCENT} * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > first_id, false)] AS fails
    FROM split),
known AS (
    SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
    FROM labels GROUP BY doc_id),
sets AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
    SELECT filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) AS f,
        list_transform(range(1, step), lambda k: instr('ABCDE', substr(filter_order, k, 1))) AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (
    SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing,
        len(list_filter(before, lambda k: fails[k])) > 0 AS gone,
        len(list_filter(fails, lambda b: b)) = 1 AS alone
    FROM sets, steps),
told AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failing AND alone THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""

_SHARE = "CAST(1 + (CAST(1000000000 AS HUGEINT) * ({uses} + 2)) // ({total} + 2 * v) AS BIGINT)"
_DIVERGENCE = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t
    FROM documents),
tokens AS (
    SELECT r, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM texts),
kept AS (
    SELECT lang, term, count(*) AS uses FROM tokens
    GROUP BY lang, term HAVING count(DISTINCT r) >= {source_divergence.MIN_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(uses) AS BIGINT) AS n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM texts),
found AS (SELECT lang, source, term, count(*) AS uses FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (
    SELECT s.lang, s.source, coalesce(CAST(sum(uses) AS BIGINT), 0) AS n
    FROM sources s LEFT JOIN found f ON s.lang = f.lang AND s.source = f.source GROUP BY s.lang, s.source),
shares AS (
    SELECT s.lang, s.source, k.term, coalesce(f.uses, 0) AS uses,
        {_SHARE.format(uses="coalesce(f.uses, 0)", total="s.n")} AS p,
        {_SHARE.format(uses="k.uses", total="l.n")} AS q
    FROM totals s JOIN kept k ON s.lang = k.lang JOIN langs l ON s.lang = l.lang
    LEFT JOIN found f ON s.lang = f.lang AND s.source = f.source AND k.term = f.term),
apart AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM shares WHERE uses > 0 AND p > q),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
"""

SQL: dict[str, str] = {
    "op3_quality_rules": _QUALITY,
    "op12_filter_audit": _AUDIT,
    "op13_source_divergence": _DIVERGENCE,
    "op10_exact_dedup": """
WITH normal AS (
    SELECT doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY t)
""",
}
