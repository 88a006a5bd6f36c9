"""DuckDB SQL for the queries that SQL can express on small tables."""

from __future__ import annotations

from .near_dups import PART, WHOLE, WIDTH
from .quality_rules import AT_MOST, EXACT, GAMMA, LOWER, LOWER_OF, RULES, SURELY, UPPER, UPPER_OF, fence_sql, rate_sql
from .secret_scan import BASE, MORE
from .shared import WORD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_dups() -> str:
    """All pairs that share a shingle, and what can be reached by links."""
    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents), "
        f"s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda k: array_to_string(w[k:k + {WIDTH - 1}], ' '))) END AS s FROM d), "
        "n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s), "
        "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2), "
        f"l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {PART} * c >= {WHOLE} * (x.n + y.n - c)), "
        "u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS at FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.at), "
        "m AS (SELECT doc_id, min(r.at) AS component_id FROM r GROUP BY doc_id) SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"
    )


def secrets() -> str:
    """Every pattern over every text; places are sums of the lengths of what stands before."""
    rules = []
    for k, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        keep = {"assign": f"length(regexp_extract(m[i], '{p}', 2)) >= 6", "access": "length(m[i]) >= 20"}.get(r.kind, "TRUE")
        at = "list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        rules.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, CAST({at} AS BIGINT) AS a, CAST({at} + length(m[i]) AS BIGINT) AS z FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS b FROM d) q) q WHERE {keep}")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    told = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(rules)}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce({told} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({told} FILTER (WHERE kind IS NOT NULL), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"
    )


def quality() -> str:
    """Counts by lists, sketches by GROUP BY, fences by running sums."""
    only = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    rate = lambda k, count="{}": rate_sql(k, count, "", "//")
    rates = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS rule, {rate(k)} AS v, {rate(k, SURELY)} AS least_v, {rate(k, AT_MOST)} AS most_v FROM c" for k in RULES)
    middle = lambda b: f"CASE WHEN {b} < {EXACT} THEN CAST({b} AS DOUBLE) ELSE exp(({b} - 1000 + 0.5) * ln({GAMMA})) END"

    def quantiles(keys: str, of: str) -> str:
        run = f"SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM {of}"
        q = f"SELECT {keys}, max(total) AS total, " + ", ".join(f"min(CASE WHEN upto * 10 >= total * {k} THEN bucket END) AS b{k}" for k in (1, 5, 9)) + f" FROM ({run}) x GROUP BY {keys}"
        return f"SELECT {keys}, CAST(total AS DOUBLE) AS rows, " + ", ".join(f"ln(1 + {middle(f'b{k}')}) AS {name}" for k, name in ((1, "low"), (5, "mid"), (9, "high"))) + f" FROM ({q}) y"

    return (
        f"WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents), "
        "g AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d) x), "
        "twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) x WHERE n > 1), "
        "covered AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat_words FROM (SELECT doc_id, k, unnest(range(5)) AS o FROM twice) x GROUP BY doc_id), "
        f"lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d), "
        f"c AS (SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, {only('#*$%&|<>')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, "
        f"len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_stutters, {only('!')} AS n_shouts, {only('A-Z')} AS n_capitals, {only('A-Za-z')} AS n_letters FROM d JOIN lines USING (doc_id) LEFT JOIN covered ON covered.doc_id = d.doc_id), "
        f"v AS ({rates}), s AS (SELECT lang, source, rule, CASE WHEN v < {EXACT} THEN v ELSE CAST(floor(ln(v) / ln({GAMMA})) AS BIGINT) + 1000 END AS bucket, count(*) AS n FROM v WHERE doc_id IN (SELECT doc_id FROM c WHERE n_words > 0) GROUP BY ALL), "
        f"every AS (SELECT rule, bucket, sum(n) AS n FROM s GROUP BY rule, bucket), merged AS (SELECT rule, {UPPER} AS m_upper, {LOWER} AS m_lower FROM ({quantiles('rule', 'every')}) z), "
        f"f AS (SELECT own.*, {fence_sql(UPPER_OF, 1)} AS hi, {fence_sql(LOWER_OF, -1)} AS lo FROM ({quantiles('lang, source, rule', 's')}) own JOIN merged USING (rule)), "
        "exceeded AS (SELECT v.doc_id, bool_or(v.least_v > f.hi OR v.most_v < f.lo) AS beyond FROM v JOIN f ON f.rule = v.rule AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source GROUP BY v.doc_id), "
        "b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c) "
        "SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters, n_shouts, n_capitals, n_letters, base_failed, NOT base_failed AND NOT coalesce(beyond, FALSE) AS kept FROM b LEFT JOIN exceeded USING (doc_id)"
    )
