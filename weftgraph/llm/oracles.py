"""SQL for the operators that it can express, over whole tables."""

from weftgraph.llm import rules

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first_in AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT win.doc_id, win.i FROM win JOIN first_in USING (s) WHERE m < win.doc_id), range(0, 13) AS r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
copies AS (SELECT text, min(doc_id) AS copy_id, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY text),
own AS (SELECT copies.copy_id, copies.n, d.w FROM copies JOIN d ON d.doc_id = copies.copy_id),
gram AS (SELECT DISTINCT copy_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
         FROM (SELECT copy_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM own WHERE len(w) > 0)),
size_of AS (SELECT copy_id, count(*) AS m FROM gram GROUP BY 1),
shared AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size_of x ON x.copy_id = a JOIN size_of y ON y.copy_id = b WHERE 5 * k >= 4 * (x.m + y.m - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class_of AS (SELECT own.copy_id, least(own.copy_id, coalesce(min(reach.b), own.copy_id)) AS class_id FROM own LEFT JOIN reach ON reach.a = own.copy_id GROUP BY own.copy_id),
links AS (SELECT a, sum(n) AS k FROM link JOIN own ON own.copy_id = b GROUP BY a)
SELECT d.doc_id, coalesce(copies.copy_id, d.doc_id) AS copy_id, coalesce(class_of.class_id, d.doc_id) AS class_id,
       CAST(CASE WHEN copies.n IS NULL THEN 0 ELSE coalesce(links.k, 0) + copies.n - 1 END AS BIGINT) AS n_links
FROM d LEFT JOIN copies ON d.text = copies.text LEFT JOIN class_of ON class_of.copy_id = copies.copy_id LEFT JOIN links ON links.a = copies.copy_id
"""

LM_SCORES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y, CASE WHEN i > 2 THEN w[i - 2] END AS z
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n0 AS (SELECT count(*) AS c FROM t), o0 AS (SELECT doc_id, count(*) AS c FROM t GROUP BY 1),
n1 AS (SELECT x, count(*) AS c FROM t GROUP BY 1), o1 AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY 1, 2),
n2 AS (SELECT y, x, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY 1, 2), o2 AS (SELECT doc_id, y, x, count(*) AS c FROM t WHERE y IS NOT NULL GROUP BY 1, 2, 3),
n3 AS (SELECT z, y, x, count(*) AS c FROM t WHERE z IS NOT NULL GROUP BY 1, 2, 3), o3 AS (SELECT doc_id, z, y, x, count(*) AS c FROM t WHERE z IS NOT NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT t.doc_id, t.i, n0.c - o0.c AS c0, n1.c - o1.c AS c1, m1.c - p1.c AS y1, n2.c - o2.c AS c2, m2.c - p2.c AS y2, n3.c - o3.c AS c3
      FROM t CROSS JOIN n0 JOIN o0 ON o0.doc_id = t.doc_id
      JOIN n1 ON n1.x = t.x JOIN o1 ON o1.doc_id = t.doc_id AND o1.x = t.x
      LEFT JOIN n1 m1 ON m1.x = t.y LEFT JOIN o1 p1 ON p1.doc_id = t.doc_id AND p1.x = t.y
      LEFT JOIN n2 ON n2.y = t.y AND n2.x = t.x LEFT JOIN o2 ON o2.doc_id = t.doc_id AND o2.y = t.y AND o2.x = t.x
      LEFT JOIN n2 m2 ON m2.y = t.z AND m2.x = t.y LEFT JOIN o2 p2 ON p2.doc_id = t.doc_id AND p2.y = t.z AND p2.x = t.y
      LEFT JOIN n3 ON n3.z = t.z AND n3.y = t.y AND n3.x = t.x LEFT JOIN o3 ON o3.doc_id = t.doc_id AND o3.z = t.z AND o3.y = t.y AND o3.x = t.x),
r AS (SELECT doc_id, least(i, 3) AS best, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS k,
             CASE WHEN c3 > 0 THEN ln(c3 / y2) WHEN c2 > 0 THEN ln(c2 / y1) WHEN c1 > 0 THEN ln(c1 / c0) ELSE ln(1 / (c0 + 1)) END AS v FROM s),
g AS (SELECT doc_id, sum(v + (best - k) * ln(0.4)) AS v, count(*) AS n, count(*) FILTER (best > k) AS lost FROM r GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(g.v, 0), 3) AS log_score, round(g.v / g.n, 6) AS mean_log_score, CAST(coalesce(g.lost, 0) AS BIGINT) AS n_backed_off
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM item) GROUP BY t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
size AS (SELECT rid, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, total),
scored AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM item JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (rid) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def quality_rules(rate: float = 0.05, error: float = 0.05) -> str:
    """rules.judge over documents and labels, with lgamma for the binomial tails."""
    notch = lambda r: f"{rules.NOTCHES + 1} - ({' + '.join(f'CAST(v >= {c!r} AS INT)' for c in r.cutoffs())})"
    first = ", ".join(f"(SELECT {notch(r)} FROM (SELECT CASE WHEN {r.under} > 0 THEN {r.over} / CAST({r.under} AS DOUBLE) ELSE 0.0 END AS v))" for r in rules.RULES)
    n_rules, n, tuning = len(rules.RULES), rules.NOTCHES, ", ".join(f"'{x}'" for x in rules.TUNING)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, {_WORDS.replace("coalesce(text, '')", "t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 2), ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
twice AS (SELECT rid, x FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN twice USING (rid, x), range(0, 3) AS r(k) GROUP BY rid),
st AS (SELECT s.rid, doc_id, stratum, md5(t) AS digest, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
  FROM s LEFT JOIN covered ON covered.rid = s.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{first}] AS notches FROM st),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
texts AS (SELECT stratum, digest, bool_and(good) AS good, any_value(notches) AS notches FROM f JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
tuning AS (SELECT stratum, good, unnest(range(1, {n_rules + 1})) AS r, unnest(notches) AS notch FROM texts WHERE substr(digest, 1, 1) IN ({tuning})),
steps AS (SELECT stratum, r, k, count(*) FILTER (good AND notch <= k) AS g, count(*) FILTER (NOT good AND notch <= k) AS b, count(*) FILTER (good) AS all_g FROM tuning, range(1, {n + 1}) AS x(k) GROUP BY ALL),
cap AS (SELECT stratum, r, coalesce(min(k) FILTER (b = most), 0) AS cap FROM (SELECT *, max(b) FILTER (b > 0 AND g * {n_rules} <= all_g * {rate}) OVER (PARTITION BY stratum, r) AS most, b > 0 AND g * {n_rules} <= all_g * {rate} AS fits FROM steps) WHERE fits OR k = 1 GROUP BY 1, 2),
caps AS (SELECT stratum, list(cap ORDER BY r) AS caps FROM cap GROUP BY 1),
held AS (SELECT stratum, k, count(h.good) AS n, count(h.good) FILTER (len(list_filter(range(1, {n_rules + 1}), lambda i: notches[i] <= least(caps[i], k))) > 0) AS x FROM caps LEFT JOIN (SELECT * FROM texts WHERE good AND substr(digest, 1, 1) NOT IN ({tuning})) h USING (stratum), range(1, {n + 1}) AS y(k) GROUP BY 1, 2),
tail AS (SELECT *, CASE WHEN n = 0 OR x >= n * {rate} THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) END AS p FROM held),
plan AS (SELECT stratum, caps, coalesce(min(k) FILTER (p > {error} / (SELECT count(*) FROM caps)) - 1, {n}) AS notch FROM tail JOIN caps USING (stratum) GROUP BY 1, 2),
ruled AS (SELECT f.*, list_position(list_transform(range(1, {n_rules + 1}), lambda i: notches[i] <= least(caps[i], notch)), true) AS which FROM f LEFT JOIN plan USING (stratum))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(which, 0) = 0 AS kept, nullif(substr(stratum, 2), '') AS stratum, CASE WHEN base_failed THEN 'base' WHEN which > 0 THEN [{", ".join(f"'{r.name}'" for r in rules.RULES)}][which] END AS rejected_by
FROM ruled
"""
