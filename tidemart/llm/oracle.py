"""SQL counterparts of the registered queries, for those that SQL can express."""

from __future__ import annotations

import string

from tidemart.llm import hard_negatives, quality, ranked_search, urlrank
from tidemart.llm.minhash import SIMILARITY
from tidemart.llm.subspace import COSINE

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Steps after which ranks move by less than 1e-7.
URL_STEPS = 96
_LOWER = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _reach(links: str, nodes: str) -> str:
    """CTEs after which ``roots`` (id, root) holds the smallest id that each of ``nodes`` (id) reaches."""
    return f"""
reach(id, other) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other
),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"""


def minhash_sql() -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= {SIMILARITY} * (p.n + q.n - m)
),
ids AS (SELECT doc_id AS id FROM documents),
{_reach("links", "ids")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d JOIN roots ON roots.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def subspace_sql() -> str:
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}
),
ids AS (SELECT vec_id AS id FROM embeddings),
{_reach("links", "ids")},
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON roots.id = vec_id LEFT JOIN degree ON degree.a = vec_id"""


def quality_sql() -> str:
    def passes(rule: quality.Rule) -> str:
        sides = []
        if rule.least is not None:
            sides.append(f"1000 * {rule.numerator} >= {rule.least} * {rule.denominator}")
        if rule.most is not None:
            sides.append(f"1000 * {rule.numerator} <= {rule.most} * {rule.denominator}")
        return " AND ".join(sides)

    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    marks = quality.MARKS.replace("'", "''")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, text, {_WORDS.format("text")} AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
),
places AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2
),
windows AS MATERIALIZED (SELECT doc_id, i, words[i : i + 2] AS g FROM places),
repeated AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT x.doc_id, unnest([i, i + 1, i + 2]) AS k FROM windows x JOIN repeated r ON r.doc_id = x.doc_id AND r.g = x.g
  ) GROUP BY doc_id
),
c AS (
  SELECT w.doc_id, 1 AS one, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda x: rtrim(lower(x), '{marks}') IN ({stop})))::BIGINT AS n_stop_words,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(passes(r) for r in quality.RULES)} AS kept
FROM c"""


def urlrank_sql() -> str:
    def host(url: str) -> str:
        rest = f"substr({url}, strpos({url}, '://') + 3)"
        return f"CASE WHEN strpos({url}, '://') > 0 THEN {_LOWER.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} ELSE '' END"

    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(urlrank.RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in longest) + " END"
    href = urlrank.HREF.replace("'", "''")
    steps = []
    for k in range(URL_STEPS):
        steps.append(f"""
s{k + 1} AS MATERIALIZED (
  SELECT walk, host, sum(score) AS score FROM (
    SELECT * FROM base UNION ALL
    SELECT e.walk, e.dst, {urlrank.DAMPING} * e.weight * s.score FROM walks e JOIN {f"s{k}" if k else "base"} s ON s.walk = e.walk AND s.host = e.src
  ) GROUP BY walk, host
)""")
    return rf"""
WITH split AS MATERIALIZED (
  SELECT page_id, html, {host("url")} AS host,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages
),
judged AS MATERIALIZED (SELECT *, {case("name")} AS rule, {case("verdict")} AS by_rule FROM split),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS url FROM judged),
links AS (SELECT src, CASE WHEN starts_with(url, '//') THEN ':' || url ELSE url END AS url FROM found),
family AS (
  SELECT src, dst FROM (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS dst FROM judged) WHERE dst <> ''
),
every AS (
  SELECT src, {host("url")} AS dst FROM links UNION ALL FROM family UNION ALL SELECT dst, src FROM family
),
pairs AS (SELECT src, dst, count(*) AS n FROM every WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM pairs),
walks AS MATERIALIZED (
  SELECT 'trust' AS walk, src, dst, weight FROM edges UNION ALL
  SELECT 'distrust', dst, src, weight FROM edges
),
shares AS (
  SELECT host, avg((coalesce(by_rule, '') = 'allow')::INT) AS allowed, avg((coalesce(by_rule, '') = 'block')::INT) AS blocked
  FROM judged WHERE host <> '' GROUP BY host
),
base AS MATERIALIZED (
  SELECT 'trust' AS walk, host, {1 - urlrank.DAMPING} * allowed AS score FROM shares WHERE allowed > 0 UNION ALL
  SELECT 'distrust', host, {1 - urlrank.DAMPING} * blocked FROM shares WHERE blocked > 0
),
{",".join(steps)},
final AS (
  SELECT host, coalesce(sum(score) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (walk = 'distrust'), 0) AS distrust
  FROM s{URL_STEPS} GROUP BY host
)
SELECT page_id, j.host, j.path, j.rule,
  coalesce(by_rule, CASE WHEN distrust >= {urlrank.THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN final f ON f.host = j.host"""


def ranked_search_sql() -> str:
    terms = _TERMS.format(_LOWER.format("coalesce(text, '')"))
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest({terms}) AS term FROM documents),
l AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, coalesce(sum(n), 0)::BIGINT AS terms FROM l),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
),
m AS MATERIALIZED (
  SELECT doc_id, {100 - ranked_search.LENGTH_SHARE} + (({ranked_search.LENGTH_SHARE} * n * docs) // terms) AS m FROM l, total
),
q AS MATERIALIZED (SELECT item_id, unnest({terms}) AS term FROM benchmark),
scored AS (
  SELECT item_id, tf.doc_id, sum(w * (({ranked_search.SCALE} * tf) // (1000 * tf + {ranked_search.DAMPING} * m)))::BIGINT AS score
  FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN m ON m.doc_id = tf.doc_id
  GROUP BY item_id, tf.doc_id
)
SELECT * FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
) WHERE rank <= {ranked_search.TOP}"""


def hard_negatives_sql() -> str:
    h = hard_negatives
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({h.SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {h.POSITIVES}
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND {h.LEAST} * positive_score <= 100 * n.score AND 100 * n.score <= {h.MOST} * positive_score
QUALIFY rank <= {h.NEGATIVES}"""


STATEMENTS: dict[str, str] = {
    "op2_minhash": minhash_sql(),
    "op5_url_rank": urlrank_sql(),
    "op7_quality_rules": quality_sql(),
    "op8_subspace_join": subspace_sql(),
    "op11_hard_negatives": hard_negatives_sql(),
    "op12_ranked_search": ranked_search_sql(),
}
