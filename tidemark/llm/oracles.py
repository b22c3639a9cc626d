"""DuckDB SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import RULES as QUALITY_RULES
from .quality_rules import STOP_WORDS, SYMBOLS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _components(links: str, nodes: str) -> str:
    """CTE text: reach(node, component) from links(a, b), both ways."""
    return f"""
    walk AS (
      SELECT id AS node, id AS root FROM {nodes}
      UNION
      SELECT l.b, w.root FROM walk w JOIN {links} l ON l.a = w.node WHERE w.root < l.b
    ),
    reach AS (SELECT node, min(root) AS component FROM walk GROUP BY node)"""


def _quality() -> str:
    bad = []
    for r in QUALITY_RULES:
        over, under = (x.strip() for x in r.measure.split("/"))
        tests = [f"{over}::DOUBLE / {under} {sign} {bound!r}" for sign, bound in (("<", r.low), (">", r.high)) if bound is not None]
        bad.append(f"({under} > 0 AND ({' OR '.join(tests)}))")
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
    wins AS (
      SELECT rid, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    m AS (
      SELECT doc_id, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines,
             len(list_filter(w, lambda x: lower(translate(x, '.,;:!?"()', '')) IN ({stop}))) AS n_stop_words,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaimed
      FROM d LEFT JOIN covered c USING (rid)),
    v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed AND NOT ({" OR ".join(bad)})) AS kept
    FROM v"""


_URL = r"""
    WITH p AS (
      SELECT page_id,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
      FROM pages),
    q AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM p),
    r(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    f AS (
      SELECT page_id, r.h || r.pre AS rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.pre) DESC) AS k
      FROM q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.pre))
    SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM q LEFT JOIN f ON f.page_id = q.page_id AND f.k = 1"""

_VECTORS = (
    """
    WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95),"""
    + _components("l", "v")
    + """
    SELECT v.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = v.id) AS n_links, component AS component_id, component = v.id AS kept
    FROM v JOIN reach ON reach.node = v.id"""
)

_MINHASH = (
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (
      SELECT DISTINCT id, w[i] || chr(32) || w[i+1] AS g FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
      UNION ALL SELECT id, w[1] FROM d WHERE len(w) = 1),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id),
    l AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),"""
    + _components("l", "d")
    + """
    SELECT d.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component AS component_id, component = d.id AS kept
    FROM d JOIN reach ON reach.node = d.id LEFT JOIN n ON n.id = d.id"""
)

ORACLES = {
    "op4_embedding_dedup": _VECTORS,
    "op5_minhash": _MINHASH,
    "op7_url_filter": _URL,
    "op8_quality_rules": _quality(),
}
