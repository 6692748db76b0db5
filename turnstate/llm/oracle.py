"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _url_levels(levels: int) -> str:
    """The path-template tree, one set of views per level."""
    steps = []
    for level in range(1, levels + 1):
        tree = f"tree{level - 1}"
        steps.append(f"""
kid{level} AS (
  SELECT host, template, segments[{level}] AS child, sum(urls) AS urls, sum(labelled) AS labelled, sum(bad) AS bad
  FROM {tree} WHERE len(segments) >= {level} GROUP BY ALL
),
node{level} AS (
  SELECT host, template, count(*) AS kids, sum(urls) AS all_urls, sum(labelled) AS all_labelled, sum(bad) AS all_bad
  FROM kid{level} GROUP BY ALL
),
chosen{level} AS (
  SELECT k.host, k.template, k.child,
    CASE WHEN kids = 1 THEN literal
      WHEN urls < 20 THEN '*'
      WHEN labelled > 0 AND all_labelled - labelled > 0
        AND abs(bad / labelled - (all_bad - bad) / (all_labelled - labelled))
          > 1.96 * sqrt((all_bad / all_labelled) * (1 - all_bad / all_labelled)
            * (1 / labelled + 1 / (all_labelled - labelled))) THEN literal
      ELSE '+' END AS branch
  FROM (SELECT *, CASE WHEN left(child, 1) IN ('*', '+', chr(92)) THEN chr(92) || child ELSE child END AS literal FROM kid{level}) k JOIN node{level} n ON k.host = n.host AND k.template = n.template
),
tree{level} AS (
  SELECT t.host, t.masked, t.segments, t.urls, t.labelled, t.bad,
    CASE WHEN c.branch IS NULL THEN t.template WHEN t.template = '?' THEN c.branch
      ELSE t.template || '/' || c.branch END AS template
  FROM {tree} t LEFT JOIN chosen{level} c
    ON t.host = c.host AND t.template = c.template AND len(t.segments) >= {level} AND t.segments[{level}] = c.child
)""")
    return ",".join(steps)


ORACLE["op1_url_filters"] = f"""
WITH bad_docs AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
),
parsed AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path
  FROM hosts
),
marked AS (
  SELECT p.page_id, p.host, p.path, b.bad,
    regexp_replace(regexp_replace(p.path, '[0-9a-f]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') AS masked
  FROM parsed p LEFT JOIN bad_docs b ON b.doc_id = try_cast(regexp_extract(p.path, '/([0-9]+)', 1) AS bigint)
),
grouped AS (
  SELECT host, masked, count(*)::DOUBLE AS urls, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad,
    string_split(masked, '/') AS parts
  FROM marked GROUP BY host, masked
),
tree0 AS (
  SELECT host, masked, urls, labelled, bad, '?' AS template,
    CASE WHEN len(parts) > 8 THEN list_append(parts[1:7], '{{tail}}') ELSE parts END AS segments
  FROM grouped
),{_url_levels(8)},
prior AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS share FROM tree8),
leaves AS (
  SELECT host, template, sum(labelled) > 0 AND 1 - (sum(bad) + 20 * any_value(share)) / (sum(labelled) + 20) < 0.7 AS rejected
  FROM tree8, prior GROUP BY host, template
)
SELECT m.page_id, m.host, m.path,
  CASE WHEN org_site AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN org_site AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN com AND path LIKE '/fr/%' THEN 'com/fr/' WHEN com AND path LIKE '/de/%' THEN 'com/de/'
    WHEN org AND path LIKE '/%' THEN 'org/' END AS rule,
  CASE WHEN org_site AND (path LIKE '/en/1%' OR path LIKE '/es/%') THEN 'block'
    WHEN com AND path LIKE '/fr/%' THEN 'allow' WHEN com AND path LIKE '/de/%' THEN 'block'
    WHEN org AND path LIKE '/%' THEN 'allow' WHEN rejected THEN 'block' ELSE 'allow' END AS verdict,
  t.template
FROM (
  SELECT *, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com,
    host = 'example.org' OR host LIKE '%.example.org' AS org_site FROM marked
) m JOIN tree8 t ON m.host = t.host AND m.masked = t.masked
JOIN leaves l ON t.host = l.host AND t.template = l.template
"""

ORACLE["op4_top_k_search"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.vector::DOUBLE[], c.vector::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 20 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# Prefix sizes for every depth up to 20; the deepest bucket in use here is far above that.
ORACLE["op5_sharding"] = """
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), chr(92) || 'N') || chr(31) || coalesce(text, chr(92) || 'N')), 1, 15))::BIGINT AS bits
  FROM documents
),
sizes AS (
  SELECT level, bits >> (60 - level) AS prefix, sum(n_bytes) AS bytes
  FROM rows, (SELECT unnest(range(0, 21)) AS level) GROUP BY ALL
),
chosen AS (
  SELECT r.doc_id, r.n_bytes, r.bits, min(s.level) AS level
  FROM rows r JOIN sizes s ON s.prefix = r.bits >> (60 - s.level) WHERE s.bytes <= 2097152 GROUP BY ALL
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, level::BIGINT AS level,
  CASE WHEN level = 0 THEN '' ELSE lpad(bin(bits >> (60 - level)), level::INT, '0') END AS shard
FROM chosen
"""

ORACLE["op9_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, text FROM documents),
raw AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM docs WHERE text IS NOT NULL
),
lines AS (
  SELECT doc_id, pos, line, len(line) - len(replace(line, ' ', '')) + 1 AS n,
    regexp_replace(array_to_string(string_split(line, ' ')[1:3], ' '), '[0-9]+', '<*>', 'g') AS lead,
    regexp_replace(line, '[0-9]+', '<*>', 'g') AS pattern
  FROM raw WHERE trim(line, ' ') <> ''
),
counted AS (SELECT * FROM lines WHERE doc_id IS NOT NULL),
variants AS (
  SELECT n, lead, pattern, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM counted GROUP BY ALL
),
leaves AS (
  SELECT n, lead, count(*) AS variants FROM variants GROUP BY ALL HAVING min(first_doc) < max(last_doc)
),
tokens AS (
  SELECT v.n, v.lead, generate_subscripts(string_split(v.pattern, ' '), 1) AS pos, unnest(string_split(v.pattern, ' ')) AS token
  FROM variants v JOIN leaves l ON v.n = l.n AND v.lead = l.lead WHERE l.variants > 1
),
places AS (
  SELECT n, lead, pos, count(DISTINCT token) > 1 AND count(DISTINCT token) >= 0.5 * count(*) AS open
  FROM tokens GROUP BY n, lead, pos
),
masks AS (
  SELECT n, lead, list(open ORDER BY pos) AS mask FROM places GROUP BY n, lead
  HAVING count(*) FILTER (WHERE open) <= (1 - 0.8) * n
),
placed AS (
  SELECT v.n, v.lead, v.pattern, v.first_doc, v.last_doc,
    CASE WHEN m.mask IS NULL THEN v.pattern ELSE array_to_string(
      list_transform(range(1, v.n + 1), lambda i: CASE WHEN m.mask[i] THEN '<*>' ELSE string_split(v.pattern, ' ')[i] END), ' ')
    END AS template
  FROM variants v JOIN leaves l ON v.n = l.n AND v.lead = l.lead
  LEFT JOIN masks m ON v.n = m.n AND v.lead = m.lead
),
repeated AS (
  SELECT n, lead, template, min(first_doc) AS first_doc FROM placed GROUP BY n, lead, template HAVING min(first_doc) < max(last_doc)
),
dropped AS (
  SELECT c.doc_id, c.pos FROM counted c
  JOIN placed p ON c.n = p.n AND c.lead = p.lead AND c.pattern = p.pattern
  JOIN repeated r ON p.n = r.n AND p.lead = r.lead AND p.template = r.template
  WHERE c.doc_id <> r.first_doc
),
kept AS (
  SELECT r.doc_id, array_to_string(list(r.line ORDER BY r.pos), chr(10)) AS text
  FROM raw r LEFT JOIN dropped d ON r.doc_id = d.doc_id AND r.pos = d.pos WHERE d.pos IS NULL GROUP BY r.doc_id
)
SELECT docs.doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""

ORACLE["op13_filter_interaction_audit"] = r"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN t.doc_id > least THEN 'E' ELSE '' END AS failed
  FROM texts t LEFT JOIN known k ON t.doc_id = k.doc_id
),
cells AS (
  SELECT part, failed, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
removal AS (
  SELECT part, filter_order, failed, docs, good, toxic,
    list_min(list_transform(list_append(string_split(failed, ''), '.'),
      lambda x: CASE WHEN x IN ('', '.') THEN 6 ELSE position(x IN filter_order) END)) AS gone
  FROM cells CROSS JOIN orders
),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
    sum(CASE WHEN gone > step THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN gone = step THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND contains(failed, substr(filter_order, step, 1)) THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = substr(filter_order, step, 1) THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM removal CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM steps
"""
