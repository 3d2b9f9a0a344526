"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .urls import SECOND_LEVEL

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words and hit words of ``{docs}`` (doc_id, text) against ``benchmark``; ends with the CTE ``judged``.
DECONTAMINATION = rf"""
words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM {{docs}}
),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item, least(len(ws), 13) AS width, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM item_words WHERE len(ws) > 0)
),
places AS (
  SELECT rid, width, i, array_to_string(ws[i:i + width - 1], ' ') AS win
  FROM (SELECT rid, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM words, (SELECT DISTINCT width FROM item_windows) WHERE len(ws) >= width)
),
occurs AS (SELECT rid, p.width, i, item FROM places p JOIN item_windows USING (width, win)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + width)) AS pos FROM (SELECT DISTINCT rid, width, i FROM occurs)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occurs) GROUP BY rid),
judged AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
  FROM words LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
)"""


URL_REPUTATION = rf"""
WITH parts AS (
  SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM parts
),
outcomes AS (
  SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruling
  FROM ruled
),
hosts AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare, CAST(count(ruling) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ruling = 'block') AS DOUBLE) AS k
  FROM outcomes GROUP BY host
),
named AS (
  SELECT *, CASE WHEN regexp_matches(bare, '(^|\.)({"|".join(SECOND_LEVEL)})\.[a-z]{{2}}$') THEN regexp_extract(bare, '([^.]*\.)?[^.]*\.[^.]*$') ELSE regexp_extract(bare, '([^.]*\.)?[^.]*$') END AS dom,
    CASE WHEN regexp_matches(bare, '(^|\.)({"|".join(SECOND_LEVEL)})\.[a-z]{{2}}$') THEN regexp_extract(bare, '[^.]*\.[^.]*$') ELSE regexp_extract(bare, '[^.]*$') END AS suf
  FROM hosts
),
doms AS (SELECT suf, dom, sum(n) AS n, sum(k) AS k FROM named GROUP BY suf, dom),
sufs AS (SELECT suf, sum(n) AS n, sum(k) AS k FROM doms GROUP BY suf),
suf_m AS (SELECT *, (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM sufs) AS m FROM sufs),
suf_s AS ({{strength}} suf_m),
suf_p AS (SELECT suf, (m * s + k) / (s + n) AS m FROM suf_m, suf_s),
dom_m AS (SELECT d.*, p.m FROM doms d JOIN suf_p p USING (suf)),
dom_s AS ({{strength}} dom_m),
dom_p AS (SELECT dom, (m * s + k) / (s + n) AS m FROM dom_m, dom_s),
host_m AS (SELECT h.*, p.m FROM named h JOIN dom_p p USING (dom)),
host_s AS ({{strength}} host_m),
post AS (SELECT host, m * s + k AS a, (1 - m) * s + n - k AS b FROM host_m, host_s)
SELECT page_id, o.host, path, rule, coalesce(ruling, CASE WHEN 1 / (1 + exp(-(ln(a / b) - 1.645 * sqrt(1 / a + 1 / b)))) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM outcomes o JOIN post USING (host)
""".replace(
    "{strength}",
    """SELECT CASE WHEN w IS NULL OR w = 0 THEN 1.0 WHEN sq <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, mm * (1 - mm) * w / sq - 1)) END AS s
    FROM (SELECT avg(m) AS mm, sum(k * (k - 1) - 2 * m * k * (n - 1) + m * m * n * (n - 1)) AS sq, sum(n * (n - 1)) AS w FROM""",
)
URL_REPUTATION = URL_REPUTATION.replace(" suf_m),", " suf_m)),").replace(" dom_m),\ndom_p", " dom_m)),\ndom_p").replace(" host_m),\npost", " host_m)),\npost")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": "WITH " + DECONTAMINATION.format(docs="documents") + " SELECT * FROM judged",
        "op6_url_reputation": URL_REPUTATION,
    }
