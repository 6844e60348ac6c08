"""Comparison SQL for the mail relations: facts cut by regular expressions from known markup."""

from __future__ import annotations

from sparkproof.functions import urls

ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
            ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]


def decoded(expr: str) -> str:
    for entity, ch in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{ch}')"
    return expr


def folded(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


A = '<a href="([^"]*)">([^<]*)</a>'
MSO = r"(?is)<!--\[if[^\]]*mso[^\]]*\]>(.*?)<!\[endif\]-->"
HOST = r"(?i)^https?://([^/?#]*)"


def host_sql(u: str) -> str:
    bare = f"regexp_replace(regexp_extract({u}, '{HOST}', 1), '^.*@|:\\d*$', '', 'g')"
    return f"nullif(lower(regexp_extract({bare}, '^([^\\s<>^|%]+)$', 1)), '')"


def parses_sql(u: str) -> str:
    other = f"(regexp_matches({u}, '(?i)^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches({u}, '(?i)^https?:'))"
    return f"({host_sql(u)} IS NOT NULL OR {other})"


def kind_sql(u: str) -> str:
    return f"""CASE WHEN contains({u}, '%%') THEN 'ampscript'
      WHEN starts_with({u}, 'mailto:') THEN 'mailto'
      WHEN starts_with({u}, '#') OR {u} = '' THEN 'anchor'
      WHEN NOT {parses_sql(u)} THEN 'ampscript'
      WHEN regexp_matches(coalesce({host_sql(u)}, ''), '{q(urls.TRACKED_HOST)}') THEN 'tracked'
      ELSE 'statique' END"""


def params_sql(u: str) -> str:
    """List of decoded {k, v} of a URL's query."""
    return f"""list_transform(list_filter(string_split(CASE WHEN {parses_sql(u)}
        THEN regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1) ELSE '' END, '&'), lambda p: p <> ''),
      lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')),
                  'v': url_decode(replace(regexp_extract(p, '(?s)^[^=]*=(.*)$', 1), '+', ' '))}})"""


def last_param(params: str, key: str) -> str:
    return f"list_filter({params}, lambda p: lower(p.k) = '{key}')[-1].v"


# Mails, their links with tracking parameters, and the text that content rules read.
MAIL_CTES = f"""
mails AS (SELECT * FROM {{mails}} m),
shown AS (SELECT version_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS v,
  array_to_string(regexp_extract_all(html, '{MSO}', 1), chr(10)) AS mso FROM mails),
link_rows AS (
  SELECT version_id, 0 AS blk, unnest(regexp_extract_all(v, '{A}', 1)) AS href,
    unnest(regexp_extract_all(v, '{A}', 2)) AS text,
    unnest(range(len(regexp_extract_all(v, '{A}', 1)))) AS n FROM shown
  UNION ALL
  SELECT version_id, 1, unnest(regexp_extract_all(mso, '{A}', 1)), unnest(regexp_extract_all(mso, '{A}', 2)),
    unnest(range(len(regexp_extract_all(mso, '{A}', 1)))) FROM shown),
link_text AS (SELECT version_id, blk, n, trim({decoded('href')}) AS href,
  {folded(decoded('text'))} AS text FROM link_rows),
link_first AS (SELECT version_id, href, text, min({{'blk': blk, 'n': n}}) AS place
  FROM link_text GROUP BY ALL),
link_params AS (SELECT version_id,
  CAST(row_number() OVER (PARTITION BY version_id ORDER BY place) - 1 AS INTEGER) AS pos,
  href, text, place.blk = 1 AS in_mso, {host_sql('href')} AS host, {kind_sql('href')} AS kind,
  {params_sql('href')} AS params FROM link_first),
links AS (SELECT *, {last_param('params', 'utm_campaign')} AS utm_campaign,
  {last_param('params', 'utm_source')} AS utm_source,
  list_filter(params, lambda p: starts_with(lower(p.k), 'utm_')) AS utm,
  list_filter(params, lambda p: p.k = 'e')[-1].v AS e_param FROM link_params)
"""

NEW_BLOCK = "(<p>|<h1>|<li>|<td>)"
TEXT_CTES = f"""
blocks AS (
  SELECT version_id, unnest(regexp_extract_all(b, '(?s)<(?:p|h1|li|td)>(.*?)(?:</p>|</h1>|</li>|</td>|</article>)', 1)) AS t,
    unnest(range(len(regexp_extract_all(b, '(?s)<(?:p|h1|li|td)>(.*?)(?:</p>|</h1>|</li>|</td>|</article>)', 1)))) AS n
  FROM (SELECT version_id, replace(replace(regexp_replace(regexp_replace(v, '(?s)<(style|script)>.*?</(style|script)>', '', 'g'),
      '<br>', ' ', 'g'), '<p>', '</p><p>'), '<td></p><p>', '<p>') AS b FROM shown) s),
block_text AS (SELECT version_id, n, {folded(decoded("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text FROM blocks),
text_first AS (SELECT version_id, text, min(n) AS n FROM block_text WHERE length(text) > 2 GROUP BY ALL),
texts_all AS (SELECT version_id, text, CAST(row_number() OVER (PARTITION BY version_id ORDER BY n) - 1 AS INTEGER) AS pos
  FROM text_first),
texts AS (SELECT * FROM texts_all ),
heads AS (SELECT version_id, name, source, campaign_id, lang,
  coalesce(nullif(trim({decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), ''),
           nullif(trim(regexp_replace(name, '^\\[[^\\]]*\\]\\s*', '')), '')) AS subject,
  CASE WHEN length({folded(decoded("regexp_extract(html, 'display:none\">([^<]*)</div>', 1)"))}) > 5
       THEN {folded(decoded("regexp_extract(html, 'display:none\">([^<]*)</div>', 1)"))} END AS preheader
  FROM mails),
footers AS (SELECT version_id, string_agg(text, ' · ' ORDER BY pos) AS footer
  FROM (SELECT *, max(pos) OVER (PARTITION BY version_id) AS last FROM texts_all) t WHERE pos > last - 6 GROUP BY version_id),
all_texts AS (SELECT h.version_id, array_to_string(list_filter([h.subject, h.preheader, t.body], lambda x: x <> ''), ' | ') AS all_text
  FROM heads h LEFT JOIN (SELECT version_id, string_agg(text, ' | ' ORDER BY pos) AS body FROM texts GROUP BY 1) t USING (version_id))
"""

TEST_NAME_CTES = """
name_parts AS (SELECT version_id, list_filter(list_transform(
    regexp_split_to_array(regexp_extract(name, '^\\s*\\[([^\\]]+)\\]', 1), '\\s*-\\s*'), lambda p: trim(p)),
    lambda p: p <> '') AS parts FROM mails),
name_body AS (SELECT version_id, parts, regexp_matches(coalesce(parts[1], ''), '^\\d{4,}$') AS has_num,
  CASE WHEN regexp_matches(coalesce(parts[1], ''), '^\\d{4,}$') THEN parts[2:] ELSE parts END AS body FROM name_parts WHERE len(parts) > 0),
name_last AS (SELECT *, coalesce(body[-1], '') AS l1, coalesce(body[-2], '') AS l2 FROM name_body),
name_flags AS (SELECT *, upper(l1) IN ('ALL','F','M') AS a1, NOT upper(l1) IN ('ALL','F','M') AND regexp_matches(l1, '^[A-Z]{2,3}$') AS m1
  FROM name_last),
test_names AS (SELECT version_id, CASE WHEN has_num THEN parts[1] END AS test_number,
  CASE WHEN m1 THEN l1 WHEN a1 AND regexp_matches(l2, '^[A-Z]{2,3}$') AND l2 <> 'ALL' THEN l2 END AS market,
  CASE WHEN a1 THEN upper(l1) WHEN m1 AND upper(l2) IN ('ALL','F','M') THEN upper(l2) END AS audience,
  body, (CASE WHEN a1 OR m1 THEN 1 ELSE 0 END)
    + (CASE WHEN (m1 AND upper(l2) IN ('ALL','F','M')) OR (a1 AND regexp_matches(l2, '^[A-Z]{2,3}$') AND l2 <> 'ALL') THEN 1 ELSE 0 END) AS taken
  FROM name_flags),
names AS (SELECT version_id, test_number, array_to_string(body[1:len(body) - taken], ' - ') AS campaign_name, market, audience,
  test_number IS NOT NULL AND market IS NOT NULL AND audience IS NOT NULL AND len(body) > taken AS well_formed FROM test_names)
"""


def mail_sql(select: str, *, texts: bool = False, names: bool = False, more: str = "") -> str:
    parts = [MAIL_CTES] + ([TEXT_CTES] if texts else []) + ([TEST_NAME_CTES] if names else [])
    if more:
        parts.append(more)
    return "WITH " + ",".join(parts) + select


# Probe outcomes by the length of a link's key, so that every status occurs.
UNSUB_KEY = urls.UNSUB_KEY
LINK_KEY_SQL = f"""kind || '|' || CASE WHEN regexp_matches(href, '{UNSUB_KEY}') OR regexp_matches(text, '{UNSUB_KEY}')
  THEN 'unsub|' ELSE '' END || CASE WHEN regexp_matches(href, '(?i)^https?://[^/?#\\s]+')
  THEN lower(regexp_extract(href, '(?i)^(https?://[^/?#]*)', 1))
    || CASE WHEN enc_path = '' THEN '/' ELSE enc_path END
    || regexp_extract(regexp_replace(href, '(?s)#.*$', ''), '(?s)^[^?]*(\\?.*)$', 1)
  WHEN {parses_sql('href')} THEN regexp_replace(href, '(?s)#.*$', '') ELSE href END"""
ENC_PATH_SQL = """coalesce(array_to_string(list_transform(string_split(regexp_extract(href, '(?i)^https?://[^/?#]*([^?#]*)', 1), ''),
    lambda ch: CASE WHEN regexp_matches(ch, '[^!-~]') THEN url_encode(ch) ELSE ch END), ''), '')"""
KEY_CTES = f"""
enc AS (SELECT *, {ENC_PATH_SQL} AS enc_path FROM links),
keyed AS (SELECT *, {LINK_KEY_SQL} AS link_key FROM enc),
reps AS (SELECT link_key, min_by(href, {{'v': version_id, 'p': pos}}) AS rep_href, count(*) AS n_links FROM keyed GROUP BY 1),
probe_log AS (
  SELECT link_key, 0 AS hop, rep_href AS url,
    CASE length(link_key) % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 302 WHEN 4 THEN 301
      WHEN 5 THEN 200 WHEN 6 THEN NULL WHEN 7 THEN 301 ELSE 200 END AS http_status,
    CASE length(link_key) % 10 WHEN 4 THEN rep_href || '&utm_campaign=FINAL' WHEN 7 THEN rep_href || '/unsubscribe' END AS location,
    CASE length(link_key) % 10 WHEN 5 THEN 'Page not found' ELSE 'Home' END AS title,
    CASE length(link_key) % 10 WHEN 6 THEN 'timeout' END AS error
  FROM reps
  UNION ALL
  SELECT link_key, 1, rep_href || '&utm_campaign=FINAL', 200, NULL, 'Home', NULL FROM reps WHERE length(link_key) % 10 = 4),
results AS (SELECT link_key, CASE length(link_key) % 10 WHEN 0 THEN 'casse' WHEN 1 THEN 'non_verifiable' WHEN 2 THEN 'casse'
    WHEN 3 THEN 'suspect' WHEN 4 THEN 'ok' WHEN 5 THEN 'suspect' WHEN 6 THEN 'suspect' WHEN 7 THEN 'non_teste' ELSE 'ok' END AS status,
  CASE length(link_key) % 10 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'blocked by anti-bot protection' WHEN 2 THEN 'HTTP 500'
    WHEN 3 THEN 'redirect without a Location header' WHEN 5 THEN 'possible soft-404 (title: "Page not found")'
    WHEN 6 THEN 'timeout' WHEN 7 THEN 'redirects to an unsubscribe link' END AS reason,
  CASE length(link_key) % 10 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 302 WHEN 6 THEN NULL WHEN 7 THEN 301 ELSE 200 END AS http_status,
  CASE WHEN length(link_key) % 10 IN (4, 7) THEN 1 ELSE 0 END AS redirects,
  CASE length(link_key) % 10 WHEN 3 THEN NULL WHEN 6 THEN NULL WHEN 4 THEN rep_href || '&utm_campaign=FINAL'
    WHEN 7 THEN rep_href || '/unsubscribe' ELSE rep_href END AS final_url FROM reps),
skips AS (SELECT *, CASE WHEN regexp_matches(href, '{q(urls.UNSUB_PROBE)}') OR regexp_matches(text, '{q(urls.UNSUB_PROBE)}') THEN 'unsubscribe link'
  WHEN kind = 'ampscript' THEN 'dynamic link' WHEN kind = 'anchor' THEN 'anchor or empty href' WHEN kind = 'mailto' THEN 'mailto' END AS skip FROM keyed),
checked AS (SELECT k.*, CASE WHEN skip IS NOT NULL THEN 'non_teste' ELSE r.status END AS status,
  CASE WHEN skip IS NOT NULL THEN skip ELSE r.reason END AS reason,
  CASE WHEN skip IS NULL THEN r.http_status END AS http_status,
  CASE WHEN skip IS NULL THEN r.final_url END AS final_url,
  CASE WHEN skip IS NULL AND redirects > 0 THEN {params_sql('r.final_url')} END AS final_params
  FROM skips k JOIN results r USING (link_key)),
eff AS (SELECT *, CASE WHEN len(utm) > 0 THEN utm ELSE coalesce(list_filter(final_params, lambda p: starts_with(lower(p.k), 'utm_')), []) END AS eff_utm
  FROM checked)
"""
