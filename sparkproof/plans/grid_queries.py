"""Queries over brief workbooks whose cells are cut from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkproof.operators import grid, parse_plan
from sparkproof.plans.registry import query
from sparkproof.sources.bindings import RELATIONS, load

# Eight parts are one workbook. Sheet Brief has a language grid; every third workbook has a second,
# shorter sheet. Sheet Email has the FIELD / VALUE layout.
RELATIONS["grid_parts"] = """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS workbook, CAST(p_partkey % 8 AS INTEGER) AS k, p_name, p_type, p_brand FROM {part}"""
RELATIONS["grid_cells"] = """
SELECT workbook, 'Brief' AS sheet, 3 + k AS row, c AS col,
  CASE WHEN c = 0 THEN CASE k WHEN 0 THEN 'Subject line' WHEN 1 THEN '' WHEN 2 THEN 'CTA 1' WHEN 3 THEN 'WW Linkthrough' WHEN 4 THEN 'cn linkthrough (cn)' WHEN 5 THEN 'Memo'
      WHEN 6 THEN 'Langs' ELSE '' END
    WHEN k = 3 THEN CASE c WHEN 2 THEN concat('https://ww.example/', p_type) ELSE '' END
    WHEN k = 4 THEN CASE c WHEN 1 THEN 'see link' ELSE '' END
    WHEN k = 5 THEN CASE c WHEN 1 THEN 'one value' ELSE '' END
    WHEN k = 6 THEN CASE c WHEN 1 THEN 'EN' WHEN 2 THEN 'fr' ELSE '' END
    ELSE CASE c WHEN 1 THEN p_name WHEN 2 THEN concat(p_type, ' FR') WHEN 3 THEN 'later EN' ELSE '' END END AS text,
  CASE WHEN k = 4 AND c = 1 THEN 'https://cn.example/x' END AS link
FROM {grid_parts} p CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
UNION ALL
SELECT workbook, 'Brief', r, c, CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'Campaign Name' WHEN 2 THEN concat('ADHOC_', workbook) ELSE '' END
  ELSE CASE c WHEN 0 THEN 'Block' WHEN 1 THEN 'EN' WHEN 2 THEN 'French (FR)' ELSE 'US - CA' END END, NULL
FROM (SELECT DISTINCT workbook FROM {grid_parts} g) w CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 2) a CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) b
UNION ALL
SELECT workbook, 'Other', 5 + k, c, CASE c WHEN 0 THEN concat('Body ', k) ELSE p_name END, NULL FROM {grid_parts} p CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) n
WHERE workbook % 3 = 0 AND k < 4
UNION ALL
SELECT workbook, 'Other', 1, c, CASE c WHEN 1 THEN 'DE' WHEN 2 THEN 'Italian' ELSE 'x' END, NULL FROM (SELECT DISTINCT workbook FROM {grid_parts} g) w CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) n
WHERE workbook % 3 = 0
"""
RELATIONS["field_cells"] = """
SELECT workbook, 'Email' AS sheet, 4 + k AS row, c AS col,
  CASE c WHEN 0 THEN CASE k WHEN 0 THEN 'Subject Line' WHEN 1 THEN 'CTA 1' WHEN 2 THEN 'CTA 1 URL' WHEN 3 THEN 'Hero URL - WOMEN' WHEN 4 THEN 'Launch date' WHEN 5 THEN 'Body' WHEN 6 THEN 'SMS' ELSE 'Late' END
    WHEN 1 THEN CASE k WHEN 0 THEN 'Dear Client, discover…' WHEN 1 THEN 'Shop  Now' WHEN 2 THEN 'https://brand.com/x' WHEN 3 THEN 'click' WHEN 5 THEN 'Shop now' ELSE 'v' END
    ELSE CASE WHEN k = 0 AND workbook % 2 = 0 THEN concat(p_name, ' ', c) WHEN k = 2 AND c = 3 AND workbook % 2 = 0 THEN concat('https://shop.example/', workbook) ELSE '' END END AS text,
  CASE WHEN k = 3 AND c = 1 THEN concat('https://hero.example/', workbook) END AS link
FROM {grid_parts} p CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
UNION ALL
SELECT workbook, 'Email', 3, c, CASE c WHEN 0 THEN 'Field' WHEN 1 THEN 'Value' WHEN 2 THEN 'EN' ELSE 'FR' END, NULL
FROM (SELECT DISTINCT workbook FROM {grid_parts} g) w CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n
UNION ALL
SELECT workbook, 'Common', 10 + k, 0, CASE WHEN k = 1 THEN 'Included languages' WHEN k = 0 THEN 'Early → IT activate' ELSE concat('Row → ', CASE k WHEN 2 THEN 'FR' WHEN 3 THEN 'MX' WHEN 4 THEN 'XX' ELSE 'DE' END,
  CASE WHEN (workbook + k) % 2 = 0 THEN ' activate' ELSE '' END) END, NULL FROM {grid_parts} p WHERE k < 6
"""


def parsed(spark, sf):
    cells = load(spark, sf, "grid_cells")
    header = grid.header_languages(cells)
    values = grid.values_by_language(cells, header)
    return cells, header, values, grid.sheet_rows(cells, header, values)


WB = "(SELECT DISTINCT workbook FROM {grid_parts} g)"


@query(
    "grid01_header_row",
    f"""SELECT workbook, sheet, header_row, col, lang FROM (SELECT workbook, 'Brief' AS sheet, 2 AS header_row, c.col, c.lang FROM {WB} w, (VALUES (1, 'EN'), (2, 'FR'), (3, 'EN')) c(col, lang)
      UNION ALL SELECT workbook, 'Other', 1, c.col, c.lang FROM {WB} w, (VALUES (1, 'DE'), (2, 'IT')) c(col, lang) WHERE workbook % 3 = 0) x""",
)
def header_row(spark, sf):
    return parsed(spark, sf)[1].drop("label")


BLOCK_PARTS = """SELECT workbook, 'Brief' AS sheet, k, 3 + CASE WHEN k IN (0, 1) THEN 0 ELSE 2 END AS block_row, lang, CASE lang WHEN 'EN' THEN p_name ELSE concat(p_type, ' FR') END AS value
  FROM {grid_parts} p, (VALUES ('EN'), ('FR')) l(lang) WHERE k IN (0, 1, 2)"""


@query(
    "grid02_unpivot",
    """SELECT workbook, sheet, CAST(3 + k AS INTEGER) AS row, lang, value FROM (SELECT workbook, 'Brief' AS sheet, k, lang, CASE WHEN k IN (0, 1, 2, 7) THEN CASE lang WHEN 'EN' THEN p_name ELSE concat(p_type, ' FR') END
        WHEN k = 3 AND lang = 'FR' THEN concat('https://ww.example/', p_type) WHEN k = 4 AND lang = 'EN' THEN 'see link' WHEN k = 5 AND lang = 'EN' THEN 'one value' WHEN k = 6 THEN CASE lang WHEN 'EN' THEN 'EN' ELSE 'fr' END END AS value
      FROM {grid_parts} p, (VALUES ('EN'), ('FR')) l(lang)
      UNION ALL SELECT workbook, 'Other', k + 2, lang, p_name FROM {grid_parts} p, (VALUES ('DE'), ('IT')) l(lang) WHERE workbook % 3 = 0 AND k < 4) x WHERE value IS NOT NULL""",
)
def unpivot(spark, sf):
    return parsed(spark, sf)[2]


@query(
    "grid03_blocks",
    f"""SELECT workbook, sheet, CAST(block_row AS INTEGER) AS block_row, lang, string_agg(value, ' ' ORDER BY k) AS value, CASE WHEN block_row = 3 THEN 'Subject line' ELSE 'CTA 1' END AS block
      FROM ({BLOCK_PARTS}) b GROUP BY workbook, sheet, block_row, lang
      UNION ALL SELECT workbook, 'Other', CAST(5 + k AS INTEGER), lang, p_name, concat('Body ', k) FROM {{grid_parts}} p, (VALUES ('DE'), ('IT')) l(lang) WHERE workbook % 3 = 0 AND k < 4""",
)
def blocks(spark, sf):
    """GRID-3 and GRID-5."""
    _, _, values, rows = parsed(spark, sf)
    return grid.grid_blocks(rows, values)


@query(
    "grid04_link_rows",
    """SELECT workbook, 'Brief' AS sheet, 'CTA 1' AS block, CASE k WHEN 3 THEN 'WW' ELSE 'CN' END AS market, CASE k WHEN 3 THEN concat('https://ww.example/', p_type) ELSE 'https://cn.example/x' END AS url
      FROM {grid_parts} p WHERE k IN (3, 4)""",
)
def link_rows(spark, sf):
    cells, _, _, rows = parsed(spark, sf)
    return grid.grid_links(cells, rows)


@query(
    "grid05_row_kinds",
    """SELECT workbook, CAST(3 + k AS INTEGER) AS row, CASE k WHEN 0 THEN 'block' WHEN 2 THEN 'block' WHEN 3 THEN 'link' WHEN 4 THEN 'link' WHEN 5 THEN 'label' WHEN 6 THEN 'echo' ELSE 'continuation' END AS kind,
      CASE WHEN k < 2 THEN 3 WHEN k = 2 THEN 5 END AS block_row, 'Brief' AS sheet FROM {grid_parts} p
      UNION ALL SELECT workbook, CAST(5 + k AS INTEGER), 'block', CAST(5 + k AS INTEGER), 'Other' FROM {grid_parts} p WHERE workbook % 3 = 0 AND k < 4""",
)
def row_kinds(spark, sf):
    rows = parsed(spark, sf)[3]
    return rows.select("workbook", "row", "kind", "block_row", "sheet")


@query(
    "grid11_best_sheet",
    f"""SELECT workbook, CASE WHEN workbook % 3 = 0 THEN 'Other' ELSE 'Brief' END AS sheet, CAST(CASE WHEN workbook % 3 = 0 THEN 4 ELSE 2 END AS BIGINT) AS n_blocks FROM {WB} w""",
)
def best_sheet(spark, sf):
    cells, _, values, rows = parsed(spark, sf)
    sheets = cells.select("workbook", "sheet").distinct().withColumn(
        "sheet_ord", F.when(F.col("sheet") == "Brief", 0).otherwise(1)
    )
    return grid.best_sheet(grid.grid_blocks(rows, values), sheets)


@query("grid13_campaign_name", f"SELECT workbook, 'Brief' AS sheet, concat('ADHOC_', workbook) AS name FROM {WB} w")
def campaign_name(spark, sf):
    cells, header, _, _ = parsed(spark, sf)
    return grid.campaign_name(cells, header)


@query(
    "grid10_activated_languages",
    """SELECT workbook, lang FROM (SELECT workbook, CASE k WHEN 2 THEN 'FR' WHEN 3 THEN 'MX' ELSE 'DE' END AS lang FROM {grid_parts} p WHERE k IN (2, 3, 5) AND (workbook + k) % 2 = 0) x GROUP BY ALL""",
)
def activated(spark, sf):
    common = load(spark, sf, "field_cells").where("sheet = 'Common'")
    return grid.activated_languages(common).select("workbook", "lang")


def field_value(spark, sf):
    cells = load(spark, sf, "field_cells").where("sheet = 'Email'")
    master = cells.select("workbook").distinct().withColumn("lang", F.lit("EN"))
    return grid.field_value_rows(cells, master)


FV_BLOCKS = """SELECT workbook, CAST(4 + k AS INTEGER) AS row, CASE k WHEN 0 THEN 'Subject Line' WHEN 1 THEN 'CTA 1' ELSE 'Body' END AS block, CASE WHEN k = 0 AND workbook % 2 = 0 THEN p_name || ' 2'
    WHEN k = 0 THEN 'Dear Client, discover…' WHEN k = 1 THEN 'Shop  Now' ELSE 'Shop now' END AS en, CASE WHEN k = 0 AND workbook % 2 = 0 THEN p_name || ' 3' END AS fr, NOT (k = 0 AND workbook % 2 = 0) AS placeholder FROM {grid_parts} p WHERE k IN (0, 1, 5)"""


@query("grid06_field_value_blocks", FV_BLOCKS)
def field_value_blocks(spark, sf):
    found, _ = field_value(spark, sf)
    return found.select("workbook", "row", "block", F.col("vals")["EN"].alias("en"), F.col("vals")["FR"].alias("fr"), "placeholder")


@query(
    "grid07_placeholder_drop",
    f"""SELECT workbook, block FROM ({FV_BLOCKS}) b WHERE NOT placeholder UNION ALL
      SELECT workbook, CASE k WHEN 2 THEN 'CTA 1' ELSE 'Hero - WOMEN' END FROM {{grid_parts}} p WHERE k = 3 OR (k = 2 AND workbook % 2 = 0)""",
)
def placeholder_drop(spark, sf):
    kept_blocks, kept_links = grid.drop_placeholders(*field_value(spark, sf))
    return kept_blocks.select("workbook", "block").unionByName(kept_links.select("workbook", "block"))


@query(
    "grid08_cta_labels",
    """SELECT workbook, CASE k WHEN 2 THEN 'CTA 1' ELSE 'Hero - WOMEN' END AS block, CASE k WHEN 2 THEN CASE WHEN workbook % 2 = 0 THEN concat('https://shop.example/', workbook) ELSE 'https://brand.com/x' END
      ELSE concat('https://hero.example/', workbook) END AS url, CASE k WHEN 2 THEN 'CTA 1' END AS label_block FROM {grid_parts} p WHERE k IN (2, 3)""",
)
def cta_labels(spark, sf):
    found, links = field_value(spark, sf)
    return grid.pair_cta_labels(links, found).select("workbook", "block", "url", "label_block")


@query(
    "grid09_likely_template",
    """SELECT workbook, count(*) AS n, count(*) FILTER (WHERE placeholder) AS hits, count(*) FILTER (WHERE placeholder) >= ceil(count(*) / 2.0) AS likely_template FROM (
      SELECT workbook, placeholder FROM (""" + FV_BLOCKS + """) b UNION ALL SELECT workbook, false FROM {grid_parts} p WHERE k = 0 AND workbook % 2 = 0) v GROUP BY 1""",
)
def likely_template(spark, sf):
    found, links = field_value(spark, sf)
    values = found.select("workbook", "sheet", F.explode("vals").alias("lang", "value"))
    return grid.likely_template(values, links).select("workbook", "n", "hits", "likely_template")


# ---- parse plans: flat relations, of which a plan's row is gathered; each remainder of 11 has its own fault --------

RELATIONS["plan_heads"] = """SELECT workbook AS plan_id, workbook, CASE WHEN workbook % 11 = 1 THEN 'Nowhere' ELSE 'Brief' END AS content_sheet, CASE WHEN workbook % 11 = 2 THEN 4 ELSE 3 END AS header_row
  FROM (SELECT DISTINCT workbook FROM {grid_parts} g) w"""
RELATIONS["plan_langs"] = """SELECT plan_id, n AS ord, CASE n WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS col,
    CASE n WHEN 1 THEN 'EN' WHEN 2 THEN CASE plan_id % 11 WHEN 3 THEN 'XX' WHEN 4 THEN 'English' ELSE 'French (FR)' END ELSE 'IT' END AS lang
  FROM {plan_heads} h CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE n < 3 OR plan_id % 2 = 0"""
RELATIONS["plan_maps"] = """SELECT plan_id, n AS ord, CASE WHEN n = 1 AND plan_id % 11 = 5 THEN 5 ELSE CASE n WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 7 WHEN 4 THEN 8 ELSE 9 END END AS row,
    CASE n WHEN 1 THEN 'subject  LINE' WHEN 2 THEN 'CTA 1' WHEN 3 THEN 'WW Linkthrough' WHEN 4 THEN 'cn linkthrough (cn)' ELSE 'Memo' END AS raw_label,
    CASE WHEN plan_id % 11 <> 7 AND n < 3 THEN CASE n WHEN 1 THEN 'Subject line' ELSE 'CTA 1' END END AS canonical_block, n IN (3, 4) AS is_url_row, CASE n WHEN 4 THEN 'cn' END AS url_market,
    CASE WHEN n = 5 AND plan_id % 11 <> 6 THEN 'no copy' WHEN n < 3 AND plan_id % 11 = 7 THEN 'left out' END AS skip_reason
  FROM {plan_heads} h CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k"""
RELATIONS["plan_checks"] = """SELECT plan_id, 1 AS ord, 'C4' AS cell, CASE plan_id % 11 WHEN 8 THEN 'invented text' ELSE '  fr ' END AS snippet FROM {plan_heads} h
  UNION ALL SELECT plan_id, 2, CASE plan_id % 11 WHEN 9 THEN 'B4x' ELSE 'D6' END, 'LATER en' FROM {plan_heads} h
  UNION ALL SELECT plan_id, 3, 'B4', substring(p_name, 2, 5) FROM {plan_heads} h, {grid_parts} p WHERE p.workbook = plan_id AND k = 0 AND plan_id % 3 = 0"""


def plan_table(spark, sf):
    def gathered(name: str, fields: list[str]):
        return load(spark, sf, name).groupBy("plan_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))), lambda r: r["x"]).alias(name)
        )

    return (
        load(spark, sf, "plan_heads").withColumn("label_col", F.lit("A"))
        .join(gathered("plan_langs", ["col", "lang"]), "plan_id")
        .join(gathered("plan_maps", ["row", "raw_label", "canonical_block", "is_url_row", "url_market", "skip_reason"]), "plan_id")
        .join(gathered("plan_checks", ["cell", "snippet"]), "plan_id")
        .withColumnsRenamed({"plan_langs": "lang_columns", "plan_maps": "field_mappings", "plan_checks": "sample_checks"})
    )


FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
PLAN_ERRORS = f"""WITH cells AS (SELECT workbook, sheet, row, col, trim(coalesce(text, '')) AS text, link FROM {{grid_cells}} x),
  h AS (SELECT * FROM {{plan_heads}} x), good AS (SELECT * FROM h WHERE (workbook, content_sheet) IN (SELECT workbook, sheet FROM cells)),
  m AS (SELECT m.*, workbook, content_sheet, header_row FROM {{plan_maps}} m JOIN good USING (plan_id)),
  l AS (SELECT l.*, CASE lang WHEN 'EN' THEN 'EN' WHEN 'English' THEN 'EN' WHEN 'French (FR)' THEN 'FR' WHEN 'IT' THEN 'IT' END AS canon FROM {{plan_langs}} l JOIN good USING (plan_id)),
  s AS (SELECT s.plan_id, s.cell, contains({FOLD.format("coalesce(c.text, '')")}, {FOLD.format("snippet")}) AS found FROM {{plan_checks}} s JOIN good USING (plan_id) LEFT JOIN cells c ON c.workbook = good.workbook
    AND c.sheet = content_sheet AND c.row = CAST(substring(cell, 2) AS INTEGER) - 1 AND c.col = ascii(cell) - 65 WHERE regexp_matches(cell, '^[A-Z]{{1,2}}\\d{{1,4}}$')),
  e AS (SELECT plan_id, 'unknown sheet' AS error, content_sheet AS detail FROM h WHERE plan_id NOT IN (SELECT plan_id FROM good)
    UNION ALL SELECT m.plan_id, 'label mismatch', concat('A', m.row) FROM m LEFT JOIN cells c ON c.workbook = m.workbook AND c.sheet = m.content_sheet AND c.row = m.row - 1 AND c.col = 0
      WHERE {FOLD.format("coalesce(c.text, '')")} <> {FOLD.format("raw_label")}
    UNION ALL SELECT plan_id, 'skip reason missing', concat(row) FROM m WHERE canonical_block IS NULL AND NOT is_url_row AND skip_reason IS NULL
    UNION ALL SELECT plan_id, 'unknown language', lang FROM l WHERE canon IS NULL
    UNION ALL SELECT plan_id, 'duplicate language', canon FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, canon ORDER BY ord) AS nth FROM l WHERE canon IS NOT NULL) d WHERE nth > 1
    UNION ALL SELECT plan_id, 'snippet not found', cell FROM s WHERE NOT found
    UNION ALL SELECT good.plan_id, 'too few snippets', concat(count(*) FILTER (WHERE found)) FROM good LEFT JOIN s USING (plan_id) GROUP BY 1 HAVING count(*) FILTER (WHERE found) < 2
    UNION ALL SELECT plan_id, 'header not above the rows', concat(any_value(header_row)) FROM m GROUP BY 1 HAVING any_value(header_row) >= min(row)
    UNION ALL SELECT plan_id, 'no block', NULL FROM m GROUP BY 1 HAVING count(canonical_block) = 0)"""


@query("grid12_plan_errors", PLAN_ERRORS + " SELECT * FROM e")
def plan_errors(spark, sf):
    """GRID-12: good plans and plans with each fault, against their workbooks."""
    return parse_plan.plan_errors(plan_table(spark, sf), load(spark, sf, "grid_cells"))


@query(
    "grid12_applied_plans",
    PLAN_ERRORS + """, ok AS (SELECT * FROM good WHERE plan_id NOT IN (SELECT plan_id FROM e)),
      v AS (SELECT m.plan_id, m.row, m.raw_label, m.canonical_block, m.is_url_row, m.url_market, l.ord, l.canon, l.lang, c.text, c.link FROM m JOIN ok USING (plan_id) JOIN l USING (plan_id)
        JOIN cells c ON c.workbook = m.workbook AND c.sheet = m.content_sheet AND c.row = m.row - 1 AND c.col = ascii(l.col) - 65),
      b AS (SELECT * FROM v WHERE canonical_block IS NOT NULL AND text <> '')
      SELECT plan_id, 'block' AS part, row, raw_label AS name, canon AS key, text AS value FROM b
      UNION ALL SELECT plan_id, 'link', row, any_value(raw_label), upper(coalesce(any_value(url_market), 'WW')), min_by(coalesce(CASE WHEN text LIKE 'http%' THEN text END, link), ord) FROM v
        WHERE is_url_row AND (text LIKE 'http%' OR link IS NOT NULL) AND plan_id IN (SELECT plan_id FROM b) GROUP BY plan_id, row
      UNION ALL SELECT plan_id, 'language', CAST(ord - 1 AS INTEGER), NULL, canon, any_value(CASE WHEN lang <> canon THEN lang END) FROM b GROUP BY plan_id, ord, canon""",
)
def applied_plans(spark, sf):
    """GRID-12: what the good plans read, in one long table."""
    blocks, links, languages = parse_plan.apply_plans(plan_table(spark, sf), load(spark, sf, "grid_cells"))
    columns = ["plan_id", "part", "row", "name", "key", "value"]
    return (
        blocks.select("plan_id", F.lit("block").alias("part"), "row", F.col("block").alias("name"), F.explode("vals").alias("key", "value"))
        .unionByName(links.select("plan_id", F.lit("link"), "row", "block", "market", "url").toDF(*columns))
        .unionByName(languages.select("plan_id", F.lit("language"), "ord", F.lit(None).cast("string"), "lang", "label").toDF(*columns))
    )
