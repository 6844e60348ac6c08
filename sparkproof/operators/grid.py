"""Brief workbooks as cells (workbook, sheet, row, col, text, link) to blocks and planned links.

All windows run inside one sheet, which is a table of a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.functions.languages import canon_column
from sparkproof.operators.findings import nonempty

# Labels of copy blocks, link rows, metadata fields, channels and template texts.
KNOWN_BLOCK = (
    r"(?i)^(subject ?line|sl|pre-?header|ph|title|body(\s*\d+)?|copy\s*\d*|main copy|cta\s*\d*|header"
    r"|footer|banner(\s*\d+)?|hero)$"
)
LINK_ROW = r"(?i)^([A-Z][A-Z-]*)\s*Linkthrough"
META_FIELD = (
    r"(?i)^(campaign ?name|target|mock ?up|task |priority$|category$|sub ?category|launch date"
    r"|sending date|⚠️|content definition|email layout|season$|country$|note$|message (body|text)$"
    r"|content$|url\d$)"
)
CHANNEL = r"(?i)^(SMS|VMS|MMS|LINE|KKT|WECHAT|TASK|WHATSAPP)$"
PLACEHOLDER_URL = r"(?i)^https?://brand\.(com|cn)(/|$)"
PLACEHOLDER_TEXTS = [
    "dear [name], discover…", "dear client, discover…", "discover our exclusive collection…",
    "discover our new arrivals…",
    "encourage the client to visit the boutique within the next days.",
    "exclusive access to our new drop. shop now:", "explore the latest arrivals →",
    "follow up - phone order", "hello — promo message here", "shop now",
    "short editorial paragraph…", "spring — summer 2026", "text + image carousel",
    "text + image or article card", "800×600px or 720×720px jpg",
    "friendtalk: 800×600 | wide: 800×600", "wechat_card_gucci.jpg",
]
SHEET = ["workbook", "sheet"]
HTTP = r"(?i)^https?://"


def cell_text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def canon_header(raw: Column) -> Column:
    """Language key of a header cell, also with a parenthesis or blanks around its hyphen."""
    t = F.trim(raw)
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(t, r"\(.*?\)", ""), r"\s*-\s*", "-"))
    return F.coalesce(canon_column(t), canon_column(cleaned))


def is_placeholder_text(c: Column) -> Column:
    """SCL-25."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(*PLACEHOLDER_TEXTS)


def is_placeholder_url(c: Column) -> Column:
    return F.trim(c).rlike(PLACEHOLDER_URL)


def header_languages(cells: DataFrame) -> DataFrame:
    """GRID-1: header row per sheet with its language columns (col, lang, label)."""
    named = cells.where("col >= 1").withColumn("t", cell_text(F.col("text"))).where(
        F.col("t") != ""
    ).withColumn("lang", canon_header(F.col("t"))).where(F.col("lang").isNotNull())
    best = named.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy(*SHEET).agg(
        F.max_by("row", F.struct("n", -F.col("row"))).alias("row")
    )
    return named.join(best, [*SHEET, "row"]).select(
        *SHEET, F.col("row").alias("header_row"), "col", "lang", F.col("t").alias("label")
    )


def values_by_language(cells: DataFrame, header: DataFrame) -> DataFrame:
    """GRID-2: (row, lang, value); the first filled column of a language counts."""
    rows = cells.join(header.select(*SHEET, "header_row", "col", "lang"), [*SHEET, "col"]).where("row > header_row")
    filled = rows.withColumn("value", cell_text(F.col("text"))).where("value <> ''")
    return filled.groupBy(*SHEET, "row", "lang").agg(F.min_by("value", "col").alias("value"))


def sheet_rows(cells: DataFrame, header: DataFrame, values: DataFrame) -> DataFrame:
    """GRID-3..5: every row below the header with its kind and the block or label it belongs to."""
    start = header.groupBy(*SHEET).agg(F.first("header_row").alias("header_row"))
    rows = cells.join(start, SHEET).where("row > header_row").groupBy(*SHEET, "row").agg(
        F.max(F.when(F.col("col") == 0, cell_text(F.col("text")))).alias("label")
    ).withColumn("label", F.coalesce("label", F.lit("")))
    stats = values.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("filled"),
        F.bool_and(F.coalesce(canon_header(F.col("value")) == F.col("lang"), F.lit(False))).alias("echo"),
    )
    rows = rows.join(stats, [*SHEET, "row"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    label, n = F.col("label"), F.col("filled")
    kind = (
        F.when(label == "", "continuation")
        .when(label.rlike(LINK_ROW), "link")
        .when((n >= 2) & F.coalesce("echo", F.lit(False)), "echo")
        .when(((n >= 1) & label.rlike(KNOWN_BLOCK)) | (n >= 2), "block")
        .otherwise("label")
    )
    rows = rows.withColumn("kind", kind)
    before = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    turning = F.when(F.col("kind").isin("block", "label", "link"), F.struct("kind", "row"))
    named = F.when(F.col("kind").isin("block", "label"), F.struct("label", "row"))
    rows = rows.withColumn("_turn", F.last(turning, ignorenulls=True).over(before)).withColumn(
        "_named", F.last(named, ignorenulls=True).over(before)
    )
    return rows.select(
        *SHEET, "row", "label", "kind", "filled",
        F.when(F.col("_turn.kind") == "block", F.col("_turn.row")).alias("block_row"),
        F.col("_named.label").alias("last_label"), F.col("_named.row").alias("last_row"),
    )


def grid_blocks(rows: DataFrame, values: DataFrame) -> DataFrame:
    """GRID-3/5: block values with their continuation rows appended."""
    own = rows.where("kind IN ('block', 'continuation') AND block_row IS NOT NULL").select(*SHEET, "row", "block_row")
    parts = values.join(own, [*SHEET, "row"]).groupBy(*SHEET, "block_row", "lang").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), " "
        ).alias("value")
    )
    names = rows.where("kind = 'block'").select(*SHEET, F.col("row").alias("block_row"), F.col("label").alias("block"))
    return parts.join(names, [*SHEET, "block_row"])


def grid_links(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """GRID-4: planned links (block, market, url); the last row of a market counts."""
    link_rows = rows.where("kind = 'link' AND last_label IS NOT NULL")
    shown = cell_text(F.col("text"))
    url = F.when(shown.rlike(HTTP), shown).when(nonempty(F.col("link")), F.col("link")).when(shown != "", shown)
    urls = cells.where("col >= 1").withColumn("url", url).where("url IS NOT NULL").groupBy(*SHEET, "row").agg(
        F.min_by("url", "col").alias("url")
    )
    market = F.upper(F.regexp_extract("label", LINK_ROW, 1))
    return link_rows.join(urls, [*SHEET, "row"]).groupBy(
        *SHEET, F.col("last_label").alias("block"), market.alias("market")
    ).agg(F.max_by("url", "row").alias("url"))


def best_sheet(blocks: DataFrame, sheets: DataFrame) -> DataFrame:
    """GRID-11: the sheet with most blocks, the first on ties. `sheets` has (workbook, sheet, sheet_ord)."""
    counts = blocks.select(*SHEET, "block_row").distinct().groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_blocks"))
    return counts.join(sheets, SHEET).groupBy("workbook").agg(
        F.max_by(F.struct("sheet", "n_blocks"), F.struct("n_blocks", -F.col("sheet_ord"))).alias("b")
    ).select("workbook", "b.*")


def campaign_name(cells: DataFrame, before: DataFrame) -> DataFrame:
    """GRID-13: first filled cell right of 'Campaign name' above the header row, if it has an underscore."""
    start = before.groupBy(*SHEET).agg(F.min("header_row").alias("header_row"))
    head = cells.join(start, SHEET).where("row < header_row")
    on = head.where("col = 0").where(cell_text(F.col("text")).rlike("(?i)^campaign ?name$")).select(*SHEET, "row")
    vals = head.where("col >= 1").withColumn("v", cell_text(F.col("text"))).where("v <> ''")
    first = vals.join(on, [*SHEET, "row"]).groupBy(*SHEET, "row").agg(F.min_by("v", "col").alias("name"))
    return first.where(F.contains("name", F.lit("_"))).groupBy(*SHEET).agg(F.max_by("name", "row").alias("name"))


def activated_languages(cells: DataFrame) -> DataFrame:
    """GRID-10: languages marked as activated below 'INCLUDED LANGUAGES' on the common sheet."""
    rows = cells.groupBy(*SHEET, "row").agg(
        F.max(cell_text(F.col("text")).rlike("(?i)^INCLUDED LANGUAGES")).alias("starts"),
        F.min_by(cell_text(F.col("text")), F.when(F.contains("text", F.lit("→")), F.col("col"))).alias("arrow"),
        F.max(F.col("text").rlike("(?i)activate")).alias("activated"),
    )
    before = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    code = canon_column(F.regexp_extract("arrow", r"→\s*([A-Za-z]{2,3})", 1))
    on = rows.withColumn("inside", F.coalesce(F.max("starts").over(before), F.lit(False))).withColumn("lang", code)
    found = on.where("inside AND NOT starts AND activated AND lang IS NOT NULL").groupBy("workbook", "lang").agg(
        F.min("row").alias("ord")
    )
    every = cells.select("workbook").distinct()
    return every.join(found, "workbook", "left").select(
        "workbook", F.coalesce("lang", F.lit("EN")).alias("lang"), F.coalesce("ord", F.lit(0)).alias("ord")
    )


def field_value_rows(cells: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRID-6: FIELD/VALUE layout to (blocks, links), with placeholder flags of GRID-7.

    `master` is (workbook, lang): the language that a value without language columns belongs to."""
    up = cells.withColumn("t", cell_text(F.col("text"))).withColumn("u", F.upper("t"))
    heads = up.groupBy(*SHEET, "row").agg(
        F.min(F.when(F.col("u") == "FIELD", F.col("col"))).alias("field_col"),
        F.min(F.when(F.col("u") == "VALUE", F.col("col"))).alias("value_col"),
    ).where("value_col > field_col")
    head = heads.groupBy(*SHEET).agg(
        F.min_by(F.struct("row", "field_col", "value_col"), "row").alias("h")
    ).select(*SHEET, F.col("h.row").alias("header_row"), "h.field_col", "h.value_col")
    body = up.join(head, SHEET)
    langs = body.where("row = header_row AND col > value_col").withColumn("lang", canon_header(F.col("t"))).where(
        "lang IS NOT NULL"
    ).groupBy(*SHEET, "lang").agg(F.min("col").alias("col"))
    below = body.where("row > header_row")
    fields = below.where("col = field_col AND t <> ''").select(*SHEET, "row", F.col("t").alias("field"))
    stop = fields.where(F.col("field").rlike(CHANNEL)).groupBy(*SHEET).agg(F.min("row").alias("stop"))
    fields = fields.join(stop, SHEET, "left").where("stop IS NULL OR row < stop").drop("stop")
    values = below.where("col = value_col").select(
        *SHEET, "row", F.coalesce(F.nullif("t", F.lit("")), "link").alias("master"), F.col("link").alias("master_link")
    )
    by_lang = below.join(langs, [*SHEET, "col"]).select(*SHEET, "row", "col", "lang", "t", "link")
    cols = by_lang.groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("t") != "", F.struct("lang", "t")))).alias("vals"),
        F.min_by(
            F.when(F.col("t").rlike(HTTP) & ~is_placeholder_url(F.col("t")), F.col("t")).otherwise(F.col("link")),
            F.when((F.col("t").rlike(HTTP) & ~is_placeholder_url(F.col("t")))
                   | (nonempty(F.col("link")) & ~is_placeholder_url(F.col("link"))), F.col("col")),
        ).alias("lang_url"),
    )
    rows = fields.join(values, [*SHEET, "row"], "left").join(cols, [*SHEET, "row"], "left").join(master, "workbook")
    n = F.coalesce(F.size("vals"), F.lit(0))
    has = nonempty(F.col("master"))
    rows = rows.withColumn("is_url", F.col("field").rlike(r"(?i)^.+?\s+URL(\s*-\s*.+)?$") & (has | (n > 0)))
    target = F.when(F.col("master").rlike(HTTP), F.col("master")).otherwise(F.coalesce("master_link", "master"))
    url = F.coalesce(F.col("lang_url"), F.when(has, target))
    links = rows.where("is_url").withColumn("url", url).where(nonempty(F.col("url"))).select(
        *SHEET, "row", F.trim(F.regexp_replace("field", r"(?i)\s+URL(?![A-Za-z0-9_])", "")).alias("block"), "url",
        (F.col("lang_url").isNull() & is_placeholder_url(F.col("url"))).alias("placeholder"),
    )
    kept = rows.where(~F.col("is_url") & ~F.col("field").rlike(META_FIELD) & ((n > 0) | has))
    value_map = F.when(n > 0, F.col("vals")).otherwise(F.create_map(F.col("lang"), F.col("master")))
    blocks = kept.select(
        *SHEET, "row", F.col("field").alias("block"), value_map.alias("vals"),
        ((n == 0) & is_placeholder_text(F.col("master"))).alias("placeholder"),
    )
    return blocks, links


def drop_placeholders(blocks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRID-7: template texts go only where the sheet holds real content too."""
    both = blocks.select(*SHEET, "placeholder").unionByName(links.select(*SHEET, "placeholder"))
    real = both.groupBy(*SHEET).agg(F.max(~F.col("placeholder")).alias("has_real"))

    def keep(df: DataFrame) -> DataFrame:
        return df.join(real, SHEET).where("NOT (placeholder AND has_real)").drop("has_real", "placeholder")

    return keep(blocks), keep(links)


def pair_cta_labels(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """GRID-8: a CTA link takes the label of the CTA block with its number, or of the only one."""
    cta = blocks.where(F.col("block").rlike(r"(?i)^CTA \d")).select(
        *SHEET, F.col("row").alias("cta_row"), F.regexp_extract("block", r"(?i)^CTA (\d)", 1).alias("num"), F.col("block").alias("label_block")
    )
    only = cta.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"), F.first("label_block").alias("only_block"))
    first = cta.groupBy(*SHEET, "num").agg(F.min_by("label_block", "cta_row").alias("num_block"))
    num = F.regexp_extract("block", r"(?i)cta\s*(\d)", 1)
    rows = links.withColumn("num", num).join(first, [*SHEET, "num"], "left").join(only, SHEET, "left")
    label = F.when(F.col("num") != "", F.col("num_block")).when(F.col("n") == 1, F.col("only_block"))
    return rows.withColumn(
        "label_block", F.when(F.col("block").rlike("(?i)cta"), label)
    ).drop("num", "num_block", "n", "only_block")


def likely_template(values: DataFrame, links: DataFrame) -> DataFrame:
    """GRID-9: at least half the values are template texts, or two of them and two template URLs."""
    v = values.where(nonempty(F.trim("value"))).groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_placeholder_text(F.col("value"))).alias("hits")
    )
    u = links.groupBy(*SHEET).agg(F.count_if(is_placeholder_url(F.col("url"))).alias("url_hits"))
    joined = v.join(u, SHEET, "left").withColumn("url_hits", F.coalesce("url_hits", F.lit(0)))
    return joined.withColumn(
        "likely_template",
        (F.col("hits") >= F.ceil(F.col("n") / 2)) | ((F.col("hits") >= 2) & (F.col("url_hits") >= 2)),
    )
