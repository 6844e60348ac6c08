"""GRID-12: parse plans, given as rows, are checked against a workbook's cells and then applied to them.

A plan names a content sheet, its header row, the column of labels, the columns of languages, what each
labelled row is, and cells with a piece of their text as proof that the plan was made for this workbook.
Rows are counted from 1 and columns named by letters, as a user sees them; cells count both from 0.

A plan is bounded (some sixty rows by fifteen languages), so it stays one row: the cells that it names are
found by one equi-join, come back as a map, and all checks are columns on the plan's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.languages import LABELS, canon_lang
from sparkproof.functions.names import column_index
from sparkproof.functions.text import fold_space
from sparkproof.operators.findings import array_rows, nonempty
from sparkproof.operators.grid import HTTP, cell_text, is_placeholder_text, is_placeholder_url

#: What a plan's row holds; `plan_id` may be any key.
PLAN_DDL = (
    "plan_id long, workbook long, content_sheet string, header_row int, label_col string, "
    "lang_columns array<struct<col:string,lang:string>>, "
    "field_mappings array<struct<row:int,raw_label:string,canonical_block:string,is_url_row:boolean,url_market:string,skip_reason:string>>, "
    "sample_checks array<struct<cell:string,snippet:string>>"
)
#: So many pieces of text must be found.
LEAST_SNIPPETS = 2
CELL = r"^([A-Z]{1,2})(\d{1,4})$"


def norm_label(c: Column) -> Column:
    return F.lower(fold_space(F.coalesce(c, F.lit(""))))


def place(row: Column, letters: Column) -> Column:
    """Key of a cell: its row and column from 0."""
    return F.concat_ws(":", (row - 1).cast("string"), column_index(letters).cast("string"))


def check_place(cell: Column) -> Column:
    """Key of a cell named like B12; null where it isn't named so."""
    return F.when(cell.rlike(CELL), place(F.regexp_extract(cell, CELL, 2).cast("int"), F.regexp_extract(cell, CELL, 1)))


def with_cells(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """Plans with `at`, a map from the places that they name to (text, link), and `sheet_found`.

    Of repeated cells the smallest text counts. Cells that a plan doesn't name are never gathered."""
    maps, langs = F.col("field_mappings"), F.col("lang_columns")
    labels = F.transform(maps, lambda m: place(m["row"], F.col("label_col")))
    values = F.flatten(F.transform(maps, lambda m: F.transform(langs, lambda c: place(m["row"], c["col"]))))
    checks = F.array_compact(F.transform("sample_checks", lambda s: check_place(s["cell"])))
    wanted = plans.select(
        "plan_id", "workbook", F.col("content_sheet").alias("sheet"), F.explode(F.array_distinct(F.concat(labels, values, checks))).alias("place")
    )
    there = cells.select(
        "workbook", "sheet", F.concat_ws(":", F.col("row").cast("string"), F.col("col").cast("string")).alias("place"),
        F.struct(cell_text(F.col("text")).alias("text"), "link").alias("cell"),
    )
    found = (
        wanted.join(there, ["workbook", "sheet", "place"]).groupBy("plan_id", "place").agg(F.min("cell").alias("cell"))
        .groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "cell"))).alias("at"))
    )
    sheets = cells.select("workbook", F.col("sheet").alias("content_sheet")).distinct().withColumn("sheet_found", F.lit(True))
    return plans.join(found, "plan_id", "left").join(sheets, ["workbook", "content_sheet"], "left").withColumn(
        "sheet_found", F.coalesce("sheet_found", F.lit(False))
    )


def text_at(key: Column) -> Column:
    return F.coalesce(F.try_element_at("at", key)["text"], F.lit(""))


def error(what: str, detail: Column) -> Column:
    return F.struct(F.lit(what).alias("error"), detail.cast("string").alias("detail"))


def plan_errors(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (plan_id, error, detail) of what speaks against a plan; a good one has none.

    Where the sheet is missing that is the only error. Cells that aren't named like B12 are passed over,
    but then miss among the snippets that must be found."""
    rows = with_cells(plans, cells)
    maps, langs, checks = F.col("field_mappings"), F.col("lang_columns"), F.col("sample_checks")
    said = lambda m: F.coalesce(m["canonical_block"], F.lit("")) == ""
    wrong_label = F.transform(
        F.filter(maps, lambda m: norm_label(text_at(place(m["row"], F.col("label_col")))) != norm_label(m["raw_label"])),
        lambda m: error("label mismatch", F.concat(F.col("label_col"), m["row"].cast("string"))),
    )
    no_reason = F.transform(
        F.filter(maps, lambda m: said(m) & ~F.coalesce(m["is_url_row"], F.lit(False)) & (F.coalesce(m["skip_reason"], F.lit("")) == "")),
        lambda m: error("skip reason missing", m["row"]),
    )
    known = F.transform(langs, lambda c: F.struct(c["lang"].alias("lang"), canon_lang(c["lang"]).alias("canon")))
    strange = F.transform(F.filter(known, lambda c: ~c["canon"].isin(*LABELS)), lambda c: error("unknown language", c["lang"]))
    good = F.transform(F.filter(known, lambda c: c["canon"].isin(*LABELS)), lambda c: c["canon"])
    twice = F.transform(
        F.filter(good, lambda c, i: F.array_position(good, c) <= i), lambda c: error("duplicate language", c)
    )
    named = F.filter(checks, lambda s: s["cell"].rlike(CELL))
    held = lambda s: F.contains(norm_label(text_at(check_place(s["cell"]))), norm_label(s["snippet"]))
    missing = F.transform(F.filter(named, lambda s: ~held(s)), lambda s: error("snippet not found", s["cell"]))
    n_found = F.size(F.filter(named, held))
    few = F.when(n_found < LEAST_SNIPPETS, error("too few snippets", n_found))
    first = F.array_min(F.transform(maps, lambda m: m["row"]))
    low = F.when(F.col("header_row") >= first, error("header not above the rows", F.col("header_row")))
    aimless = F.when(~F.exists(maps, lambda m: ~said(m)), error("no block", F.lit(None)))
    all_ = F.concat(wrong_label, no_reason, strange, twice, missing, F.array_compact(F.array(few, low, aimless)))
    errors = F.when(~F.col("sheet_found"), F.array(error("unknown sheet", F.col("content_sheet")))).otherwise(all_)
    return array_rows(rows.select("plan_id", errors.alias("errors")), "errors", "error", "plan_id")


def apply_plans(plans: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What good plans read: blocks (plan_id, row, block, vals), links (plan_id, row, block, market, url) and
    languages (plan_id, ord, lang, label).

    Plans with an error give nothing, nor do those that find no value. Blocks keep the sheet's own label.
    The first column of a language counts; template texts and URLs are passed over. A language is listed
    if a block has it; its label is null where it is the code itself."""
    bad = plan_errors(plans, cells).select("plan_id").distinct()
    rows = with_cells(plans.join(bad, "plan_id", "left_anti"), cells)
    langs = F.transform("lang_columns", lambda c: F.struct(c["col"].alias("col"), canon_lang(c["lang"]).alias("lang"), c["lang"].alias("label")))
    rows = rows.withColumn("langs", langs)

    def value(m: Column, c: Column) -> Column:
        return text_at(place(m["row"], c["col"]))

    def vals(m: Column) -> Column:
        filled = F.filter("langs", lambda c: (value(m, c) != "") & ~is_placeholder_text(value(m, c)))
        return F.transform(filled, lambda c: F.struct(c["lang"].alias("lang"), value(m, c).alias("value")))

    def url(m: Column, c: Column) -> Column:
        link = F.try_element_at("at", place(m["row"], c["col"]))["link"]
        shown = value(m, c)
        return F.when(shown.rlike(HTTP) & ~is_placeholder_url(shown), shown).when(nonempty(link) & ~is_placeholder_url(link), link)

    is_url = lambda m: F.coalesce(m["is_url_row"], F.lit(False))
    copy = F.filter("field_mappings", lambda m: ~is_url(m) & nonempty(m["canonical_block"]))
    blocks = F.filter(
        F.transform(copy, lambda m: F.struct(m["row"].alias("row"), m["raw_label"].alias("block"), vals(m).alias("vals"))),
        lambda b: F.size(b["vals"]) > 0,
    )
    links = F.filter(
        F.transform(
            F.filter("field_mappings", is_url),
            lambda m: F.struct(
                m["row"].alias("row"), F.regexp_replace(m["raw_label"], r"(?i)\s+URL.*$", "").alias("block"),
                F.upper(F.coalesce(m["url_market"], F.lit("WW"))).alias("market"),
                F.get(F.array_compact(F.transform("langs", lambda c: url(m, c))), 0).alias("url"),
            ),
        ),
        lambda x: x["url"].isNotNull(),
    )
    read = rows.withColumns({"blocks": blocks, "links": links}).where(F.size("blocks") > 0)
    used = F.filter(
        F.transform("langs", lambda c, i: F.struct(i.alias("ord"), c["lang"].alias("lang"), F.nullif(c["label"], c["lang"]).alias("label"))),
        lambda c: F.exists("blocks", lambda b: F.exists(b["vals"], lambda v: v["lang"] == c["lang"])),
    )
    found = array_rows(read, "blocks", "row", "plan_id").withColumn("vals", F.map_from_entries("vals"))
    return found, array_rows(read, "links", "row", "plan_id"), array_rows(read.withColumn("used", used), "used", "lang", "plan_id")
