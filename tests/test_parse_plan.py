"""Parse plans on a hand-made workbook: a good plan, each fault, and what is read."""

from sparkproof.operators import grid, parse_plan

CELLS = [
    ("Brief", 5, 0, "FIELD", None), ("Brief", 6, 0, "Subject Line (male)", None), ("Brief", 6, 3, "Bienvenido a la casa", None),
    ("Brief", 7, 0, "CTA 1 Label", None), ("Brief", 7, 3, "Compra", None), ("Brief", 7, 4, "Shop now", None),
    ("Brief", 8, 0, "Hero / CTA URL", None), ("Brief", 8, 3, "see link", "https://brand.com/x"), ("Brief", 8, 4, " https://shop.example/a ", None),
    ("Brief", 9, 0, "Mock up", None), ("Brief", 10, 0, "Body", None), ("Brief", 10, 27, "far right", None), ("Other", 0, 0, "x", None),
]


def plan(**changes):
    base = dict(
        plan_id=1, workbook=1, content_sheet="Brief", header_row=6, label_col="A",
        lang_columns=[("D", "MX"), ("E", "en-GB")],
        field_mappings=[
            (7, " subject line  (MALE)", "Subject line", False, None, None), (8, "CTA 1 Label", "CTA 1", False, None, None),
            (9, "Hero / CTA URL", None, True, None, None), (10, "Mock up", None, False, None, "no copy"),
        ],
        sample_checks=[("D7", "bienvenido  A"), ("D8", "compra")],
    )
    return tuple((base | changes).values())


def run(spark, *plans):
    cells = spark.createDataFrame([(1, *c) for c in CELLS] * 2, "workbook long, sheet string, row int, col int, text string, link string")
    return spark.createDataFrame(list(plans), parse_plan.PLAN_DDL), cells


def errors(spark, **changes):
    return {(r.error, r.detail) for r in parse_plan.plan_errors(*run(spark, plan(**changes))).collect()}


def test_faults(spark):
    maps = plan()[6]
    assert errors(spark) == set()
    assert errors(spark, content_sheet="Grid", header_row=99) == {("unknown sheet", "Grid")}
    assert errors(spark, field_mappings=[(8, *maps[0][1:]), *maps[1:]]) == {("label mismatch", "A8")}
    assert errors(spark, field_mappings=[*maps[:3], (10, "Mock up", None, False, None, "")]) == {("skip reason missing", "10")}
    assert errors(spark, lang_columns=[("D", "XX"), ("E", "EN")]) == {("unknown language", "XX")}
    assert errors(spark, lang_columns=[("D", "MX"), ("E", "Spanish"), ("F", "FR")]) == {("duplicate language", "ES")}
    assert errors(spark, sample_checks=[("D7", "invented"), ("D8", "Compra"), ("D7", "la casa")]) == {("snippet not found", "D7")}
    assert errors(spark, sample_checks=[("D7", "invented"), ("d8", "Compra")]) == {("snippet not found", "D7"), ("too few snippets", "0")}
    assert errors(spark, header_row=7) == {("header not above the rows", "7")}
    assert errors(spark, field_mappings=[(9, "Hero / CTA URL", None, True, None, None)], sample_checks=[("D7", "casa"), ("E8", "shop")]) == {("no block", None)}


def test_applied(spark):
    far = plan(plan_id=2, lang_columns=[("AB", "FR")], field_mappings=[(11, "Body", "Body", False, None, None)], sample_checks=[("AB11", "far"), ("AB11", "right")])
    bad = plan(plan_id=3, header_row=50)
    empty = plan(plan_id=4, lang_columns=[("Z", "FR")])
    blocks, links, languages = parse_plan.apply_plans(*run(spark, plan(), far, bad, empty))
    assert {(r.plan_id, r.row, r.block, tuple(r.vals.items())) for r in blocks.collect()} == {
        (1, 7, " subject line  (MALE)", (("ES", "Bienvenido a la casa"),)), (1, 8, "CTA 1 Label", (("ES", "Compra"),)), (2, 11, "Body", (("FR", "far right"),)),
    }
    assert [tuple(r) for r in links.collect()] == [(1, 9, "Hero / CTA", "WW", "https://shop.example/a")]
    assert {tuple(r) for r in languages.collect()} == {(1, 0, "ES", "MX"), (2, 0, "FR", None)}
    sheets = {"workbook": "plan_id"}
    named = [df.withColumnsRenamed({v: k for k, v in sheets.items()}).withColumn("sheet", grid.F.lit("Brief")) for df in (links, blocks)]
    assert [r.label_block for r in grid.pair_cta_labels(*named).collect()] == ["CTA 1 Label"]
