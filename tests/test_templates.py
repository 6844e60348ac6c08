"""Revisions of templates, layout checks and the order of labels on hand-made rows."""

from pyspark.sql import functions as F

from sparkproof.operators import reports, template

HEAD = "template_id long, channel string, header_row int, field_col int, desc_col int, value_col int, first_lang_col int, glossary string"
FIELD = "template_id long, ord int, key string, label string, kind string, required boolean, translatable boolean, row_offset int, aliases array<string>, note string"


def tree(spark, fields, glossary=None, codes=("EN", "FR"), names=("English", "French")):
    heads = spark.createDataFrame([(1, "EMAIL", 3, 0, 1, 2, 3, glossary)], HEAD)
    rows = spark.createDataFrame([(1, i, *f) for i, f in enumerate(fields)], FIELD)
    code = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "template_id long, ord int, code string")
    name = spark.createDataFrame([(1, i, c, n, None) for i, (c, n) in enumerate(zip(codes, names))], "template_id long, ord int, code string, name string, note string")
    return template.revision_tree(heads, rows, code, name)


A = ("a", "Label", "text", True, True, 1, ["x"], None)
B = ("b", "Body", "text", False, True, 2, None, "note")


def changes(spark, before, after):
    return {(r.part, r.item, r.change) for r in template.revision_changes(before, after).collect()}


def test_revisions(spark):
    base = tree(spark, [A, B])
    name = lambda t: t.first().revision
    assert name(base) == name(tree(spark, [A, B])) == name(tree(spark, [A, B], glossary=""))
    assert name(base) == name(tree(spark, [A, (*B[:6], [], B[7])])) and len(name(base)) == 12
    # What one part loses another can't gain unseen.
    assert name(base) != name(tree(spark, [("a", "Labe", "ltext", *A[3:]), B]))
    assert changes(spark, base, tree(spark, [A, B])) == set()
    assert changes(spark, base, tree(spark, [B, A])) == {("order", None, "changed")}
    assert changes(spark, base, tree(spark, [A, ("b", "Other", *B[2:])])) == {("field", "b", "changed")}
    assert changes(spark, base, tree(spark, [A, ("c", *B[1:])], glossary="words")) == {("field", "b", "removed"), ("field", "c", "added"), ("head", None, "changed")}
    assert changes(spark, base, tree(spark, [A, B], codes=("FR", "EN"), names=("French", "English"))) == {("columns", None, "changed"), ("languages", None, "changed")}
    assert changes(spark, base, tree(spark, [])) == {("field", "a", "removed"), ("field", "b", "removed")}


def test_layout_and_vanished_keys(spark):
    heads = spark.createDataFrame([(1, 0, 1, 2, 3), (2, 0, 0, 4, 3), (3, 1, 1, 1, 9)], "template_id long, field_col int, desc_col int, value_col int, first_lang_col int")
    codes = spark.createDataFrame([(1, "EN"), (2, "EN"), (2, "FR")], "template_id long, code string")
    assert {tuple(r) for r in template.layout_problems(heads, codes).select("template_id", "problem", "item").collect()} == {
        (2, "shared column", "FIELD, DESCRIPTION"), (2, "column inside the language block", "VALUE"),
        (3, "shared column", "FIELD, DESCRIPTION"), (3, "shared column", "FIELD, VALUE"), (3, "shared column", "DESCRIPTION, VALUE"),
    }
    now = spark.createDataFrame([(1, "a"), (1, "b")], "template_id long, key string")
    old = spark.createDataFrame([(1, "a"), (1, "z"), (1, "z"), (9, "q")], "template_id long, key string")
    assert [(r.template_id, r.item) for r in template.vanished_keys(now, old).collect()] == [(1, "z")]


def test_labels_in_french_order(spark):
    labels = ["zoo", "Zoo", "École", "ecole", "école", "Ecole", "œuvre", "oeuf", "offre", "côté", "cote", "coté", "côte"]
    rows = spark.createDataFrame([(1, w) for w in labels], "campaign_id long, label string")
    got = [r.label for r in reports.in_label_order(rows).orderBy("position").collect()]
    assert got == ["cote", "coté", "côte", "côté", "ecole", "Ecole", "école", "École", "oeuf", "œuvre", "offre", "zoo", "Zoo"]
    assert got != [r.label for r in rows.orderBy(F.col("label")).collect()]
