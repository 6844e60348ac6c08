"""Reports of versions and what is shown of their findings, with plans that read and shuffle each table once."""

import pytest

from sparkproof.operators import reports

VERSIONS = "version_id string, campaign_id long, name string, language string, pinned_report_id string"
REPORTS = ("report_id string, campaign_id long, version_id string, version_no int, verdict string, critiques int, majeurs int, "
           "mineurs int, created_at int")


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture(scope="module")
def tables(spark):
    versions = spark.createDataFrame(
        [("a", 1, "A", "en", "r1"), ("b", 1, "B", "fr", "r9"), ("c", 2, "C", None, None), ("d", 2, "D\x01", "en", None)], VERSIONS)
    rows = [("r1", 1, "a", 1, "GO", 0, 1, 2, 5), ("r2", 1, "a", 1, "NO_GO", 3, 0, 0, 6), ("r3", 1, "b", 2, "GO", 0, 0, 0, 7),
            ("r3", 1, "b", 2, "GO", 0, 0, 0, 7), ("r4", 1, "b", 2, "NO_GO", 1, 0, 0, None), ("r5", 2, "d", 1, "NO_GO", 2, 0, 0, 1)]
    return versions, spark.createDataFrame(rows, REPORTS)


def test_own_report(tables):
    """WIN-3: the pinned report if it is the version's, else the latest; one row for each version."""
    got = {r["version_id"]: (r["report_id"], r["verdict"]) for r in reports.with_own_report(*tables, "verdict").collect()}
    assert got == {"a": ("r1", "GO"), "b": ("r3", "GO"), "c": (None, None), "d": ("r5", "NO_GO")}


def test_qa_sheet_shows_the_first_findings(spark, tables):
    """SNK-3: four bullets by seq and the number of others, however many findings and wherever they lie."""
    found = [("r5", 1000 - i, None, "liens", f"m{1000 - i}", None) for i in range(1000)]
    found += [("r1", 2, None, "liens", "two", None), ("r1", 1, None, "liens", "one", "accepte"), ("no report of c", 1, None, "liens", "x", None)]
    findings = spark.createDataFrame(found, "report_id string, seq int, title string, category string, message string, review string").repartition(3)
    got = {r["version_id"]: (r["name"], r["ok_ko"], r["feedback"]) for r in reports.qa_sheet(*tables, findings).collect()}
    line = "• Problem in a link: "
    assert got["d"] == ("D", "KO", "\n".join(f"{line}m{i}" for i in range(1, 5)) + "\n(+996 more in the Findings tab)")
    assert got["a"] == ("A", "OK", f"{line}two") and got["b"] == ("B", "OK", "") and got["c"] == ("C", "", "Not analyzed yet")


def test_qa_sheet_reads_each_table_once(spark):
    from sparkproof.plans import load_all

    out = load_all().QUERIES["snk03_qa_sheet"](spark, "/root/testdata/sf0.001")
    assert scans(out) == 3 and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_verdict_per_language_reads_each_table_once(spark):
    """AGG-4: versions go from their report to their language; they were read again to get it."""
    from sparkproof.plans import load_all

    out = load_all().QUERIES["agg04_verdict_per_language"](spark, "/root/testdata/sf0.001")
    assert scans(out) == 5  # orders and customers for the keys; line items as versions, reports and findings


def test_versions_without_report_have_no_counts(spark, tables):
    """AGG-4: what the key of a version without a report meets counts for nothing."""
    versions, found = tables
    expected = spark.createDataFrame([(1, 1, "EN|fr"), (2, 1, "EN")], "campaign_id long, ord int, lang_key string")
    findings = spark.createDataFrame(
        [("r1", "liens", None), ("r3", "liens", None), ("r3", "liens", "accepte"), ("no report of e", "liens", None)], "report_id string, category string, review string")
    versions = versions.union(spark.createDataFrame([("e", 2, "E", "it", None)], VERSIONS))
    got = {(r["campaign_id"], r["lang"]): (r["label"], r["verdict"], r["critiques"], r["majeurs"], r["total"], r["report_id"])
           for r in reports.language_report(expected, versions, found, findings).collect()}
    assert got == {(1, "EN|fr"): ("English", "GO", 0, 1, 2, "r3"), (2, "EN"): ("English", "NO_GO", 2, 0, 0, "r5"), (2, "IT"): ("Italiano", "—", 0, 0, 0, None)}
