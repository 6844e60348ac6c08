"""Queries against their SQL on the smallest data set; tools/check.py does the same for all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

SF = "/root/testdata/sf0.001"
NAMES = ["agg01_finding_dedup", "agg06_kpis", "grid10_activated_languages", "res02_validate_overrides",
         "join10_match_by_tokens", "win04_version_numbering", "rul11_malformed_url", "grid12_applied_plans",
         "res01_typed_settings", "scl23_revision_changes", "ord01_label_order", "src05_cells_scan",
         "snk01_compacted_documents", "rul47_no_cta"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import __spark_entry__ as entry
    from check import compare, duck

    problem, n = compare(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and n > 0


def test_every_query_is_listed():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_finding_texts_are_joined_once(spark):
    """SNK-3 and SNK-4: reports are described before findings, whose texts are then shuffled once."""
    from sparkproof.operators import reports as ops

    campaigns = spark.createDataFrame([(1, "C")], "campaign_id long, name string")
    versions = spark.createDataFrame(
        [("1-v1", 1, 1, None, "[1294653 - Camp - MX - F] x")], "version_id string, campaign_id long, version_no int, pinned_report_id string, name string")
    reports = spark.createDataFrame(
        [("r1", 1, "1-v1", 1, "GO", 5)], "report_id string, campaign_id long, version_id string, version_no int, verdict string, created_at int")
    findings = spark.createDataFrame(
        [("r1", 1, "1-v1", 1, "liens", "MINEUR", "regle", "rules", "the message", None, None, None, "x")],
        "report_id string, campaign_id long, version_id string, seq int, category string, severity string, source string, agent string, message string, "
        "review string, title string, expected string, received string")
    for out in (ops.findings_sheet(versions, reports, findings), ops.portfolio_findings(campaigns, versions, reports, findings)):
        assert [r["finding"] for r in out.collect()] == ["Problem in a link\nthe message"]
        plan = out._jdf.queryExecution().optimizedPlan()
        while plan.children().size() == 1:
            plan = plan.children().apply(0)
        sides = [plan.children().apply(i).toString() for i in range(2)]
        assert ["Join" in s for s in sides if "message" in s] == [False]


def test_findings_of_two_versions_meet_in_one_aggregate(spark):
    """AGG-20: findings aren't joined with themselves; null keys are like no other; numbers may have gaps."""
    from sparkproof.operators import reports as ops

    versions = spark.createDataFrame([("a", 1, 1), ("b", 1, 4), ("c", 1, 9)], "version_id string, campaign_id long, version_no int")
    findings = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("b", "y"), ("b", "z"), ("b", None)], "version_id string, dedup_key string")
    out = ops.version_changes(findings, versions)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3, 3, 0, 0), (1, 4, 3, 2, 2, 1), (1, 9, 0, 0, 3, 0)]
    # One join gives findings their rank, one gives versions their place, one the counts to all versions.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3


def test_qa_sheet_joins_texts_last(spark):
    """SNK-3: a version gets its report before the texts, which are shuffled once; versions without one stay."""
    from sparkproof.operators import reports as ops

    versions = spark.createDataFrame(
        [("a", 1, None, "A"), ("b", 1, None, "B"), ("c", 1, None, "C")], "version_id string, campaign_id long, pinned_report_id string, name string")
    reports = spark.createDataFrame(
        [("r1", 1, "a", 1, "GO", 5), ("r2", 1, "b", 2, "NO_GO", 5)],
        "report_id string, campaign_id long, version_id string, version_no int, verdict string, created_at int")
    findings = spark.createDataFrame(
        [("r1", i, "liens", None, f"message {i}", None) for i in range(6)] + [("no report of c", 1, "liens", None, "message", None)],
        "report_id string, seq int, category string, title string, message string, review string")
    out = ops.qa_sheet(versions, reports, findings)
    told = "\n".join(f"• Problem in a link: message {i}" for i in range(4)) + "\n(+2 more in the Findings tab)"
    assert sorted((r.version_id, r.ok_ko, r.feedback) for r in out.collect()) == [("a", "OK", told), ("b", "KO", ""), ("c", "", "Not analyzed yet")]
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    sides = [plan.children().apply(i).toString() for i in range(2)]
    assert ["pinned_report_id" in s for s in sides if "message" in s] == [False]
