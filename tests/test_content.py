"""Copy and planned links against the brief: results at odd titles, and plans that don't grow with the square."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))


def test_planned_links_have_a_key(spark):
    """RUL-32: labels of different constant languages were compared row by row, each with every other."""
    from sparkproof.plans import load_all

    out = load_all().QUERIES["rul32_expected_links_market"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("whole", [True, False])
def test_similar_texts_carry_no_pairs(spark, whole):
    """JOIN-6: the best text of a block, without arrays of character pairs in the rows."""
    from sparkproof.operators import content

    groups = spark.createDataFrame([(1, "B", [(0, "B", "Raw", "buy two shirts")])], "version_id long, base string, expected array<struct<block_ord:int,name:string,raw:string,norm:string>>")
    texts = ["Other words", "Buy two  skirts", "Buy two shirts" if whole else "buy"]
    mails = spark.createDataFrame([(1, 0.55, texts)], "version_id long, minimum double, originals array<string>")
    best = content.best_similar(groups, mails)
    got = best.first()["best"]
    assert (got["received"], round(got["sim"], 6)) == (("Buy two shirts", 1.0) if whole else ("Buy two  skirts", 0.846154))
    assert "regexp_extract_all" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_language_keys_are_read_once(spark):
    """AGG-4: expected keys and versions meet in one join, also for languages that no key names."""
    from sparkproof.operators import reports

    expected = spark.createDataFrame([(1, 1, "EN|fr"), (1, 2, "French|English"), (2, 1, "ES")], "campaign_id long, ord int, lang_key string")
    versions = spark.createDataFrame(
        [("a", 1, "en", None), ("b", 1, "de", None), ("c", 1, None, None), ("d", 3, "it", None)], "version_id string, campaign_id long, language string, pinned_report_id string")
    rows = [("r1", 1, "a", 1, "GO", 0, 1, 2, 5), ("r2", 1, "b", 2, "NO_GO", 3, 0, 0, 6)]
    found = spark.createDataFrame(rows, "report_id string, campaign_id long, version_id string, version_no int, verdict string, critiques int, majeurs int, mineurs int, created_at int")
    findings = spark.createDataFrame([("r2", "liens", None)], "report_id string, category string, review string")
    out = reports.language_report(expected, versions, found, findings)
    got = {(r["campaign_id"], r["lang"]): (r["verdict"], r["critiques"], r["mineurs"], r["total"], r["report_id"]) for r in out.collect()}
    assert got == {
        (1, "French|English"): ("GO", 0, 2, 0, "r1"), (1, "DE"): ("NO_GO", 3, 0, 1, "r2"),
        (2, "ES"): ("—", 0, 0, 0, None), (3, "IT"): ("—", 0, 0, 0, None),
    }
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_title_that_ends_inside_a_reference(spark, tmp_path):
    """RUL-31: the brief's block and the mail's subject hold the same cut reference (page 28)."""
    import duckdb
    from check import compare

    from sparkproof.plans import load_all

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id BETWEEN 24 AND 35")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    plans, name = load_all(), "rul31_severity_of_missing_blocks"
    problem, n = compare(spark, con, str(tmp_path), name, plans.QUERIES[name], plans.ORACLE[name])
    assert problem is None and n > 0


def test_short_blocks_and_other_languages(spark, tmp_path):
    """RUL-31: blocks of fewer than three characters, empty ones too, and mails in a language that no key names have a
    state in the SQL; they were left out."""
    import duckdb
    from check import compare

    from sparkproof.plans import load_all

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT page_id, url, replace(CASE WHEN page_id % 8 = 6 THEN replace(html, concat('lang="', l, '"'), 'lang="it"') WHEN page_id % 8 = 2 THEN replace(html, concat(' lang="', l, '"'), '')
        ELSE html END, concat('<title>', t, '</title>'), concat('<title>', CASE floor(page_id / 4) % 6 WHEN 0 THEN 'y' WHEN 1 THEN 'é.' WHEN 2 THEN '' WHEN 3 THEN '%%' WHEN 4 THEN ' ' ELSE t END, '</title>')) AS html
      FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, 'html lang="([a-z]+)"', 1) AS l FROM read_parquet('/root/testdata/sf0.1/pages.parquet') WHERE page_id < 72) p)
      TO '{tmp_path}/pages.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    plans = load_all()
    for name in ("rul31_severity_of_missing_blocks", "rul31_brief_block_content"):
        problem, n = compare(spark, con, str(tmp_path), name, plans.QUERIES[name], plans.ORACLE[name])
        assert problem is None and n > 0


def test_lengths_that_just_reach_the_threshold(spark):
    """JOIN-6: 55 pairs of 145 give 110 / 200, which is 0.55; as a product, 200 * 0.55 is above 110."""
    from pyspark.sql import functions as F

    from sparkproof.operators import content

    lengths = spark.createDataFrame([(56, 146), (56, 147), (1, 1)], "a int, b int")
    got = lengths.select(content.can_reach(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, True]
