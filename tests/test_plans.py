"""Plans that must stay small, also where nothing may be broadcast."""

import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_template_rules_read_once(spark, no_broadcast, tmp_path):
    """Briefs, blocks, links, fields and codes are read once each, and the template meets no brief by a join."""
    from sparkproof.operators import template
    from sparkproof.plans import config_queries

    def stored(name, rows, ddl):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    fields = stored("fields", config_queries.FIELDS, "field_ord int, key string, label string, kind string, required boolean, translatable boolean, aliases array<string>")
    codes = stored("codes", [(c,) for c in config_queries.CODES], "code string")
    briefs = stored("briefs", [(1, "field_value", ["EN", "FR"]), (2, None, []), (3, "field_value", ["EN"])], "brief_id long, family string, langs array<string>")
    blocks = stored("blocks", [(1, 1, "SL", "EN", "hi"), (1, 1, "SL", "EN", "hi"), (1, 3, "Body", "FR", "x"), (1, 4, "More", "EN", "x")], "brief_id long, ord int, block string, lang string, value string")
    links = stored("links", [(1, 9, "CTA"), (1, 9, "body")], "brief_id long, ord int, block string")
    seen = template.seen_rows(blocks, links)
    for found in (template.conformance(briefs, seen, fields, codes), template.conformance_state(briefs, seen, fields, codes)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("parquet") <= 10 and plan.count("scalar-subquery") <= 5, plan
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {(r.brief_id, r.state) for r in found.collect()} == {(1, "deviation"), (2, "family_unknown"), (3, "no_field_matched")}
    assert {(r.rule_id, r.item, r.detail) for r in template.conformance(briefs, seen, fields, codes).collect()} == {
        ("template-structure", "More", "extra"), ("template-language-coverage", "Subject Line", "FR"), ("template-field-shared-cell", "Body", "body,body2"),
        ("template-language-ambiguous", "EN, US", None), ("template-language-unsupported", "XX", None),
    }


def plain_comments(text):
    out, depth = "", 0
    for ch in text:
        if ch == "(":
            depth += 1
        elif ch == ")" and depth:
            depth -= 1
        elif not depth:
            out += ch
    return out


def test_comments_that_nest(spark):
    from sparkproof.operators.auth import strip_comments

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ()") for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += ["", "(", ")", "((", "a(b(c)d)e", "a) (b", "(a))", "spf=pass (x (y) z) a=b", "(" * 500 + "x" + ")" * 500 + "y", "x" * 70_000 + "(c)"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_comments(F.col("t")).alias("o")).collect()
    assert all(r.o == plain_comments(r.t) for r in got)
