"""Typed parameters: fallbacks of each kind, constraints, and a threshold that changes a rule's rows."""

from pyspark.sql import functions as F

from sparkproof.operators import content, settings

SPECS = [
    ("r", "n", "int", 30, 90, None, "55"), ("r", "w", "terms", None, None, 2, '["std"]'),
    ("r", "l", "int-list", 100, 599, 3, "[404]"), ("r", "b", "boolean", None, None, None, "true"),
]


def given(spark, rows):
    df = spark.createDataFrame([("c", "r", k, v) for k, v in rows], "config_id string, rule_id string, key string, json string")
    return df.select("config_id", "rule_id", "key", F.parse_json("json").alias("value"))


def resolved(spark, key, json):
    rows = given(spark, [(key, json)])
    out = settings.resolve_settings(rows, rows, settings.specs(spark, SPECS)).where(F.col("key") == key).first()
    return next((v for v in (out.number, out.words, out.numbers, out.switch) if v is not None), None)


def test_fallbacks(spark):
    assert resolved(spark, "n", "70") == 70 and resolved(spark, "n", "55.5") == 55.5 and resolved(spark, "n", "1e2") == 100
    assert resolved(spark, "n", '"70"') == 55 and resolved(spark, "n", "null") == 55 and resolved(spark, "n", "[70]") == 55
    assert resolved(spark, "w", '["a", " ", 5, "b c"]') == ["a", "b c"] and resolved(spark, "w", '"a"') == [] and resolved(spark, "w", "null") == ["std"]
    assert resolved(spark, "l", '[200, 404.5, "300", 999, null]') == [200, 999] and resolved(spark, "l", "[]") == [404] and resolved(spark, "l", "7") == [404]
    assert resolved(spark, "b", "false") is False and resolved(spark, "b", '"false"') is True and resolved(spark, "b", "0") is True


def test_constraints(spark):
    rules = spark.createDataFrame([("r",)], "rule_id string")

    def problem(key, json):
        found = settings.validate_settings(given(spark, [(key, json)]), settings.specs(spark, SPECS), rules).collect()
        return found[0].error if found else None

    cases = {
        ("n", "30"): None, ("n", "29"): "out of range", ("n", "31.5"): "not a whole number", ("n", '"40"'): "not a whole number",
        ("b", "true"): None, ("b", "1"): "not on or off", ("l", "[100, 599]"): None, ("l", "[99]"): "entry out of range",
        ("l", "[100.5]"): "entry out of range", ("l", '["a"]'): "not a list of numbers", ("l", "[200,200,200,200]"): "too many entries",
        ("w", '["a", "b"]'): None, ("w", '["a", "b", "c"]'): "too many entries", ("w", '["<b>"]'): "word not allowed",
        ("w", '[""]'): "word not allowed", ("w", f'["{"x" * 81}"]'): "word not allowed", ("w", f'["{"x" * 80}"]'): None, ("w", "[1]"): "not a list of words",
        ("other", "1"): "unknown setting",
    }
    assert {k: problem(*k) for k in cases} == cases
    gone = given(spark, [("n", "1")]).withColumn("rule_id", F.lit("gone"))
    assert settings.validate_settings(gone, settings.specs(spark, SPECS), rules).count() == 0


def test_similarity_moves_between_changed_and_missing(spark):
    blocks = spark.createDataFrame([(1, 1, "Body", "EN", "The quick brown fox jumps over the lazy dog")] * 2, "campaign_id long, block_ord int, block string, lang_key string, value string")
    languages = spark.createDataFrame([(1, 1, "EN")], "campaign_id long, ord int, lang_key string")
    mail = spark.sql("""SELECT 7L AS version_id, 1L AS campaign_id, 'EN' AS detected_lang, named_struct('market', 'WW', 'audience', 'ALL') AS test_name,
      named_struct('subject', 'hello', 'preheader', '', 'texts', array('The quick red fox jumps over that lazy dog')) AS facts""")

    def state(json):
        rows = spark.createDataFrame([("c",)], "config_id string")
        one = rows.select("config_id", F.lit("brief-block-content").alias("rule_id"), F.lit("similarityPercent").alias("key"), F.parse_json(F.lit(json)).alias("value"))
        mails = settings.attach_settings(mail.withColumn("config_id", F.lit("c")), settings.resolve_settings(rows, one, settings.specs(spark)))
        found = content.block_outcomes(content.mail_texts(mails, languages), content.block_table(blocks.distinct())).collect()
        return [r.state for r in found]

    assert (state("30"), state("90"), state('"30"')) == (["differs"], ["not_found"], ["differs"])
    # A brief that repeats its rows gives the same grid.
    grids = content.build_grids(blocks, languages).collect()
    assert len(grids) == 1 and grids[0].grid.blocks[0].vals == {"EN": "The quick brown fox jumps over the lazy dog"}
