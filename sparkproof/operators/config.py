"""Rule configuration as tables: catalogue, overrides, resolution, validation, change summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkproof.functions.text import find_pii

# Id, default severity ('auto' = decided by the rule), adjustable, protected, extended.
CATALOG = [
    ("brief-block-content", "auto", False, False, False),
    ("brief-promo-code", "CRITIQUE", True, False, False),
    ("brief-utm-campaign", "MAJEUR", True, False, False),
    ("expected-links-market", "MAJEUR", True, False, False),
    ("template-structure", "MAJEUR", True, False, False),
    ("template-language-coverage", "MAJEUR", True, False, False),
    ("template-language-ambiguous", "MINEUR", False, False, False),
    ("template-language-unsupported", "MINEUR", False, False, False),
    ("template-field-shared-cell", "MINEUR", False, False, False),
    ("placeholders", "CRITIQUE", False, True, False),
    ("personalization-tokens", "MAJEUR", False, True, False),
    ("test-name-nomenclature", "MINEUR", True, False, False),
    ("copyright-year", "MAJEUR", True, False, True),
    ("broken-links", "CRITIQUE", False, True, False),
    ("suspicious-links", "MAJEUR", True, False, False),
    ("staging-links", "CRITIQUE", False, True, False),
    ("empty-anchor-cta", "MAJEUR", True, False, False),
    ("ampscript-redirect", "CRITIQUE", False, True, False),
    ("cn-domain-mix", "auto", False, False, False),
    ("brand-allowed-domains", "MAJEUR", True, False, False),
    ("malformed-url", "MINEUR", True, False, True),
    ("utm-campaign-consistency", "MAJEUR", True, False, False),
    ("utm-missing", "MAJEUR", True, False, False),
    ("utm-source-salesforce", "MAJEUR", True, False, False),
    ("utm-campaign-market", "auto", False, False, False),
    ("auth-dmarc", "auto", False, True, False),
    ("auth-dkim", "auto", False, True, False),
    ("auth-spf", "auto", False, True, False),
    ("auth-missing", "MINEUR", True, False, False),
    ("unsubscribe-link", "CRITIQUE", True, False, True),
    ("one-click-unsubscribe", "MAJEUR", True, False, True),
    ("html-size", "auto", False, False, False),
    ("image-alt", "MAJEUR", True, False, True),
    ("image-dimensions", "MINEUR", True, False, True),
    ("brand-editorial-rules", "auto", False, False, False),
]
CATALOG_DDL = "rule_id string, default_severity string, adjustable boolean, protected boolean, extended boolean"
# Whole-number parameters with their range and default.
INT_PARAMS = [
    ("html-size", "clipKb", 50, 200, 102), ("html-size", "warnKb", 30, 200, 90),
    ("brief-block-content", "similarityPercent", 30, 90, 55),
]
PARAM_DDL = "rule_id string, key string, min int, max int, default int"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_DDL)


def int_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INT_PARAMS, PARAM_DDL)


def resolve(rules: DataFrame, overrides: DataFrame, extended: bool = False) -> DataFrame:
    """RES-1 / JOIN-14: switch and severity of every (config_id, rule).

    overrides (config_id, rule_id, enabled, severity, removed). The catalogue has some forty rows."""
    configs = overrides.select("config_id").distinct()
    rows = configs.join(rules).join(overrides, ["config_id", "rule_id"], "left")
    on = (
        F.when(F.col("protected"), True).when(F.coalesce("removed", F.lit(False)), False)
        .otherwise(F.coalesce("enabled", ~F.col("extended") | F.lit(extended)))
    )
    severity = F.when(F.col("adjustable") & ~F.col("protected"), F.col("severity"))
    return rows.select(
        "config_id", "rule_id", on.alias("enabled"), severity.alias("severity_override"), "default_severity"
    )


def apply_config(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """RUL-40: findings of disabled rules go, overrides re-grade; unknown rules stay.

    `findings` and `resolved` share config_id; one configuration is a few dozen rows."""
    joined = findings.join(resolved, ["config_id", "rule_id"], "left")
    return joined.where(F.coalesce("enabled", F.lit(True))).withColumn(
        "severity", F.coalesce("severity_override", "severity")
    ).drop("enabled", "severity_override", "default_severity")


def validate(rules: DataFrame, overrides: DataFrame, params: DataFrame, given: DataFrame) -> DataFrame:
    """RES-2: error rows (config_id, rule_id, error). given (config_id, rule_id, key, value double)."""
    o = overrides.join(rules, "rule_id")
    errors = F.array_compact(
        F.array(
            F.when(F.col("protected") & (F.col("enabled") == F.lit(False)), "cannot be disabled"),
            F.when(F.col("protected") & F.coalesce("removed", F.lit(False)), "cannot be deleted"),
            F.when(F.col("protected") & F.col("severity").isNotNull(), "severity is fixed"),
            F.when(F.col("severity").isNotNull() & ~F.col("adjustable"), "chooses its own severity"),
        )
    )
    switches = o.select("config_id", "rule_id", F.explode(errors).alias("error"))
    p = given.join(rules.select("rule_id"), "rule_id").join(params, ["rule_id", "key"], "left")
    whole = F.col("value") == F.floor("value")
    problem = (
        F.when(F.col("default").isNull(), "unknown setting").when(~whole, "not a whole number")
        .when(~F.col("value").between(F.col("min"), F.col("max")), "out of range")
    )
    settings = p.select("config_id", "rule_id", problem.alias("error")).where("error IS NOT NULL")
    return switches.unionByName(settings)


def validate_custom(custom: DataFrame, own_categories: DataFrame, families: list[str], agents: list[str]) -> DataFrame:
    """RES-2: error rows (config_id, rule_id, error) of rules and categories that a configuration adds.

    custom (config_id, rule_id, category, agent), own_categories (config_id, category). An id counts once;
    a category is a family or one of the configuration's own; an agent is one that exists, or none."""
    family = F.col("category").isin(*families)
    twice = custom.groupBy("config_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    double = own_categories.groupBy("config_id", "category").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | family)
    unknown = custom.where(~family).join(own_categories.select("config_id", "category").distinct(), ["config_id", "category"], "left_anti")
    return (
        twice.select("config_id", "rule_id", F.lit("duplicate rule id").alias("error"))
        .unionByName(double.select("config_id", F.col("category").alias("rule_id"), F.lit("duplicate category id").alias("error")))
        .unionByName(unknown.select("config_id", "rule_id", F.lit("unknown category").alias("error")))
        .unionByName(custom.where(~F.col("agent").isin(*agents)).select("config_id", "rule_id", F.lit("unknown agent").alias("error")))
    )


def config_hash(overrides: DataFrame, length: int = 12) -> DataFrame:
    """SCL-23: hash of each configuration's overrides, whatever the order of its rows.

    A line for each rule, in order of rule ids: id, switch, severity, removed; `-` where not set."""
    told = F.concat_ws(
        " ", "rule_id", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("enabled", "severity", "removed")]
    )
    lines = F.array_join(F.array_sort(F.collect_list(told)), "\n")
    return overrides.groupBy("config_id").agg(F.left(F.sha2(lines, 256), F.lit(length)).alias("config_hash"))


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """RES-4: number of changed rules per configuration between two override tables."""
    cols = [c for c in before.columns if c not in ("config_id", "rule_id")]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("config_id", "rule_id", F.to_json(F.struct(*cols)).alias(name))

    both = packed(before, "a").join(packed(after, "b"), ["config_id", "rule_id"], "full")
    changed = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    out = both.groupBy("config_id").agg(changed.alias("n_changed"))
    plural = F.when(F.col("n_changed") > 1, "s").otherwise("")
    return out.withColumn(
        "summary",
        F.when(F.col("n_changed") == 0, "no change").otherwise(
            F.concat("n_changed", F.lit(" built-in rule"), plural, F.lit(" changed"))
        ),
    )


def effective_rules(campaign_rules: DataFrame, brand_rules: DataFrame, extra: DataFrame) -> DataFrame:
    """RES-6: a campaign's own rules replace its brand's; extra rules are always added.

    campaign_rules (campaign_id, rule_id), brand_rules (campaign_id, rule_id), extra (campaign_id, rule_id)."""
    own = campaign_rules.select("campaign_id").distinct()
    fallback = brand_rules.join(own, "campaign_id", "left_anti")
    return (
        campaign_rules.withColumn("origin", F.lit("campaign"))
        .unionByName(fallback.withColumn("origin", F.lit("brand")))
        .unionByName(extra.withColumn("origin", F.lit("extra")))
    )


def pii_in_rules(rules: DataFrame) -> DataFrame:
    """SCL-24 over rule texts (rule_id, text)."""
    return rules.withColumn("what", find_pii(F.col("text"))).where("what IS NOT NULL")
