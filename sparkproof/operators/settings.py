"""Typed parameters of rules: what kind each is, what a configuration sets, and what rules read.

A configuration gives values as VARIANT, since a stored one may hold anything. A value of the wrong type
never reaches a rule: it falls back as its kind says. Constraints are rows of one table, so a new
parameter needs a row and no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkproof.operators.skew import skew_join

# Rule, key, kind, least and greatest number, most entries, default as JSON.
SPECS = [
    ("brief-block-content", "similarityPercent", "int", 30, 90, None, "55"),
    ("placeholders", "extraTerms", "terms", None, None, 30, "[]"),
    ("personalization-tokens", "extraKnownTokens", "terms", None, None, 40, "[]"),
    ("staging-links", "extraTerms", "terms", None, None, 30, "[]"),
    ("brand-allowed-domains", "socialExemptions", "terms", None, None, 40,
     '["facebook", "instagram", "linkedin", "twitter", "x.com", "youtube", "tiktok"]'),
    ("html-size", "clipKb", "int", 50, 200, None, "102"),
    ("html-size", "warnKb", "int", 30, 200, None, "90"),
    ("links-http-verification", "timeoutSec", "int", 5, 60, None, "15"),
    ("links-http-verification", "concurrency", "int", 1, 12, None, "6"),
    ("links-http-verification", "maxRedirects", "int", 1, 15, None, "5"),
    ("links-status-classification", "blockedStatuses", "int-list", 100, 599, 12, "[400, 403, 405, 429]"),
    ("links-status-classification", "brokenStatuses", "int-list", 100, 599, 12, "[404, 410]"),
    ("matching-auto-threshold", "autoThresholdPercent", "int", 30, 95, None, "60"),
    ("agent-output-limits", "maxFindings", "int", 3, 12, None, "5"),
]
SPEC_DDL = "rule_id string, key string, kind string, least int, most int, max_items int, default_json string"
# Fixed value: a word of a list; no control characters or angle brackets, at most 80 characters.
TERM = r"^[^\x00-\x1f<>]{1,80}$"


def specs(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(SPECS if rows is None else rows, SPEC_DDL).withColumn("default", F.parse_json("default_json"))


def type_of(v: Column) -> Column:
    """number, string, boolean, list, null or other."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null").when(t.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(F.startswith(t, F.lit("ARRAY")), "list").otherwise("other")
    )


def items(v: Column) -> Column:
    """Entries of a list; empty for anything else."""
    none = F.array().cast("array<variant>")
    return F.when(type_of(v) == "list", F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).otherwise(none)


def number(v: Column) -> Column:
    """A finite number; null for anything else, also for text that looks like one."""
    d = F.when(type_of(v) == "number", F.try_variant_get(v, "$", "double"))
    return F.when(F.abs(d) < float("inf"), d)


def whole(v: Column) -> Column:
    """A whole number within the range of a long."""
    return let_number(v, lambda d: F.when((d == F.floor(d)) & (F.abs(d) < 2.0**63), d.cast("long")))


def let_number(v: Column, body) -> Column:
    return F.get(F.transform(F.array(number(v)), body), 0)


def words(v: Column) -> Column:
    texts = F.transform(F.filter(items(v), lambda x: type_of(x) == "string"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.filter(texts, lambda t: F.trim(t) != "")


def wholes(v: Column) -> Column:
    return F.array_compact(F.transform(items(v), whole))


def resolve_settings(configs: DataFrame, given: DataFrame, known: DataFrame) -> DataFrame:
    """RES-1: every parameter of every configuration (config_id), as the rules read it.

    given (config_id, rule_id, key, value variant), each key once. A value that isn't there or is null is
    the default. A number must be a number, else the default counts; a list of words keeps its words that
    aren't blank; a list of numbers keeps its whole numbers, and is the default if none is left; a switch
    must be on or off. Output: config_id, rule_id, key, number, words, numbers, switch, of which that of
    the parameter's kind is set."""
    rows = configs.select("config_id").distinct().join(F.broadcast(known)).join(given, ["config_id", "rule_id", "key"], "left")
    v, d, kind = F.when(type_of(F.col("value")) != "null", F.col("value")), F.col("default"), F.col("kind")
    v = F.coalesce(v, d)
    ints = F.when(F.size(wholes(v)) > 0, wholes(v)).otherwise(wholes(d))
    on = lambda x: F.when(type_of(x) == "boolean", F.try_variant_get(x, "$", "boolean"))
    return rows.select(
        "config_id", "rule_id", "key",
        F.when(kind == "int", F.coalesce(number(v), number(d))).alias("number"), F.when(kind == "terms", words(v)).alias("words"),
        F.when(kind == "int-list", ints).alias("numbers"), F.when(kind == "boolean", F.coalesce(on(v), on(d))).alias("switch"),
    )


def attach_settings(mails: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mails with `settings`, a map from rule.key to (number, words, numbers, switch) of their configuration
    (config_id). A configuration is a few dozen rows. Mails of an unknown one have null."""
    entry = F.struct(
        F.concat_ws(".", "rule_id", "key").alias("k"), F.struct("number", "words", "numbers", "switch").alias("v")
    )
    folded = resolved.groupBy("config_id").agg(F.map_from_entries(F.collect_list(entry)).alias("settings"))
    return skew_join(mails, folded, ["config_id"], "left")


def setting(name: str, field: str, default) -> Column:
    """A value of the row's `settings`, or the default where the row has no configuration."""
    fallback = F.array(*[F.lit(x) for x in default]) if isinstance(default, list) else F.lit(default)
    if field == "words":
        fallback = fallback.cast("array<string>")
    return F.coalesce(F.try_element_at("settings", F.lit(name))[field], fallback)


def validate_settings(given: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """RES-2: error rows (config_id, rule_id, key, error) of given parameters.

    `rules` (rule_id) are those that exist: settings of others are left over and pass. All constraints
    come from the parameter's row: its kind, its range, its number of entries, and what a word may hold."""
    rows = given.join(F.broadcast(rules.select("rule_id").distinct()), "rule_id").join(F.broadcast(known), ["rule_id", "key"], "left")
    v, kind = F.col("value"), F.col("kind")
    inside = lambda x: x.between(F.col("least"), F.col("most"))
    n_items = F.size(items(v))
    of_type = lambda t: (type_of(v) == "list") & F.forall(items(v), lambda x: type_of(x) == t)
    kinds = {
        "int": F.when(whole(v).isNull(), "not a whole number").when(~inside(whole(v)), "out of range"),
        "boolean": F.when(type_of(v) != "boolean", "not on or off"),
        "int-list": F.when(~of_type("number"), "not a list of numbers").when(n_items > F.col("max_items"), "too many entries")
        .when(F.exists(items(v), lambda x: whole(x).isNull() | ~inside(whole(x))), "entry out of range"),
        "terms": F.when(~of_type("string"), "not a list of words").when(n_items > F.col("max_items"), "too many entries")
        .when(F.exists(items(v), lambda x: ~F.rlike(F.try_variant_get(x, "$", "string"), F.lit(TERM))), "word not allowed"),
    }
    found = F.when(kind.isNull(), "unknown setting")
    for name, problem in kinds.items():
        found = found.when(kind == name, problem)
    return rows.select("config_id", "rule_id", "key", found.alias("error")).where("error IS NOT NULL")
