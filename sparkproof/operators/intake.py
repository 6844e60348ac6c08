"""Findings and verdicts that models produced, taken in as tables and checked against the mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.names import TITLES, title_fits, title_for_finding
from sparkproof.functions.languages import canon_lang
from sparkproof.functions.text import evidence_found, quote_found
from sparkproof.operators.findings import REVIEW, nonempty, text
from sparkproof.operators.skew import skew_join

# The fields of a brief and those a grid replaces.
BRIEF_FIELDS = ["campaign_name", "market", "email_type", "target_audience", "send_datetime",
                "subject_line", "preheader", "key_message", "offer", "promo_code", "cta_label",
                "landing_urls", "utm_campaign", "legal_mentions"]
GRID_COVERED = ["subject_line", "preheader", "key_message", "offer", "cta_label", "landing_urls"]
AGENT_TITLES = [t for t in TITLES if "authentication" not in t]


def verify_quotes(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG-24 / JOIN-15: fields (brief_id, field, value, quote, confidence) against (brief_id, source)."""
    rows = skew_join(fields, sources, ["brief_id"], "left")
    has = F.col("value").isNotNull()
    lost = has & nonempty(F.col("quote")) & ~quote_found(F.col("quote"), F.col("source"))
    quote = F.when(~lost, F.col("quote"))
    confidence = F.when(lost, "low").when(
        has & ~nonempty(F.col("quote")) & (F.col("confidence") == "high"), "medium"
    ).otherwise(F.col("confidence"))
    return rows.select("brief_id", "field", "value", quote.alias("quote"), confidence.alias("confidence"))


def missing_fields(fields: DataFrame) -> DataFrame:
    """AGG-24: fields without a value per brief, in their fixed order (at most fourteen)."""
    order = F.array(*[F.lit(f) for f in BRIEF_FIELDS])
    there = fields.groupBy("brief_id").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("field"))).alias("have"))
    return there.select("brief_id", F.array_join(F.array_except(order, "have"), ",").alias("missing"))


def take_in(findings: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """JOIN-17: findings (finding_id, version_id, category, severity, title, evidence, rule_id, expected,
    received) checked against (version_id, source); resolved (rule_id, enabled, severity_override).

    `in_schema` says whether a finding keeps the schema's limits of length and titles; the row stays
    either way, and an unknown title is replaced. Unknown rule ids are cleared and the finding kept."""
    limits = {"evidence": 300, "rule_id": 60, "expected": 500, "received": 500}
    in_schema = F.col("title").isNull() | F.col("title").isin(*AGENT_TITLES)
    for name, most in limits.items():
        in_schema = in_schema & (F.coalesce(F.length(name), F.lit(0)) <= most)
    told = findings.where(F.col("severity") != "OK").withColumn("in_schema", in_schema)
    rows = skew_join(told, sources, ["version_id"], "left")
    verified = evidence_found(F.col("evidence"), F.col("source"))
    pair = F.coalesce((F.col("received") == "") | quote_found(F.col("received"), F.col("source")), F.lit(False))
    rows = rows.withColumn("verified", verified).withColumn("pair", pair).drop("source")
    rows = skew_join(rows, resolved, ["rule_id"], "left")
    known = F.col("enabled").isNotNull()
    severity = F.when(~F.col("verified"), "MINEUR").otherwise(F.coalesce("severity_override", "severity"))
    fits = F.col("title").isin(*AGENT_TITLES) & title_fits(F.col("title"), F.col("category"))
    title = F.when(~F.col("verified"), REVIEW).when(fits, F.col("title")).otherwise(
        title_for_finding(F.lit(None).cast("string"), F.col("category"))
    )
    return rows.where(F.coalesce("enabled", F.lit(True))).select(
        "finding_id", "version_id", "category", severity.alias("severity"), title.alias("title"),
        "evidence", F.when(known, F.col("rule_id")).alias("rule_id"), "verified",
        F.when(F.col("pair"), F.col("expected")).alias("expected"),
        F.when(F.col("pair"), F.col("received")).alias("received"), "in_schema",
    )


def arbitrate(findings: DataFrame, verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """JOIN-16: findings (finding_id, version_id, block, suggestion) after verdicts (finding_id, seq,
    verdict, evidence, note). A faithful verdict clears a finding only when its evidence is in the mail; the
    cleared ones come back as `passed` rows. The deviation note of the highest seq is put before
    the suggestion."""
    v = verdicts.join(findings.select("finding_id", "version_id"), "finding_id")
    checked = skew_join(v, sources, ["version_id"], "left").withColumn(
        "clears", (F.col("verdict") != "deviation") & evidence_found(F.col("evidence"), F.col("source"))
    )
    per = checked.groupBy("finding_id").agg(
        F.max("clears").alias("cleared"),
        F.max_by(F.trim("note"), F.when((F.col("verdict") == "deviation") & nonempty(F.trim("note")), F.col("seq"))).alias("note"),
    )
    rows = findings.join(per, "finding_id", "left")
    cleared = F.coalesce("cleared", F.lit(False))
    suggestion = F.when(
        ~cleared & F.col("note").isNotNull(),
        text("Translation review: ", F.col("note"), F.when(nonempty(F.col("suggestion")), F.concat(F.lit(" — "), "suggestion")).otherwise("")),
    ).otherwise(F.col("suggestion"))
    return rows.select(
        "finding_id", "version_id", F.when(cleared, "passed").otherwise("kept").alias("state"), suggestion.alias("suggestion")
    )


def unverified_rules(active: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG-17: active rules (report_id, agent, rule_id) whose agent has no finished run."""
    done = runs.where("status = 'done'").select("report_id", "agent").distinct()
    open_ = active.join(done, ["report_id", "agent"], "left_anti")
    return open_.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("unverified"))


def agent_cost(runs: DataFrame) -> DataFrame:
    """AGG-18."""
    return runs.groupBy("report_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("duration_ms").alias("duration_ms"), F.sum("n_findings").alias("n_findings"),
    )


def chosen_extraction(mails: DataFrame, extractions: DataFrame, grids: DataFrame) -> DataFrame:
    """JOIN-13: the extraction of the mail's language, else the campaign-wide one (lang_key NULL); fields
    that the grid covers are blanked when it has the language.

    extractions (campaign_id, ord, lang_key, fields map), grids (campaign_id, keys array)."""
    per_lang = extractions.where("lang_key IS NOT NULL").select(
        "campaign_id", "ord", "fields", F.explode(F.transform(F.split("lang_key", r"\|"), canon_lang)).alias("lang")
    ).groupBy("campaign_id", "lang").agg(F.min_by("fields", "ord").alias("own"))
    wide = extractions.where("lang_key IS NULL").groupBy("campaign_id").agg(F.min_by("fields", "ord").alias("wide"))
    covered = grids.select(
        "campaign_id", F.explode(F.flatten(F.transform("keys", lambda k: F.transform(F.split(k, r"\|"), canon_lang)))).alias("lang")
    ).distinct().withColumn("covered", F.lit(True))
    rows = skew_join(mails, per_lang, ["campaign_id", "lang"], "left")
    rows = skew_join(rows, wide, ["campaign_id"], "left")
    rows = skew_join(rows, covered, ["campaign_id", "lang"], "left")
    fields = F.coalesce("own", "wide")
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*GRID_COVERED))
    return rows.select(
        *mails.columns, F.when(F.coalesce("covered", F.lit(False)), kept).otherwise(fields).alias("fields")
    )
