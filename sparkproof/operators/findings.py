"""Finding and passed-check rows, shared by all rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.names import TITLE_BY_CATEGORY

FINDING = (
    "struct<rule_id:string,category:string,severity:string,title:string,message:string,"
    "evidence:string,locator:string,expected:string,received:string>"
)
PASSED = "struct<rule_id:string,category:string,label:string>"
NO_FINDINGS = f"array<{FINDING}>"
NO_PASSED = f"array<{PASSED}>"
REVIEW = "Possible issue to review"
SEVERITIES = ["OK", "MINEUR", "MAJEUR", "CRITIQUE"]


def _str(x) -> Column:
    if x is None:
        return F.lit(None).cast("string")
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def text(*parts) -> Column:
    """Concatenation in which a missing part reads as empty."""
    return F.concat(*[F.coalesce(_str(p), F.lit("")) for p in parts])


def finding(
    rule_id, category, severity, message, evidence, locator, title=None, expected=None, received=None
) -> Column:
    if title is None:
        title = TITLE_BY_CATEGORY[category]
    return F.struct(
        _str(rule_id).alias("rule_id"),
        _str(category).alias("category"),
        _str(severity).alias("severity"),
        _str(title).alias("title"),
        _str(message).alias("message"),
        _str(evidence).alias("evidence"),
        _str(locator).alias("locator"),
        _str(expected).alias("expected"),
        _str(received).alias("received"),
    )


def passed(rule_id, category, label) -> Column:
    return F.struct(
        _str(rule_id).alias("rule_id"), _str(category).alias("category"), _str(label).alias("label")
    )


def only_if(condition: Column, item: Column, empty: str = NO_FINDINGS) -> Column:
    return F.when(condition, F.array(item)).otherwise(F.array().cast(empty))


def each(items: Column, condition, item) -> Column:
    """One finding for every array element that meets the condition."""
    return F.transform(F.filter(items, condition), item)


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c).cast("int") - 1




def nonempty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def array_rows(df: DataFrame, column: str, key: str, *keep: str) -> DataFrame:
    """Array of structs to rows.

    The outer form with a filter behind it: for the plain form the optimiser infers a filter on the
    array, pushes it below and so evaluates the whole array expression once more."""
    return df.select(*keep, F.inline_outer(column)).where(F.col(key).isNotNull())
