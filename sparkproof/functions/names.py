"""Test names of the form [number - campaign - market - audience], and finding titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkproof.functions.text import let

AUDIENCE = "^(?iu)(ALL|F|M)$"
MARKET = "^[A-Z]{2,3}$"

# Titles a finding may carry, and the one each category falls back to.
TITLES = [
    "Problem in the translation",
    "Problem in the subject line",
    "Problem in a link",
    "Problem in the tracking",
    "Problem in the email authentication",
    "Email authentication could not be verified",
    "Problem in the unsubscribe setup",
    "Problem in an image",
    "Problem in the rendering",
    "Problem in the content",
    "Problem in the brand guidelines",
    "Technical problem",
    "Possible issue to review",
]
TITLE_BY_CATEGORY = {
    "assets": "Problem in an image",
    "liens": "Problem in a link",
    "tracking": "Problem in the tracking",
    "brief": "Problem in the translation",
    "guidelines": "Problem in the brand guidelines",
    "contenu": "Problem in the content",
    "rendu": "Problem in the rendering",
    "delivrabilite": "Problem in the email authentication",
    "technique": "Technical problem",
}
TITLE_CATEGORIES = {
    "Problem in the translation": ["brief", "contenu"],
    "Problem in the subject line": ["contenu", "guidelines", "brief"],
    "Problem in a link": ["liens"],
    "Problem in the tracking": ["tracking", "brief"],
    "Problem in the email authentication": ["delivrabilite"],
    "Email authentication could not be verified": ["delivrabilite"],
    "Problem in the unsubscribe setup": ["delivrabilite", "liens"],
    "Problem in an image": ["assets", "rendu"],
    "Problem in the rendering": ["rendu"],
    "Problem in the content": ["contenu", "brief"],
    "Problem in the brand guidelines": ["guidelines"],
    "Technical problem": ["technique"],
    "Possible issue to review": list(TITLE_BY_CATEGORY),
}
# Report criteria and the categories they gather.
CRITERIA = {
    "traductions": ["contenu", "brief", "guidelines"],
    "responsive": ["rendu", "assets"],
    "liens": ["liens"],
    "tracking": ["tracking"],
    "delivrabilite": ["delivrabilite", "technique"],
}


def parse_test_name(subject: Column) -> Column:
    """SCL-10: struct of the bracketed test name, NULL when the subject has none.

    Each step is bound once: unbound, the splitting of the name is repeated wherever a later step reads it."""
    inner = F.regexp_extract(subject, r"^\s*\[([^\]]+)\]", 1)
    parts = F.filter(
        F.transform(F.split(inner, r"\s*-\s*"), lambda p: F.trim(p)), lambda p: p != ""
    )

    def audience(x: Column) -> Column:
        return F.coalesce(x.rlike(AUDIENCE), F.lit(False))

    def market(x: Column) -> Column:
        return F.coalesce(x.rlike(MARKET) & (x != "ALL"), F.lit(False))

    def of_parts(ps: Column) -> Column:
        number = F.when(F.get(ps, 0).rlike(r"^\d{4,}$"), F.get(ps, 0))
        return F.when(F.size(ps) > 0, let(number, lambda num: of_number(ps, num)))

    def of_number(ps: Column, num: Column) -> Column:
        body = F.when(num.isNotNull(), F.slice(ps, 2, F.size(ps))).otherwise(ps)
        return let(body, lambda b: of_body(num, b))

    def of_body(num: Column, body: Column) -> Column:
        n = F.size(body)
        ends = F.struct(F.get(body, n - 1).alias("last"), F.get(body, n - 2).alias("before"))
        return let(ends, lambda e: let(kinds(e["last"], e["before"]), lambda k: named(num, body, e, k)))

    def kinds(last: Column, before: Column) -> Column:
        return F.struct(
            audience(last).alias("aud1"), market(last).alias("mkt1"),
            audience(before).alias("aud2"), market(before).alias("mkt2"),
        )

    def named(num: Column, body: Column, e: Column, k: Column) -> Column:
        aud1, mkt1 = k["aud1"], ~k["aud1"] & k["mkt1"]
        aud2, mkt2 = mkt1 & k["aud2"], aud1 & k["mkt2"]
        taken = (aud1 | mkt1).cast("int") + (aud2 | mkt2).cast("int")
        aud_v = F.when(aud1, F.upper(e["last"])).when(aud2, F.upper(e["before"]))
        mkt_v = F.when(mkt1, e["last"]).when(mkt2, e["before"])
        n = F.size(body)
        return F.struct(
            num.alias("test_number"),
            F.array_join(F.slice(body, F.lit(1), n - taken), " - ").alias("campaign_name"),
            mkt_v.alias("market"),
            aud_v.alias("audience"),
            (num.isNotNull() & mkt_v.isNotNull() & aud_v.isNotNull() & (n > taken)).alias("well_formed"),
        )

    return let(parts, of_parts)


def subject_market(subject: Column) -> Column:
    return parse_test_name(subject)["market"]


def subject_fallback(title: Column, name: Column) -> Column:
    """EXT-10: page title, else the version name without its bracketed prefix."""
    bare = F.trim(F.regexp_replace(name, r"^\[[^\]]*\]\s*", ""))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(bare, F.lit("")))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def title_for_finding(title: Column, category: Column) -> Column:
    """SCL-21: a known title, else the category's."""
    return F.when(title.isin(*TITLES), title).otherwise(
        F.coalesce(F.try_element_at(_map(TITLE_BY_CATEGORY), category), F.lit(TITLES[-1]))
    )


def title_fits(title: Column, category: Column) -> Column:
    """The title may be used for findings of this category."""
    allowed = [F.lit(x) for t in TITLE_CATEGORIES.items() for x in (t[0], "|".join(t[1]))]
    cats = F.try_element_at(F.create_map(*allowed), title)
    return F.coalesce(
        F.array_contains(F.split(cats, r"\|"), category), F.coalesce(title, F.lit("")) != ""
    )


def criterion(category: Column) -> Column:
    flat = {c: k for k, cats in CRITERIA.items() for c in cats}
    return F.try_element_at(_map(flat), category)


def content_hash(*parts: Column, length: int = 24) -> Column:
    """SCL-23: prefix of the SHA-256 of the parts, each behind its length, so that no two lists agree."""
    told = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.left(F.sha2(F.concat(*told), 256), F.lit(length))


def cell_ref(row: Column, col: Column) -> Column:
    """SCL-27: zero-based row and column to an A1 reference (up to three letters, the most a sheet has)."""

    def letter(place: int, first: int) -> Column:
        # `first` is the first column whose reference has a letter at this place.
        at = F.floor((col - first) / 26**place).cast("int") % 26
        return F.when(col >= first, F.char(at + 65)).otherwise(F.lit(""))

    return F.concat(letter(2, 26 + 26**2), letter(1, 26), letter(0, 0), (row + 1).cast("string"))


def column_index(letters: Column) -> Column:
    """SCL-27: column letters to a zero-based index."""
    return (
        F.aggregate(
            F.split(letters, ""), F.lit(0), lambda acc, ch: acc * 26 + (F.ascii(ch) - 64)
        )
        - 1
    )


def message_id_hex(decimal_id: Column) -> Column:
    """SCL-28."""
    return F.lower(F.conv(decimal_id, 10, 16))


def message_id_decimal(hex_id: Column) -> Column:
    return F.conv(hex_id, 16, 10)
