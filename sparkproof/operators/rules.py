"""Deterministic rules on one mail: `facts` and link results in, arrays of findings out.

Every rule is a column over the mail's row. `RULES[rule_id](mail)` gives `(findings, passed)`.
Input columns a mail may lack (brief, brand) are NULL and their rules stay silent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions import urls
from sparkproof.functions.languages import same_lang
from sparkproof.functions.names import parse_test_name
from sparkproof.functions.text import WS, let, norm_text
from sparkproof.operators.findings import (
    NO_FINDINGS, NO_PASSED, REVIEW, each, finding, nonempty, only_if, passed, text,
)
from sparkproof.operators.settings import setting
from sparkproof.operators.skew import skew_join

# Patterns whose hits decide results.
PLACEHOLDER = r"lorem ipsum|\bTBD\b|\bTODO\b|xxx+|placeholder|à compléter|a completer"
STAGING = r"staging\.|preprod\.|\.test\b|localhost|127\.0\.0\.1|dev\."
UNTRACKED_HREF = r"(?iu)unsub|preference|privacy|datenschutz|legal|mentions|view\.news\.|vawp|mirror"
UNTRACKED_TEXT = (
    r"(?iu)d[ée]sinscri|unsubscribe|mentions|voir en ligne|miroir|view (this )?(email|online)"
    r"|online version"
)
KNOWN_TOKENS = (
    r"(?iu)^%%(firstname|lastname|first_name|last_name|prenom|nom|email(addr)?|view_email_url"
    r"|profile_center_url|unsub|subscriberid|jobid|member_)"
)
MARKET_CODE = r"^[A-Z]{2,3}$"
LANG_LIKE = r"^[A-Za-z]{2,3}([-_ ]+[A-Za-z]{2,3})?$"
SOCIAL = ["facebook", "instagram", "linkedin", "twitter", "x.com", "youtube", "tiktok"]

RULES: dict[str, Callable[[Mail], tuple[Column, Column]]] = {}


def rule(rule_id: str):
    def register(fn):
        RULES[rule_id] = fn
        return fn

    return register




@dataclass
class Mail:
    """Columns of a prepared mail row and the parameters of the run.

    A parameter is one value for all mails, or a column: `of_settings` reads those of each mail's own
    configuration."""

    clip_kb: int | Column = 102
    warn_kb: int | Column = 90
    run_year: int = 2025
    extra_placeholders: list[str] | Column = field(default_factory=list)
    extra_staging: list[str] | Column = field(default_factory=list)
    extra_tokens: list[str] | Column = field(default_factory=list)
    social: list[str] | Column = field(default_factory=lambda: list(SOCIAL))

    @classmethod
    def of_settings(cls, run_year: int = 2025) -> Mail:
        """RES-1: parameters from the `settings` that `settings.attach_settings` gave each mail."""
        kb = lambda key, default: setting(f"html-size.{key}", "number", float(default)).cast("int")
        return cls(
            kb("clipKb", cls.clip_kb), kb("warnKb", cls.warn_kb), run_year, setting("placeholders.extraTerms", "words", []),
            setting("staging-links.extraTerms", "words", []), setting("personalization-tokens.extraKnownTokens", "words", []),
            setting("brand-allowed-domains.socialExemptions", "words", list(SOCIAL)),
        )

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


def escape_regex(term: str) -> str:
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in term)


# The word edge of the reference knows ASCII letters only; Java's \b does not.
WORD_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def with_terms(base: str, terms: list[str] | Column) -> Column:
    """Pattern of the base and of words that are met as they stand."""
    start = "(?iu)" + base.replace(r"\b", WORD_EDGE)
    if isinstance(terms, Column):
        plain = F.transform(terms, lambda t: F.regexp_replace(F.trim(t), r"([.*+?^${}()|\[\]\\])", r"\\$1"))
        return F.array_join(F.concat(F.array(F.lit(start)), F.filter(plain, lambda t: t != "")), "|")
    return F.lit("|".join([start, *(escape_regex(t.strip()) for t in terms if t.strip())]))


def bare_terms(terms: list[str] | Column, body) -> Column:
    """Trimmed lower-case terms that aren't empty, after `body` (a column function)."""
    given = terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    return F.filter(F.transform(given, lambda t: body(F.lower(F.trim(t)))), lambda t: t != "")


OPTIONAL = {
    "name": "string",
    "source": "string",
    "declared_market": "string",
    "detected_lang": "string",
    "brief_promo_code": "string",
    "brief_utm_campaign": "string",
    "salesforce_name": "string",
    "allowed_domains": "array<string>",
    "brand_rules": (
        "array<struct<rule_id:string,check:string,severity:string,title:string,"
        "tokens:array<string>,exact_text:string,max_length:int>>"
    ),
}
LINK_RESULT = (
    "struct<status:string,reason:string,http_status:int,final_url:string,"
    "final_utm:map<string,string>>"
)


def prepare(mails: DataFrame) -> DataFrame:
    """Columns that several rules read, each computed once per mail.

    Expects `facts` and, after JOIN-1, `link_results` aligned with `facts.links`."""
    out = mails
    for name, ddl in OPTIONAL.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(ddl))
    if "link_results" not in out.columns:
        out = out.withColumn(
            "link_results", F.array().cast(f"array<{LINK_RESULT}>")
        )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = out.withColumn(
        "links",
        F.transform(
            "facts.links",
            lambda x, i: let(
                F.get(F.col("link_results"), i),
                lambda r: F.struct(
                    x["pos"].alias("pos"),
                    x["href"].alias("href"),
                    x["text"].alias("text"),
                    x["kind"].alias("kind"),
                    x["host"].alias("host"),
                    x["utm"].alias("own_utm"),
                    # JOIN-2: the link's own tracking, else that of its final address.
                    F.when(F.size(x["utm"]) > 0, x["utm"])
                    .otherwise(F.coalesce(r["final_utm"], empty)).alias("utm"),
                    x["other"].alias("other"),
                    r["status"].alias("status"),
                    r["reason"].alias("reason"),
                    r["final_url"].alias("final_url"),
                ),
            ),
        ),
    )
    links = F.col("links")
    out = out.withColumn(
        "trackable", F.filter(links, lambda x: x["kind"].isin("statique", "tracked"))
    ).withColumn(
        "testable",
        F.filter(
            links,
            lambda x: x["kind"].isin("statique", "tracked") & ~x["text"].rlike(urls.UNSUB_SHORT),
        ),
    )
    out = out.withColumn(
        "utm_campaigns",
        F.array_distinct(
            F.filter(
                F.transform("trackable", lambda x: x["utm"]["utm_campaign"]), lambda v: nonempty(v)
            )
        ),
    ).withColumn(
        "all_text",
        F.array_join(
            F.filter(
                F.concat(F.array("facts.subject", "facts.preheader"), "facts.texts"), nonempty
            ),
            " | ",
        ),
    )
    test_name = parse_test_name(F.col("name"))
    out = out.withColumn("test_name", test_name).withColumn(
        "explicit_market",
        F.coalesce(
            F.nullif(F.upper(F.trim("declared_market")), F.lit("")), F.col("test_name.market")
        ),
    )
    cn_links = F.size(
        F.filter(
            "testable", lambda x: urls.is_cn_host(urls.host_of(F.coalesce(x["final_url"], x["href"])))
        )
    )
    # AGG-12: explicit market, else CN by language or by most links, else WW.
    return out.withColumn(
        "effective_market",
        F.coalesce(
            F.col("explicit_market"),
            F.when(
                (F.coalesce(F.col("detected_lang"), F.lit("")) == "ZH")
                | ((F.size("testable") > 0) & (cn_links > F.size("testable") / 2)),
                F.lit("CN"),
            ),
            F.lit("WW"),
        ),
    )


def link_name(x: Column) -> Column:
    return F.when(x["text"] != "", x["text"]).otherwise(x["href"])


def link_locator(x: Column) -> Column:
    return text("lien#", x["pos"])


def none_passed() -> Column:
    return F.array().cast(NO_PASSED)


@rule("html-size")
def html_size(m: Mail):
    size = F.col("facts.size_bytes")
    kb = F.round(size / 1024).cast("int")
    over = finding(
        "html-size", "technique", "CRITIQUE",
        text("HTML is ", kb, "KB, above the ", m.clip_kb, "KB at which Gmail clips a message"),
        text(kb, "KB"), "html",
    )
    near = finding(
        "html-size", "technique", "MINEUR",
        text("HTML is ", kb, "KB, close to the clipping limit of ", m.clip_kb, "KB"),
        text(kb, "KB"), "html", REVIEW,
    )
    found = (
        F.when(size > m.clip_kb * 1024, F.array(over))
        .when(size > m.warn_kb * 1024, F.array(near))
        .otherwise(F.array().cast(NO_FINDINGS))
    )
    ok = only_if(
        size <= m.warn_kb * 1024,
        passed("html-size", "technique", text("HTML weight is fine (", kb, "KB)")), NO_PASSED,
    )
    return found, ok


@rule("test-name-nomenclature")
def test_name(m: Mail):
    bracketed = F.coalesce(m.name.rlike(r"^\s*\["), F.lit(False))
    good = F.coalesce(F.col("test_name.well_formed"), F.lit(False))
    bad = finding(
        "test-name-nomenclature", "contenu", "MINEUR",
        "Test name does not follow [number - campaign - market - audience]",
        m.name, "subject", "Problem in the subject line",
    )
    label = text(
        "Test name is well formed (#", F.col("test_name.test_number"), ", ",
        F.col("test_name.campaign_name"), ", ", F.col("test_name.market"), ", ",
        F.col("test_name.audience"), ")",
    )
    return only_if(bracketed & ~good, bad), only_if(
        bracketed & good, passed("test-name-nomenclature", "contenu", label), NO_PASSED
    )


@rule("unsubscribe-link")
def unsubscribe_link(m: Mail):
    dead = F.get(
        F.filter(
            m.links, lambda x: (x["kind"] == "anchor") & x["text"].rlike(urls.UNSUB_SHORT)
        ), 0,
    )
    shown = F.when(dead["href"] == "", F.lit("#")).otherwise(dead["href"])
    exists = dead.isNotNull()
    bad = finding(
        "unsubscribe-link", "delivrabilite", "CRITIQUE",
        F.when(exists, text('Unsubscribe link leads nowhere ("', shown, '")')).otherwise(
            "No unsubscribe link found"
        ),
        F.when(exists, text('"', dead["text"], '" → href="', shown, '"')).otherwise(
            "no candidate link"
        ),
        F.when(exists, text("lien#", dead["pos"])).otherwise("footer"),
        "Problem in the unsubscribe setup",
    )
    ok = passed("unsubscribe-link", "delivrabilite", "Unsubscribe link present")
    has = F.col("facts.has_unsubscribe")
    return only_if(~has, bad), only_if(has, ok, NO_PASSED)


def _probe_locator(x: Column) -> Column:
    return text("lien:", x["href"])


@rule("broken-links")
def broken_links(m: Mail):
    bad = each(
        m.links, lambda x: x["status"] == "casse",
        lambda x: finding(
            "broken-links", "liens", "CRITIQUE", text('Broken link: "', link_name(x), '"'),
            text(x["href"], " → ", x["reason"]), _probe_locator(x),
        ),
    )

    def count(test) -> Column:
        return F.size(F.filter(m.links, test))

    n_ok = count(lambda x: x["status"] == "ok")
    n_nv = count(lambda x: x["status"] == "non_verifiable")
    n_dyn = count(lambda x: x["status"].isNotNull() & (x["kind"] == "ampscript"))
    lines = F.array(
        F.when(n_ok > 0, passed("broken-links", "liens", text(n_ok, " links respond"))),
        F.when(n_nv > 0, passed("broken-links", "liens", text(n_nv, " links not verifiable"))),
        F.when(n_dyn > 0, passed("broken-links", "liens", text(n_dyn, " dynamic links untested"))),
    )
    return bad, F.filter(lines, lambda p: p.isNotNull())


@rule("suspicious-links")
def suspicious_links(m: Mail):
    return each(
        m.links, lambda x: x["status"] == "suspect",
        lambda x: finding(
            "suspicious-links", "liens", "MAJEUR", text('Suspicious link: "', link_name(x), '"'),
            text(x["href"], " → ", x["reason"]), _probe_locator(x),
        ),
    ), none_passed()


@rule("staging-links")
def staging_links(m: Mail):
    pattern = with_terms(STAGING, m.extra_staging)
    return each(
        m.links, lambda x: x["status"].isNotNull() & F.rlike(x["href"], pattern),
        lambda x: finding(
            "staging-links", "liens", "CRITIQUE", "Link to a test environment",
            x["href"], _probe_locator(x),
        ),
    ), none_passed()


@rule("empty-anchor-cta")
def empty_anchor(m: Mail):
    return each(
        m.links,
        lambda x: (x["kind"] == "anchor") & (x["text"] != "")
        & ~x["text"].rlike("(?iu)d[ée]sinscri|unsubscribe"),
        lambda x: finding(
            "empty-anchor-cta", "liens", "MAJEUR", text('CTA without destination: "', x["text"], '"'),
            text('href="', F.when(x["href"] == "", F.lit("#")).otherwise(x["href"]), '"'),
            link_locator(x),
        ),
    ), none_passed()


@rule("ampscript-redirect")
def ampscript_redirect(m: Mail):
    return each(
        m.links,
        lambda x: (x["kind"] == "ampscript") & x["href"].rlike(r"(?iu)%%=?\s*v\(")
        & ~x["href"].rlike("(?iu)RedirectTo"),
        lambda x: finding(
            "ampscript-redirect", "liens", "CRITIQUE",
            "Dynamic link without RedirectTo: it will lead nowhere", x["href"],
            link_locator(x),
        ),
    ), none_passed()


@rule("utm-campaign-consistency")
def utm_consistency(m: Mail):
    v = m.utm_campaigns
    quoted = F.array_join(F.transform(v, lambda c: text('"', c, '"')), " vs ")
    return only_if(
        F.size(v) > 1,
        finding(
            "utm-campaign-consistency", "tracking", "MAJEUR",
            text("Inconsistent utm_campaign across links: ", quoted), F.array_join(v, " | "), "liens",
        ),
    ), only_if(
        F.size(v) == 1,
        passed("utm-campaign-consistency", "tracking", text('utm_campaign is "', F.get(v, 0), '"')),
        NO_PASSED,
    )


def untagged(m: Mail) -> Column:
    return F.filter(
        m.trackable,
        lambda x: (F.size(x["utm"]) == 0) & ~x["text"].rlike(UNTRACKED_TEXT)
        & ~x["href"].rlike(UNTRACKED_HREF)
        & ~F.coalesce(x["final_url"].rlike(UNTRACKED_HREF), F.lit(False))
        & ((x["kind"] != "tracked") | x["final_url"].isNotNull()),
    )


@rule("utm-missing")
def utm_missing(m: Mail):
    some = F.exists(m.trackable, lambda x: F.size(x["utm"]) > 0)

    def report(no: Column) -> Column:
        n = F.size(no)
        names = F.array_join(
            F.transform(
                F.slice(no, 1, 3),
                lambda x: text('"', F.when(x["text"] != "", x["text"]).otherwise(x["href"]), '"'),
            ), ", ",
        )
        more = F.when(n > 3, text(" and ", n - 3, " more")).otherwise("")
        lines = F.transform(
            no,
            lambda x: text(F.when(x["text"] != "", x["text"]).otherwise("?"), " → ", x["href"]),
        )
        return only_if(
            (n > 0) & some,
            finding(
                "utm-missing", "tracking", "MAJEUR",
                text(n, " link(s) without any UTM parameter while others have them: ", names, more),
                F.array_join(lines, " | "), "liens",
            ),
        )

    return let(untagged(m), report), none_passed()


@rule("malformed-url")
def malformed_url(m: Mail):
    return each(
        m.links, lambda x: (x["kind"] == "statique") & x["href"].rlike(r"\?\?|%20%20| "),
        lambda x: finding(
            "malformed-url", "tracking", "MINEUR", "Malformed URL (blank or double question mark)",
            x["href"], link_locator(x), REVIEW,
        ),
    ), none_passed()


def _content_images(m: Mail) -> Column:
    return F.filter("facts.images", lambda im: ~im["is_pixel"])


def _file_names(images: Column) -> Column:
    return F.array_join(F.transform(images, lambda im: F.substring_index(im["src"], "/", -1)), ", ")


@rule("image-alt")
def image_alt(m: Mail):
    def report(imgs: Column) -> Column:
        bare = F.filter(imgs, lambda im: F.coalesce(im["alt"], F.lit("")) == "")
        return only_if(
            F.size(bare) > 0,
            finding(
                "image-alt", "assets", "MAJEUR",
                text(F.size(bare), " of ", F.size(imgs), " image(s) have no alternative text"),
                _file_names(bare), "images",
            ),
        )

    imgs = _content_images(m)
    all_good = (F.size(imgs) > 0) & F.forall(imgs, lambda im: nonempty(im["alt"]))
    return let(imgs, report), only_if(
        all_good,
        passed("image-alt", "assets", text("All images have alternative text (", F.size(imgs), ")")),
        NO_PASSED,
    )


@rule("image-dimensions")
def image_dimensions(m: Mail):
    loose = F.filter(
        _content_images(m),
        lambda im: (im["kind"] == "remote") & ~(nonempty(im["width"]) & nonempty(im["height"])),
    )
    return let(
        loose,
        lambda ims: only_if(
            F.size(ims) > 0,
            finding(
                "image-dimensions", "rendu", "MINEUR",
                text(F.size(ims), " image(s) without width and height"), _file_names(ims), "images",
                REVIEW,
            ),
        ),
    ), none_passed()


def around(source: Column, start: Column, before: int = 60, after: int = 80) -> Column:
    """Text from `before` characters ahead of a 1-based hit to `after` past its start."""
    lo = F.greatest(start - 1 - before, F.lit(0))
    return F.substring(source, lo + 1, start - 1 + after - lo)


@rule("placeholders")
def placeholders(m: Mail):
    pattern = with_terms(PLACEHOLDER, m.extra_placeholders)
    hit = F.call_function("regexp_extract", m.all_text, pattern, F.lit(0))
    return only_if(
        hit != "",
        finding(
            "placeholders", "contenu", "CRITIQUE", text('Placeholder left in the copy: "', hit, '"'),
            around(m.all_text, F.regexp_instr(m.all_text, pattern)), "contenu",
        ),
    ), only_if(hit == "", passed("placeholders", "contenu", "No placeholder found"), NO_PASSED)


@rule("copyright-year")
def copyright_year(m: Mail):
    years = "|".join(str(m.run_year - i) for i in (3, 2, 1))
    pattern = rf"(?iu)(©|&copy;|copyright)\s*({years})"
    footer = F.coalesce(F.col("facts.footer"), F.lit(""))
    return only_if(
        footer.rlike(pattern),
        finding(
            "copyright-year", "contenu", "MAJEUR",
            text("Outdated year in the footer: ", F.regexp_extract(footer, pattern, 2),
                 " instead of ", m.run_year),
            F.regexp_extract(footer, pattern, 0), "footer",
        ),
    ), none_passed()


@rule("personalization-tokens")
def personalization_tokens(m: Mail):
    known = bare_terms(m.extra_tokens, lambda t: F.regexp_replace(t, "^%%|%%$", ""))

    def unknown(t: Column) -> Column:
        bare = F.regexp_replace(F.lower(t), "^%%|%%$", "")
        return ~t.rlike(KNOWN_TOKENS) & ~F.exists(known, lambda k: F.startswith(bare, k))

    return each(
        F.col("facts.tokens"), unknown,
        lambda t: finding(
            "personalization-tokens", "contenu", "MAJEUR",
            text("Unknown personalization token: ", t), t, "contenu",
        ),
    ), none_passed()


@rule("brand-allowed-domains")
def allowed_domains(m: Mail):
    domains = F.transform(m.allowed_domains, F.lower)
    social = bare_terms(m.social, lambda t: t)

    def outside(x: Column) -> Column:
        inside = F.exists(
            domains, lambda d: (x["host"] == d) | F.endswith(x["host"], F.concat(F.lit("."), d))
        )
        inside = inside | F.exists(social, lambda s: F.contains(x["host"], s))
        return (x["kind"] == "statique") & x["host"].isNotNull() & ~inside

    active = F.coalesce(F.size(m.allowed_domains), F.lit(0)) > 0
    rows = each(
        m.trackable, outside,
        lambda x: finding(
            "brand-allowed-domains", "liens", "MAJEUR",
            text("Link to a domain outside the brand's list: ", x["host"]), x["href"],
            link_locator(x),
        ),
    )
    return F.when(active, rows).otherwise(F.array().cast(NO_FINDINGS)), only_if(
        active, passed("brand-allowed-domains", "liens", "Brand domains checked"), NO_PASSED
    )


def attach_rules(mails: DataFrame, custom: DataFrame) -> DataFrame:
    """RES-5: adds `brand_rules` to mails from rule rows (campaign_id, ord, rule_id, check, severity, title,
    tokens, exact_text, max_length). One campaign's rules are a few dozen rows; mails without get none."""
    rule = F.struct("ord", "rule_id", "check", "severity", "title", "tokens", "exact_text", "max_length")
    per_campaign = custom.groupBy("campaign_id").agg(F.array_sort(F.collect_list(rule)).alias("brand_rules"))
    return skew_join(mails, per_campaign, ["campaign_id"], "left")


def _rule_severity(r: Column) -> Column:
    return F.when(r["severity"] == "error", "CRITIQUE").when(
        r["severity"] == "warning", "MAJEUR"
    ).otherwise("MINEUR")


def _term_pattern(term: Column) -> Column:
    return F.concat(
        F.lit("(?iu)" + WORD_EDGE),
        F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1"),
        F.lit(WORD_EDGE),
    )


@rule("brand-editorial-rules")
def editorial_rules(m: Mail):
    """RUL-18 forbidden terms, RUL-19 required text, RUL-20 subject length: rules are data."""
    rid = "brand-editorial-rules"
    subject = F.col("facts.subject")

    def forbidden(r: Column) -> Column:
        first = F.get(
            F.filter(
                F.transform(r["tokens"], _term_pattern), lambda p: F.regexp(m.all_text, p)
            ), 0,
        )
        return let(
            first,
            lambda p: finding(
                rid, "guidelines", _rule_severity(r),
                text(r["title"], ': forbidden term "', F.regexp_substr(m.all_text, p), '"'),
                around(m.all_text, F.regexp_instr(m.all_text, p)), "contenu",
            ),
        )

    def has_forbidden(r: Column) -> Column:
        return (r["check"] == "forbidden_terms") & F.coalesce(
            F.exists(r["tokens"], lambda t: F.regexp(m.all_text, _term_pattern(t))), F.lit(False)
        )

    def folded(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, WS + "+", " "))

    def lacks_text(r: Column) -> Column:
        return ~F.contains(folded(m.all_text), folded(r["exact_text"]))

    terms = each(m.brand_rules, has_forbidden, forbidden)
    wanted = F.filter(
        m.brand_rules, lambda r: (r["check"] == "required_text") & nonempty(r["exact_text"])
    )
    missing = each(
        wanted, lacks_text,
        lambda r: finding(
            rid, "guidelines", _rule_severity(r), text(r["title"], ": required mention missing"),
            text("Rule: ", r["title"]), "contenu", None, r["exact_text"], "",
        ),
    )
    long = each(
        m.brand_rules,
        lambda r: (r["check"] == "max_length") & (F.coalesce(r["max_length"], F.lit(0)) > 0)
        & (F.length(subject) > r["max_length"]),
        lambda r: finding(
            rid, "guidelines", _rule_severity(r),
            text(r["title"], ": subject has ", F.length(subject), " characters (max ", r["max_length"], ")"),
            subject, "subject", "Problem in the subject line",
        ),
    )
    ok = F.transform(
        F.filter(wanted, lambda r: ~lacks_text(r)),
        lambda r: passed(rid, "guidelines", text("Required mention present (", r["title"], ")")),
    )
    none = F.array().cast(NO_FINDINGS)
    return F.concat(*[F.coalesce(a, none) for a in (terms, missing, long)]), F.coalesce(
        ok, none_passed()
    )


@rule("brief-promo-code")
def promo_code(m: Mail):
    code = m.brief_promo_code
    there = F.contains(F.lower(m.all_text), F.lower(code))
    return only_if(
        nonempty(code) & ~there,
        finding(
            "brief-promo-code", "brief", "CRITIQUE", text('Promo code "', code, '" not found'),
            text('Brief: "', code, '"'), "contenu", "Problem in the content", code, "",
        ),
    ), only_if(
        nonempty(code) & there,
        passed("brief-promo-code", "brief", text('Promo code "', code, '" present')), NO_PASSED,
    )


@rule("brief-utm-campaign")
def brief_utm(m: Mail):
    want = m.brief_utm_campaign
    seen = F.exists(m.utm_campaigns, lambda c: F.lower(c) == F.lower(want))
    all_seen = F.array_join(m.utm_campaigns, ", ")
    return only_if(
        nonempty(want) & (F.size(m.utm_campaigns) > 0) & ~F.coalesce(seen, F.lit(False)),
        finding(
            "brief-utm-campaign", "brief", "MAJEUR",
            text("utm_campaign (", all_seen, ') differs from the brief ("', want, '")'),
            text('Brief: "', want, '"'), "liens", "Problem in the tracking", want, all_seen,
        ),
    ), none_passed()


@rule("utm-source-salesforce")
def utm_source(m: Mail):
    name = m.salesforce_name
    wanted = F.lower(F.trim(name))
    observed = F.filter(
        F.transform(
            m.testable, lambda x: F.coalesce(x["utm"]["utm_source"], x["other"]["e"])
        ), nonempty,
    )

    def report(obs: Column) -> Column:
        bad = F.filter(obs, lambda v: F.lower(F.trim(v)) != wanted)
        distinct = F.array_distinct(bad)
        last = lambda c: F.lower(F.substring_index(c, "_", -1))
        renamed = (F.size(distinct) == 1) & (last(F.get(distinct, 0)) == last(name))
        none_at_all = finding(
            "utm-source-salesforce", "tracking", "MAJEUR",
            text('No link carries the campaign name in utm_source (expected "', name, '")'),
            text("0 of ", F.size(m.testable), " testable links"), "liens", None, name, "",
        )
        differs = finding(
            "utm-source-salesforce", "tracking", "MAJEUR",
            text("Campaign name in the links differs from the brief (", F.size(bad), " links)",
                 F.when(renamed, F.lit(" — probable rename")).otherwise("")),
            text("Brief: ", name, " — links: ", F.array_join(distinct, ", ")),
            "liens", None, name, F.get(distinct, 0),
        )
        return (
            F.when(F.size(obs) == 0, F.array(none_at_all))
            .when(F.size(bad) > 0, F.array(differs))
            .otherwise(F.array().cast(NO_FINDINGS))
        )

    fine = (F.size(observed) > 0) & F.forall(observed, lambda v: F.lower(F.trim(v)) == wanted)
    return F.when(nonempty(name), let(observed, report)).otherwise(
        F.array().cast(NO_FINDINGS)
    ), only_if(
        nonempty(name) & F.coalesce(fine, F.lit(False)),
        passed("utm-source-salesforce", "tracking", text("utm_source is the campaign name on ", F.size(observed), " link(s)")),
        NO_PASSED,
    )


@rule("utm-campaign-market")
def utm_market(m: Mail):
    rid = "utm-campaign-market"
    market = F.col("test_name.market")
    lang = m.detected_lang
    vals = m.utm_campaigns
    off_market = F.filter(vals, lambda c: F.upper(F.trim(c)) != market)
    off_lang = F.filter(vals, lambda c: ~same_lang(c, lang))

    def by_market(bad: Column) -> Column:
        seen = F.array_join(bad, ", ")
        return only_if(
            F.size(bad) > 0,
            finding(
                rid, "tracking", "MAJEUR",
                text("utm_campaign (", seen, ') differs from the market "', market, '"'),
                F.array_join(bad, " | "), "liens", None, market, seen,
            ),
        )

    def by_language(bad: Column) -> Column:
        seen = F.array_join(bad, ", ")
        like_market = F.forall(bad, lambda c: F.trim(c).rlike(MARKET_CODE))
        like_lang = F.exists(bad, lambda c: F.trim(c).rlike(LANG_LIKE))
        return (
            F.when((F.size(bad) == 0) | like_market, F.array().cast(NO_FINDINGS))
            .when(
                like_lang,
                F.array(finding(
                    rid, "tracking", "MAJEUR",
                    text("utm_campaign (", seen, ") differs from the language ", lang),
                    F.array_join(bad, " | "), "liens",
                )),
            )
            .otherwise(
                F.array(finding(
                    rid, "tracking", "MINEUR",
                    text("utm_campaign (", seen, ") is neither a market nor the language ", lang),
                    F.array_join(bad, " | "), "liens", REVIEW,
                ))
            )
        )

    some = F.size(vals) > 0
    found = (
        F.when(some & market.isNotNull(), let(off_market, by_market))
        .when(some & nonempty(lang), let(off_lang, by_language))
        .otherwise(F.array().cast(NO_FINDINGS))
    )
    probable = F.forall(off_lang, lambda c: F.trim(c).rlike(MARKET_CODE))
    label = (
        F.when(some & market.isNotNull(), F.when(
            F.size(off_market) == 0, text("utm_campaign is the market ", market)))
        .when(some & nonempty(lang), F.when(
            F.size(off_lang) == 0, text("utm_campaign matches the language ", lang)
        ).when(probable, text("utm_campaign is a probable market code")))
    )
    return found, only_if(label.isNotNull(), passed(rid, "tracking", label), NO_PASSED)


@rule("cn-domain-mix")
def cn_domain_mix(m: Mail):
    severity = F.when(m.explicit_market.isNotNull(), "CRITIQUE").otherwise("MAJEUR")
    note = F.when(m.explicit_market.isNotNull(), "").otherwise(" (inferred market)")

    def cn_host(x: Column) -> Column:
        final = urls.host_of(x["final_url"])
        return F.when(urls.is_cn_host(x["host"]), x["host"]).when(urls.is_cn_host(final), final)

    rows = each(
        m.testable, lambda x: x["host"].isNotNull() & cn_host(x).isNotNull(),
        lambda x: finding(
            "cn-domain-mix", "liens", severity,
            text("Chinese domain (", cn_host(x), ") in a ", m.effective_market, " mail", note),
            text('"', link_name(x), '" → ', F.coalesce(x["final_url"], x["href"])),
            link_locator(x),
        ),
    )
    return F.when(m.effective_market != "CN", rows).otherwise(
        F.array().cast(NO_FINDINGS)
    ), none_passed()


# Judgement rules with an exact reading of ours (the reference asks a model).


@rule("same-cta-different-destination")
def same_cta(m: Mail):
    named = F.filter(m.trackable, lambda x: x["text"] != "")

    def report(xs: Column) -> Column:
        pairs = F.array_distinct(
            F.transform(
                xs,
                lambda x: F.struct(
                    norm_text(x["text"]).alias("t"), urls.normalize_url(x["href"]).alias("u")
                ),
            )
        )
        texts = F.transform(pairs, lambda p: p["t"])
        repeated = F.array_sort(
            F.array_distinct(
                F.filter(texts, lambda t: F.size(F.filter(texts, lambda o: o == t)) > 1)
            )
        )
        return F.transform(
            repeated,
            lambda t: finding(
                "same-cta-different-destination", "liens", "MAJEUR",
                text('CTA "', t, '" has several destinations'), t, "liens",
            ),
        )

    return let(named, report), none_passed()


def _utm_rule(rule_id: str, message: str, bad_value) -> None:
    @rule(rule_id)
    def check(m: Mail):
        return each(
            m.links,
            lambda x: F.exists(F.map_entries(x["own_utm"]), lambda e: bad_value(e["value"])),
            lambda x: finding(
                rule_id, "tracking", "MINEUR", message, x["href"], link_locator(x)
            ),
        ), none_passed()


_utm_rule("utm-empty", "UTM parameter without a value", lambda v: v == "")
_utm_rule(
    "utm-placeholder", "Placeholder inside a UTM value",
    lambda v: v.rlike(rf"(?iu){WORD_EDGE}(TBD|TODO|xxx+){WORD_EDGE}|placeholder|lorem|\{{\{{|\[\["),
)
# Values are decoded once at extraction, so %25xx shows as %xx.
_utm_rule("utm-double-encoded", "UTM value is encoded twice", lambda v: v.rlike("%[0-9A-Fa-f]{2}"))


@rule("preheader-repeats-subject")
def preheader_repeats(m: Mail):
    s, p = F.col("facts.subject"), F.col("facts.preheader")
    return only_if(
        F.coalesce((norm_text(s) == norm_text(p)) & nonempty(p), F.lit(False)),
        finding(
            "preheader-repeats-subject", "contenu", "MINEUR", "The preheader repeats the subject",
            p, "subject", "Problem in the subject line",
        ),
    ), none_passed()


@rule("no-cta")
def no_cta(m: Mail):
    return only_if(
        ~F.exists(m.testable, lambda x: x["text"] != ""),
        finding(
            "no-cta", "contenu", "MAJEUR", "The mail has no call-to-action link", "", "contenu"
        ),
    ), none_passed()


def evaluate(prepared: DataFrame, mail: Mail | None = None, rule_ids: list[str] | None = None):
    """SET-1: `findings` and `passed` of the rules, in rule order, as two columns per mail."""
    mail = mail or Mail()
    results = [RULES[r](mail) for r in (rule_ids or RULES)]
    none, none_p = F.array().cast(NO_FINDINGS), none_passed()
    return prepared.withColumn(
        "findings", F.concat(*[F.coalesce(f, none) for f, _ in results])
    ).withColumn("passed", F.concat(*[F.coalesce(p, none_p) for _, p in results]))
