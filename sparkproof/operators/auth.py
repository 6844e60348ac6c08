"""Message headers, authentication results and the rules on them, all as columns of a message row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.text import let
from sparkproof.operators.findings import NO_FINDINGS, REVIEW, finding, only_if, text

# Methods of an Authentication-Results header.
METHODS = ["spf", "dkim", "dmarc", "arc", "compauth", "dkim-adsp", "iprev", "auth", "bimi"]
ESP_DOMAIN = r"(?iu)(exacttarget\.com|salesforce\.com)$"
T_PROBLEM = "Problem in the email authentication"
T_UNVERIFIED = "Email authentication could not be verified"


def header_rows(raw: Column) -> Column:
    """EXT-11: array of (name, value) of the header block, continuation lines unfolded.

    The block ends at the first blank line or line that is no header."""
    head = F.regexp_replace(raw, r"\r\n", "\n")
    unfolded = F.regexp_replace(head, r"\n[ \t]+(?=\S)", " ")
    lines = F.split(unfolded, "\n")
    name = r"^([\x21-\x39\x3b-\x7e]+):\s*"

    def until_end(ls: Column) -> Column:
        first_bad = F.get(
            F.filter(F.transform(ls, lambda x, i: F.when(~x.rlike(name), i)), lambda i: i.isNotNull()), 0
        )
        return F.slice(ls, F.lit(1), F.coalesce(first_bad, F.size(ls)))

    return F.transform(
        let(lines, until_end),
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, name, 1)).alias("name"),
            F.trim(F.regexp_replace(x, name, "")).alias("value"),
        ),
    )


def header_value(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"]


def strip_comments(c: Column) -> Column:
    """Text outside parentheses, which may nest; a stray closing one is kept.

    One pattern takes out what isn't nested. Only texts that hold an opening parenthesis after it are
    folded, by the pieces between parentheses and not by letters."""
    simple = F.regexp_replace(c, r"\([^()]*\)", "")
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("o"))

    def step(a: Column, piece: Column) -> Column:
        opens, closes = piece == "(", (piece == ")") & (a["d"] > 0)
        return F.struct(
            F.when(opens, a["d"] + 1).when(closes, a["d"] - 1).otherwise(a["d"]).alias("d"),
            F.when((a["d"] == 0) & ~opens, F.concat(a["o"], piece)).otherwise(a["o"]).alias("o"),
        )

    nested = F.aggregate(F.regexp_extract_all(c, F.lit(r"([()]|[^()]+)"), 1), start, step)["o"]
    return F.when(~F.contains(c, F.lit("(")), c).when(~F.contains(simple, F.lit("(")), simple).otherwise(nested)


def parse_auth(raw: Column) -> Column:
    """EXT-13: struct<authserv, results: array<struct<method, result, props>>, raw>."""
    clean = F.trim(F.regexp_replace(strip_comments(raw), r"\s+", " "))
    segments = F.filter(F.transform(F.split(clean, ";"), lambda s: F.trim(s)), lambda s: s != "")

    def build(segs: Column) -> Column:
        has_id = F.coalesce(~F.contains(F.get(segs, 0), F.lit("=")), F.lit(False))
        body = F.when(has_id, F.slice(segs, 2, F.size(segs))).otherwise(segs)
        tokens = F.filter(F.split(F.array_join(body, " "), " "), lambda t: F.contains(t, F.lit("=")))
        pairs = F.transform(
            tokens,
            lambda t: F.struct(
                F.lower(F.substring_index(t, "=", 1)).alias("k"),
                F.regexp_extract(t, "^[^=]*=(.*)$", 1).alias("v"),
            ),
        )

        def results(ps: Column) -> Column:
            starts = F.filter(
                F.transform(ps, lambda p, i: F.when(p["k"].isin(*METHODS), i)), lambda i: i.isNotNull()
            )
            return let(
                starts,
                lambda st: F.transform(
                    st,
                    lambda i, n: F.struct(
                        F.get(ps, i)["k"].alias("method"),
                        F.lower(F.get(ps, i)["v"]).alias("result"),
                        F.slice(
                            ps, i + 2, F.coalesce(F.get(st, n + 1), F.size(ps)) - i - 1
                        ).alias("props"),
                    ),
                ),
            )

        return F.struct(
            F.when(has_id, F.lower(F.substring_index(F.get(segs, 0), " ", 1))).alias("authserv"),
            let(pairs, results).alias("results"),
            raw.alias("raw"),
        )

    return let(segments, build)


def domain_of(c: Column) -> Column:
    """SCL-19."""
    return F.nullif(F.lower(F.trim(F.substring_index(c, "@", -1))), F.lit(""))


def loose_aligned(a: Column, b: Column) -> Column:
    dot = F.lit(".")
    return (a == b) | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a))


def _prop(result: Column, name: str) -> Column:
    hits = F.filter(result["props"], lambda p: p["k"] == name)
    return F.get(hits, F.size(hits) - 1)["v"]


def select_auth(headers: Column, source: Column) -> Column:
    """SCL-20: the first header of the source's own server, else the first header."""
    parsed = F.transform(
        F.filter(headers, lambda h: h["name"] == "authentication-results"),
        lambda h: parse_auth(h["value"]),
    )

    def trusted(p: Column) -> Column:
        return F.when(source == "gmail", F.coalesce(p["authserv"] == "mx.google.com", F.lit(False))).when(
            source == "outlook",
            p["authserv"].isNull() | F.coalesce(p["authserv"].rlike("(?iu)outlook|microsoft"), F.lit(False)),
        ).otherwise(F.lit(False))

    def choose(ps: Column) -> Column:
        own = F.get(F.filter(ps, trusted), 0)
        return F.struct((F.size(ps) > 0).alias("present"), own.isNotNull().alias("trusted"),
                        F.coalesce(own, F.get(ps, 0)).alias("c"))

    def summary(x: Column) -> Column:
        def first(method: str) -> Column:
            return F.get(F.filter(x["c"]["results"], lambda r: r["method"] == method), 0)

        from_domain = domain_of(_prop(first("dmarc"), "header.from"))
        policy = F.upper(F.nullif(F.regexp_extract(
            x["c"]["raw"], r"(?iu)\bdmarc=[a-z]+[^;]*?\(\s*p=([A-Za-z]+)", 1), F.lit("")))
        dkim = F.transform(
            F.filter(x["c"]["results"], lambda r: r["method"] == "dkim"),
            lambda r: let(
                domain_of(F.coalesce(_prop(r, "header.d"), _prop(r, "header.i"))),
                lambda d: F.struct(
                    r["result"].alias("result"), d.alias("domain"), _prop(r, "header.s").alias("selector"),
                    loose_aligned(d, from_domain).alias("aligned"),
                ),
            ),
        )
        return F.struct(
            x["present"].alias("present"), x["trusted"].alias("trusted"), x["c"]["authserv"].alias("authserv"),
            first("spf")["result"].alias("spf"), domain_of(_prop(first("spf"), "smtp.mailfrom")).alias("mailfrom"),
            F.coalesce(dkim, F.array().cast("array<struct<result:string,domain:string,selector:string,aligned:boolean>>")).alias("dkim"),
            first("dmarc")["result"].alias("dmarc"), from_domain.alias("from_domain"), policy.alias("policy"),
            x["c"]["raw"].alias("raw"),
        )

    return let(let(parsed, choose), summary)


def with_message_facts(messages: DataFrame) -> DataFrame:
    """EXT-12 and SCL-20 on rows with `raw` and `source`: headers and the authentication summary."""
    rows = messages.withColumn("headers", header_rows(F.col("raw")))
    h = F.col("headers")
    return rows.withColumns(
        {
            "subject": F.coalesce(header_value(h, "subject"), F.lit("(no subject)")),
            "sender": F.coalesce(header_value(h, "from"), F.lit("?")),
            "sent_at": header_value(h, "date"),
            "list_unsubscribe": header_value(h, "list-unsubscribe"),
            "list_unsubscribe_post": header_value(h, "list-unsubscribe-post"),
            "auth": select_auth(h, F.col("source")),
        }
    )


def _f(rule_id, severity, message, locator, title, evidence=None) -> Column:
    evidence = F.col("auth.raw") if evidence is None else evidence
    return F.array(finding(rule_id, "delivrabilite", severity, message, evidence, locator, title))


def auth_findings(messages: DataFrame) -> DataFrame:
    """RUL-33..37 and RUL-39: adds `findings`."""
    none = F.array().cast(NO_FINDINGS)
    a = F.col("auth")
    critical = F.when(a["trusted"], "CRITIQUE").otherwise("MAJEUR")  # RUL-37
    pass_ = F.coalesce(a["dmarc"] == "pass", F.lit(False))
    no_method = a["spf"].isNull() & a["dmarc"].isNull() & (F.size(a["dkim"]) == 0)
    d, s = a["dmarc"], a["spf"]
    dmarc = (
        F.when(d.isNull(), _f("auth-dmarc", "MINEUR", "No DMARC verdict was reported", "header:dmarc", T_UNVERIFIED))
        .when(d == "pass", none)
        .when(d == "fail", _f("auth-dmarc", critical, "DMARC fails: the mail would be rejected or sent to spam", "header:dmarc", T_PROBLEM))
        .when(d == "none", _f("auth-dmarc", "MAJEUR", "The sending domain publishes no DMARC policy", "header:dmarc", T_PROBLEM))
        .when(d == "bestguesspass", _f("auth-dmarc", "MAJEUR", "DMARC is only a best guess", "header:dmarc", T_PROBLEM))
        .when(d == "temperror", _f("auth-dmarc", "MINEUR", "Temporary error while checking DMARC", "header:dmarc", T_UNVERIFIED))
        .when(d == "permerror", _f("auth-dmarc", "MAJEUR", "The DMARC record is malformed", "header:dmarc", T_PROBLEM))
        .otherwise(_f("auth-dmarc", "MINEUR", "Unusual DMARC verdict", "header:dmarc", T_UNVERIFIED))
    )
    valid = F.filter(a["dkim"], lambda x: x["result"] == "pass")
    esp_only = F.forall(valid, lambda x: F.coalesce(x["domain"].rlike(ESP_DOMAIN), F.lit(False)))
    domains = F.array_join(F.transform(valid, lambda x: text("d=", x["domain"])), ", ")
    dkim = (
        F.when(
            F.size(valid) > 0,
            F.when(~pass_ & esp_only, _f("auth-dkim", "MAJEUR", "The mail is signed only by the sending platform", "header:dkim", T_PROBLEM, domains)).otherwise(none),
        )
        .when(F.size(a["dkim"]) > 0, _f("auth-dkim", F.when(pass_, "MINEUR").otherwise(critical), "No signature of the mail is valid", "header:dkim", T_PROBLEM))
        .otherwise(_f("auth-dkim", F.when(pass_, "MINEUR").otherwise("MAJEUR"), "No signature result was reported", "header:dkim", T_UNVERIFIED))
    )
    spf = (
        F.when(s == "pass", none)
        .when(s.isNull(), _f("auth-spf", "MINEUR", "No SPF result was reported", "header:spf", T_UNVERIFIED))
        .when(s == "temperror", _f("auth-spf", "MINEUR", "Temporary error while checking SPF", "header:spf", T_UNVERIFIED))
        .when(pass_, _f("auth-spf", "MINEUR", "SPF did not pass but DMARC does", "header:spf", REVIEW))
        .when(s.isin("fail", "softfail"), _f("auth-spf", critical, "The sending server is not authorised", "header:spf", T_PROBLEM))
        .otherwise(_f("auth-spf", "MAJEUR", "The sending server could not be checked", "header:spf", T_PROBLEM))
    )
    missing = F.when(
        F.col("source").isin("gmail", "outlook"),
        _f("auth-missing", "MINEUR", "The mailbox recorded no authentication verdict", "header:auth", T_UNVERIFIED, F.lit("Authentication-Results header missing")),
    ).otherwise(none)
    empty = _f("auth-missing", "MINEUR", "The mailbox performed no authentication checks", "header:auth", T_UNVERIFIED)
    one_click = only_if(
        F.col("list_unsubscribe").isNotNull() & F.col("list_unsubscribe_post").isNull(),
        finding("one-click-unsubscribe", "delivrabilite", "MAJEUR", "One-click unsubscribe is missing",
                F.col("list_unsubscribe"), "header:list-unsubscribe", "Problem in the unsubscribe setup"),
    )
    found = F.when(~a["present"], missing).when(no_method, empty).otherwise(F.concat(dmarc, dkim, spf))
    return messages.withColumn("findings", F.concat(found, one_click))


def legacy_auth_findings(flat: DataFrame) -> DataFrame:
    """RUL-38: flat spf/dkim/dmarc texts of older documents, without a structured result."""
    rows = flat.unpivot(["version_id"], ["spf", "dkim", "dmarc"], "method", "verdict")
    return rows.where(F.col("verdict").rlike("(?iu)fail|softfail|permerror|temperror")).select(
        "version_id", F.concat(F.lit("auth-"), "method").alias("rule_id"), F.lit("CRITIQUE").alias("severity"),
        F.concat(F.upper("method"), F.lit(" authentication failure: "), "verdict").alias("message"),
    )


def header_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOIN-18 / SET-4: header lines of one capture beyond their copies in the other."""
    cols = ["message_id", "line"]
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("a")).unionByName(
        b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("b"))
    )
