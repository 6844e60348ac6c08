"""URL handling as Spark columns.

`parse_url` rejects URLs that browsers accept (a blank in the path), so parts are cut with regular
expressions and a URL counts as parsable when a browser would parse it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkproof.functions.text import let

# Hosts of click-tracking services.
TRACKED_HOST = (
    r"(?iu)(^|\.)(click|cta|t|links?|email|mc|trk|track(ing)?)\.[^/]+"
    r"|exacttarget\.com|exct\.net|salesforce-email|sfmc"
)
# Words of an unsubscribe link, one list per use.
UNSUB_FACTS = (
    r"(?iu)d[ée]sinscri|d[ée]sabonn|unsubscribe|se d[ée]sinscrire|opt[- ]?out|abmelden|darse de baja"
    r"|cancelar (la )?suscripci|annulla l'iscrizione|cancellarsi|退订|配信停止|配信解除|購読解除"
    r"|수신거부|구독\s*취소"
)
UNSUB_PROBE = (
    r"(?iu)unsubscribe|d[ée]sinscri|d[ée]sabonn|opt.?out|se d[ée]sinscrire|preference center"
    r"|g[ée]rer mes pr[ée]f[ée]rences|abmelden|darse de baja|cancelar (la )?suscripci"
    r"|annulla l'iscrizione|退订|配信停止|配信解除|購読解除|수신거부"
)
UNSUB_KEY = (
    r"(?iu)unsubscribe|d[ée]sinscri|d[ée]sabonn|opt.?out|se d[ée]sinscrire|preference center"
    r"|g[ée]rer mes pr[ée]f[ée]rences"
)
UNSUB_SHORT = r"(?iu)d[ée]sinscri|d[ée]sabonn|unsubscribe|opt[- ]?out"
SAFELINK_SUFFIX = ".safelinks.protection.outlook.com"
SOFT_404 = r"(?iu)page (introuvable|non trouv[ée]e)|not found|introuvable|n'existe (pas|plus)|404"

_HTTP = r"(?iu)^https?://([^/?#]*)"



def is_http(c: Column) -> Column:
    return c.rlike(r"(?iu)^https?://[^/?#\s]+")


def authority(c: Column) -> Column:
    return F.regexp_extract(c, _HTTP, 1)


def host_of(c: Column) -> Column:
    """SCL-12: lower-case host without user and port, NULL when the URL does not parse."""
    bare = F.regexp_replace(authority(F.trim(c)), r"^.*@|:\d*$", "")
    return F.lower(F.nullif(F.regexp_extract(bare, r"^([^\s<>^|%]+)$", 1), F.lit("")))


def is_cn_host(host: Column) -> Column:
    return F.coalesce(F.endswith(host, F.lit(".cn")), F.lit(False))


def parses(c: Column, host: Column | None = None) -> Column:
    """The text is an absolute URL."""
    host = host_of(c) if host is None else host
    return F.coalesce(
        host.isNotNull() | c.rlike(r"(?iu)^(?!https?:)[a-z][a-z0-9+.-]*:"), F.lit(False)
    )


def link_kind(h: Column, host: Column) -> Column:
    return (
        F.when(F.contains(h, F.lit("%%")), "ampscript")
        .when(F.startswith(h, F.lit("mailto:")), "mailto")
        .when(F.startswith(h, F.lit("#")) | (h == ""), "anchor")
        .when(~parses(h, host), "ampscript")
        .when(F.coalesce(host.rlike(TRACKED_HOST), F.lit(False)), "tracked")
        .otherwise("statique")
    )


def classify_link(href: Column) -> Column:
    """SCL-1: statique / tracked / ampscript / mailto / anchor."""
    return let(F.trim(href), lambda h: let(host_of(h), lambda host: link_kind(h, host)))


def decode_component(c: Column) -> Column:
    """Percent-decoding that keeps a text with a stray percent sign."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


NO_PARAMS = "array<struct<k:string,v:string>>"


def query_params(url: Column, host: Column | None = None) -> Column:
    """Ordered (k, v) pairs of the query part, decoded; empty when the URL does not parse."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            decode_component(F.substring_index(p, "=", 1)).alias("k"),
            decode_component(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    return F.when(F.contains(url, F.lit("?")) & parses(url, host), pairs).otherwise(
        F.array().cast(NO_PARAMS)
    )


def map_last_wins(entries: Column) -> Column:
    """Map of (k, v) pairs in which the last value of a repeated key counts."""
    return let(
        entries,
        lambda e: F.map_from_entries(
            F.filter(
                e,
                lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]),
            )
        ),
    )


def is_utm(p: Column) -> Column:
    return F.startswith(F.lower(p["k"]), F.lit("utm_"))


def utm_map(params: Column) -> Column:
    return map_last_wins(
        F.transform(
            F.filter(params, is_utm),
            lambda p: F.struct(F.lower(p["k"]).alias("k"), p["v"].alias("v")),
        )
    )


def other_map(params: Column) -> Column:
    return map_last_wins(F.filter(params, lambda p: ~is_utm(p)))


def parse_utm(url: Column) -> Column:
    """SCL-2: utm_* parameters, keys in lower case."""
    return utm_map(query_params(url))


def parse_other_params(url: Column) -> Column:
    """SCL-3: all other parameters."""
    return other_map(query_params(url))


def _decode_again(c: Column) -> Column:
    """Percent signs decoded, `+` left alone; NULL for a stray percent sign."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def unwrap_safe_link(href: Column) -> Column:
    """SCL-4: target of a mail-gateway wrapper, else the link itself."""
    target = F.get(F.filter(query_params(href), lambda p: p["k"] == "url"), 0)["v"]
    wrapped = F.coalesce(F.endswith(host_of(href), F.lit(SAFELINK_SUFFIX)), F.lit(False))
    return F.when(
        F.contains(href, F.lit(SAFELINK_SUFFIX)) & wrapped,
        let(target, lambda t: F.when(t != "", F.coalesce(_decode_again(t), href)).otherwise(href)),
    ).otherwise(href)


def _encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(
                ch.rlike("[^!-~]"), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(path.rlike("[^!-~]"), encoded).otherwise(path)


def url_path(url: Column) -> Column:
    return let(F.regexp_extract(url, r"(?iu)^https?://[^/?#]*([^?#]*)", 1), _encode_path)


def _kept_query(params: Column) -> Column:
    kept = F.filter(params, lambda p: ~(is_utm(p) | (F.lower(p["k"]) == "e")))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))),
        "&",
    )


def normalize_url(url: Column) -> Column:
    """SCL-5: destination of a link without tracking parameters; NULL for dynamic links."""

    def destination(u: Column) -> Column:
        return let(
            F.struct(host_of(u).alias("host"), _kept_query(query_params(u)).alias("qs")),
            lambda x: F.when(
                ~F.contains(u, F.lit("%%")),
                F.concat(
                    x["host"],
                    F.regexp_replace(url_path(u), "/+$", ""),
                    F.when(x["qs"] != "", F.concat(F.lit("?"), x["qs"])).otherwise(F.lit("")),
                ),
            ),
        )

    return let(F.trim(url), destination)


def link_key(kind: Column, href: Column, text: Column) -> Column:
    """SCL-6: links with this key in common are probed once."""

    def target(h: Column) -> Column:
        no_fragment = F.regexp_replace(h, r"(?s)#.*$", "")
        canonical = F.concat(
            F.lower(F.regexp_extract(h, r"(?iu)^(https?://[^/?#]*)", 1)),
            let(url_path(h), lambda p: F.when(p == "", F.lit("/")).otherwise(p)),
            F.regexp_extract(no_fragment, r"(?s)^[^?]*(\?.*)$", 1),
        )
        return F.when(is_http(h), canonical).when(parses(h), no_fragment).otherwise(h)

    unsub = F.when(
        href.rlike(UNSUB_KEY) | text.rlike(UNSUB_KEY), F.lit("unsub|")
    ).otherwise(F.lit(""))
    return F.concat(kind, F.lit("|"), unsub, let(F.trim(href), target))


def private_host(url: Column) -> Column:
    """SCL-30: the URL names a private or local host literally."""
    h = F.regexp_replace(F.coalesce(host_of(url), F.lit("")), r"^\[|\]$", "")
    v4 = F.regexp_replace(h, "^::ffff:", "")
    octet = lambda i: F.get(F.split(v4, r"\."), i).cast("int")
    a, b = octet(0), octet(1)
    v4_private = v4.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
    )
    v6_private = F.contains(h, F.lit(":")) & ((h == "::1") | h.rlike("^(fe80|fc|fd)"))
    named = (h == "localhost") | h.rlike(r"\.(local|internal)$")
    return F.coalesce(v4_private | v6_private | named, F.lit(False))
