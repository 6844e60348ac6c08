"""Language codes: aliases, market columns, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkproof.functions.text import fold_space, let

# Names under which a language is met, by canonical code.
ALIASES = {
    "EN": ["EN", "ENG", "ENGLISH", "US - CA", "US-CA", "US", "CA", "GB", "UK"],
    "FR": ["FR", "FRA", "FRENCH"],
    "IT": ["IT", "ITA", "ITALIAN"],
    "ES": ["ES", "ES - MX", "ES-MX", "MX", "SPA", "SPANISH"],
    "PT": ["PT", "BR", "PT-BR", "POR", "PORTUGUESE"],
    "DE": ["DE", "GER", "DEU", "GERMAN"],
    "KO": ["KO", "KR", "KOR", "KOREAN"],
    "JA": ["JA", "JP", "JPN", "JAPANESE"],
    "ZH": ["ZH", "CN", "ZHS", "ZHT", "ZH-CN", "ZH-HANS", "CHINESE", "SIMPLIFIED CHINESE"],
    "TH": ["TH", "THA", "THAI"],
    "NL": ["NL", "DUTCH"],
    "RU": ["RU", "RUSSIAN"],
    "AR": ["AR", "ARABIC"],
}
ALIAS_TO_CODE = {alias: code for code, aliases in ALIASES.items() for alias in aliases}
# Display labels.
LABELS = {
    "EN": "English", "FR": "Français", "IT": "Italiano", "ES": "Español", "PT": "Português",
    "DE": "Deutsch", "KO": "한국어 (Korean)", "JA": "日本語 (Japanese)", "ZH": "中文 (Chinese)",
    "TH": "ไทย (Thai)", "NL": "Nederlands", "RU": "Русский (Russian)", "AR": "العربية (Arabic)",
}
# Market columns keep their own key but share a base language.
MARKET_BASE = {"MX": "ES", "ZHS": "ZH", "ZHT": "ZH"}
MARKET_LABELS = {
    "MX": "Español (México)",
    "ZHS": "简体中文 (Simplified Chinese)",
    "ZHT": "繁體中文 (Traditional Chinese)",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def norm_code(c: Column) -> Column:
    return F.upper(fold_space(c))


def canon_lang(c: Column) -> Column:
    """SCL-13: canonical language of a code or name; '' for blank, the prefix when unknown."""

    def lookup(x: Column) -> Column:
        return F.coalesce(
            _lookup(ALIAS_TO_CODE, x["norm"]),
            _lookup(ALIAS_TO_CODE, x["before"]),
            _lookup(ALIAS_TO_CODE, x["prefix"]),
            F.nullif(x["prefix"], F.lit("")),
            x["norm"],
        )

    def parts(norm: Column) -> Column:
        before = F.trim(F.substring_index(norm, "(", 1))
        prefix = F.trim(F.regexp_extract(before, "^([^-_/]*)", 1))
        return F.struct(norm.alias("norm"), before.alias("before"), prefix.alias("prefix"))

    return let(let(norm_code(c), parts), lookup)


def canon_column(c: Column) -> Column:
    """SCL-14: key of a language column, NULL when the platform does not know it."""
    pair = F.struct(norm_code(c).alias("n"), canon_lang(c).alias("c"))
    return let(
        pair,
        lambda x: F.when(x["n"].isin(*MARKET_BASE), x["n"]).when(x["c"].isin(*LABELS), x["c"]),
    )


def base_lang(c: Column) -> Column:
    return F.coalesce(_lookup(MARKET_BASE, norm_code(c)), canon_lang(c))


def same_lang(a: Column, b: Column) -> Column:
    return canon_lang(a) == canon_lang(b)


def display_lang(c: Column) -> Column:
    return let(
        canon_lang(c),
        lambda x: F.coalesce(_lookup(MARKET_LABELS, norm_code(c)), _lookup(LABELS, x), x),
    )


def grid_key_for(keys: Column, lang: Column, market: Column) -> Column:
    """JOIN-3 on a row: the market's own column if it has the same base language, else the first
    column (or composite 'A|B') of the language."""
    def has_code(key: Column, test) -> Column:
        return F.exists(F.split(key, r"\|"), test)

    wanted = norm_code(market)
    exact = F.get(
        F.filter(keys, lambda k: has_code(k, lambda c: F.upper(F.trim(c)) == wanted)), 0
    )
    first = F.get(F.filter(keys, lambda k: has_code(k, lambda c: same_lang(c, lang))), 0)
    return F.when(
        (F.coalesce(market, F.lit("")) != "") & exact.isNotNull()
        & same_lang(base_lang(exact), lang),
        exact,
    ).otherwise(first)
