"""Brief grid against mail text: language detection and the block content rule, per mail row.

`grid` is a struct<languages: array<string>, blocks: array<struct<name, vals: map<key, value>>>,
links: array<struct<block, by_market: map, label_by_lang: map>>>, bounded by one brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkproof.functions.languages import canon_lang, grid_key_for
from sparkproof.functions.text import dice_of_pair, let, norm_detect, norm_text, personalization_pattern
from sparkproof.functions.urls import normalize_url
from sparkproof.operators.findings import finding, nonempty, text
from sparkproof.operators.settings import setting
from sparkproof.operators.skew import skew_join
from sparkproof.sources.tables import kept

LANG_LIKE = r"^[A-Za-z]{2,3}([-_ ]+[A-Za-z]{2,3})?$"
SEPARATOR = " \n "
SIMILARITY_MIN = 0.55
#: Blocks shorter than this are no reliable match.
LEAST = 3


def attach_grid(mails: DataFrame, grids: DataFrame) -> DataFrame:
    """One brief row per campaign joined to its mails; a campaign with most mails is spread."""
    return skew_join(mails, grids, ["campaign_id"], "left")


def first_values(cells: Column) -> Column:
    """A map of each language's value; of several the smallest counts, so that repeated rows change nothing."""
    ordered = F.array_sort(cells)
    keys = F.array_distinct(F.transform(ordered, lambda c: c["lang_key"]))
    return F.map_from_arrays(
        keys, F.transform(keys, lambda k: F.get(F.filter(ordered, lambda c: c["lang_key"] == k), 0)["value"])
    )


def build_grids(blocks: DataFrame, languages: DataFrame) -> DataFrame:
    """Long blocks (campaign_id, block_ord, block, lang_key, value) and (campaign_id, ord, lang_key)
    folded into one grid per campaign. The group is one brief, a sheet of at most some hundred rows."""
    per_block = blocks.groupBy("campaign_id", "block_ord").agg(
        F.first("block").alias("name"),
        F.collect_set(F.struct("lang_key", "value")).alias("cells"),
    ).withColumn("vals", first_values(F.col("cells"))).drop("cells")
    folded = per_block.groupBy("campaign_id").agg(
        F.array_sort(
            F.collect_list(F.struct("block_ord", "name", F.map_entries("vals").alias("v")))
        ).alias("b")
    )
    keys = languages.groupBy("campaign_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "lang_key"))), lambda x: x["lang_key"]).alias("languages")
    )
    named = F.transform(
        "b", lambda x: F.struct(x["name"].alias("name"), F.map_from_entries(x["v"]).alias("vals"))
    )
    return folded.join(keys, "campaign_id").select(
        "campaign_id", F.struct("languages", named.alias("blocks")).alias("grid")
    )


def originals() -> Column:
    return F.filter(F.concat(F.array("facts.subject", "facts.preheader"), "facts.texts"), nonempty)


def detect_language(mails: DataFrame) -> DataFrame:
    """AGG-11: adds `detected` struct<lang, ambiguous, confidence, basis>."""
    texts = F.concat(
        F.transform(F.filter(F.array("facts.subject", "facts.preheader"), nonempty), norm_detect),
        F.filter(F.transform("facts.texts", norm_detect), lambda t: F.length(t) > 1),
    )
    rows = mails.withColumn("_dt", texts).withColumn("_dj", F.array_join("_dt", SEPARATOR))

    def found(val: Column) -> Column:
        near = F.exists(
            "_dt", lambda t: F.contains(val, t) & (F.length(t) >= F.length(val) * 0.8)
        )
        return F.contains(F.col("_dj"), val) | near

    def score(key: Column) -> Column:
        vals = F.filter(
            F.transform(
                "grid.blocks",
                lambda b: F.struct(
                    b["name"].alias("n"), norm_detect(F.coalesce(b["vals"][key], F.lit(""))).alias("v")
                ),
            ),
            lambda x: F.length(x["v"]) >= 2,
        )
        return let(
            vals,
            lambda vs: F.struct(
                F.size(F.filter(vs, lambda x: found(x["v"]))).alias("score"),
                F.array_join(
                    F.transform(vs, lambda x: F.concat(x["n"], F.lit("::"), x["v"])), " || "
                ).alias("sig"),
                F.filter(
                    F.transform(
                        F.split(key, r"\|"),
                        lambda c: F.coalesce(F.nullif(canon_lang(c), F.lit("")), F.trim(c)),
                    ), lambda c: c != "",
                ).alias("codes"),
            ),
        )

    rows = rows.withColumn("_sc", F.coalesce(F.transform("grid.languages", score), F.array().cast(
        "array<struct<score:int,sig:string,codes:array<string>>>")))
    top = F.array_max(F.transform("_sc", lambda x: x["score"]))
    first = F.get(F.filter("_sc", lambda x: x["score"] == top), 0)
    rows = rows.withColumn("_best", first)
    best = F.col("_best")
    same_score = F.filter("_sc", lambda x: x["score"] == best["score"])
    winners = F.filter(same_score, lambda x: x["sig"] == best["sig"])
    codes = F.array_distinct(F.flatten(F.transform(winners, lambda x: x["codes"])))
    rivals = F.size(same_score) > F.size(winners)
    by_grid = F.struct(
        F.get(codes, 0).alias("lang"),
        F.when(F.size(codes) > 1, codes).alias("ambiguous"),
        F.when(rivals, "low").when(best["score"] >= 2, "high").otherwise("medium").alias("confidence"),
        F.lit("grid").alias("basis"),
    )

    def simple(lang: Column, confidence: str, basis: str) -> Column:
        return F.struct(
            lang.alias("lang"), F.lit(None).cast("array<string>").alias("ambiguous"),
            F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"),
        )

    html = canon_lang(F.col("facts.html_lang"))
    utm = F.filter(
        F.transform(
            F.filter(
                F.transform("facts.links", lambda x: x["utm"]["utm_campaign"]),
                lambda v: nonempty(v) & F.trim(v).rlike(LANG_LIKE),
            ), canon_lang,
        ), nonempty,
    )

    def most_frequent(cs: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(cs),
            lambda c: F.struct(
                F.size(F.filter(cs, lambda o: o == c)).alias("n"),
                (-F.array_position(cs, c)).alias("p"), c.alias("c"),
            ),
        )
        return F.array_max(ranked)["c"]

    rows = rows.withColumn("_utm", let(utm, most_frequent))
    detected = (
        F.when(F.coalesce(best["score"], F.lit(0)) > 0, by_grid)
        .when(nonempty(html), simple(html, "medium", "html"))
        .when(F.col("_utm").isNotNull(), simple(F.col("_utm"), "low", "utm"))
        .otherwise(simple(F.lit(None).cast("string"), "low", "none"))
    )
    return rows.withColumn("detected", detected).drop("_dt", "_dj", "_sc", "_best", "_utm")


def declared_or_detected(declared: Column, detected: Column) -> Column:
    """AGG-22: a declared language wins; a detected one is kept only when certain."""
    sure = (detected["confidence"] == "high") & (
        F.coalesce(F.size(detected["ambiguous"]), F.lit(0)) <= 1
    )
    canon = F.coalesce(F.nullif(canon_lang(declared), F.lit("")), declared)
    return F.when(nonempty(declared), canon).when(sure, detected["lang"])


def base_name(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), name)


def variant_audience(name: Column) -> Column:
    """WIN-7: audience that the final parenthesis of a block name restricts it to."""
    suffix = F.regexp_extract(name, r"\(([^)]*)\)\s*$", 1)
    return F.when(suffix.rlike("(?iu)female|femme|women"), "F").when(
        suffix.rlike(r"(?iu)male|homme|men(?![A-Za-z0-9_])"), "M"
    )


def can_reach(la: Column, lb: Column, minimum: float | Column = SIMILARITY_MIN) -> Column:
    """Upper bound of the Dice coefficient by text lengths."""
    # Divided as the coefficient itself is, so that rounding never puts the bound below it.
    a, b = la - 1, lb - 1
    return (la == lb) | (F.try_divide(F.least(a, b) * 2.0, a + b) >= minimum)


def mail_texts(prepared: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per mail for the block rule: its grid key, audience, joined text and, where its configuration
    has one (`settings`), the similarity from which a text counts as changed instead of missing."""
    keys = languages.groupBy("campaign_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "lang_key"))), lambda x: x["lang_key"]
        ).alias("lang_keys")
    )
    rows = prepared.select(
        "version_id", "campaign_id", "detected_lang", originals().alias("originals"),
        F.col("test_name.market").alias("market"), F.col("test_name.audience").alias("audience"),
        (setting("brief-block-content.similarityPercent", "number", SIMILARITY_MIN * 100) / 100 if "settings" in prepared.columns
         else F.lit(SIMILARITY_MIN)).alias("minimum"),
    )
    rows = skew_join(rows, keys, ["campaign_id"], "inner")
    return rows.withColumn(
        "grid_key", grid_key_for(F.col("lang_keys"), F.col("detected_lang"), F.col("market"))
    ).withColumn("joined", F.array_join(F.transform("originals", norm_text), SEPARATOR))


def block_table(blocks: DataFrame) -> DataFrame:
    """One row per block: normalised values and patterns by language. A block has a few languages."""
    value = F.col("value")
    cell = F.struct(
        "lang_key", value.alias("raw"), norm_text(value).alias("norm"),
        personalization_pattern(value).alias("pattern"),
    )
    cells = blocks.where(value.isNotNull()).withColumn("cell", cell)
    return cells.groupBy("campaign_id", "block_ord").agg(
        F.first("block").alias("name"), F.collect_list("cell").alias("cells")
    ).withColumn("base", base_name(F.col("name"))).withColumn("aud", variant_audience(F.col("name")))


def block_outcomes(mails: DataFrame, blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """RUL-31: one outcome per mail and block group, from `mail_texts` and `block_table`.

    Blocks of fewer than `least` characters are left out. Whatever it is, another language counts only where both
    texts have LEAST.

    A mail meets the blocks of its own brief only. The mail text is read while the join streams and
    dropped before the next shuffle, which carries a few short columns per block. Mail texts are written
    once, as they are parsed from HTML and needed again for blocks that are nowhere."""
    mails = kept(mails, "mail-texts")
    joined = skew_join(mails.drop("originals"), blocks, ["campaign_id"], "inner")
    key = F.col("grid_key")
    own = F.get(F.filter("cells", lambda c: c["lang_key"] == key), 0)
    rows = joined.where(key.isNotNull()).withColumn("own", own).where(F.length("own.norm") >= least)
    text_, norm = F.col("joined"), F.col("own.norm")
    located = F.contains(text_, norm) | F.coalesce(
        F.regexp(text_, F.col("own.pattern")), F.lit(False)
    )
    ranked = F.filter(
        "cells",
        lambda c: (c["lang_key"] != key) & (F.length(norm) >= LEAST) & (F.length(c["norm"]) >= LEAST)
        & (c["norm"] != norm) & F.contains(text_, c["norm"]),
    )
    foreign = F.array_min(
        F.transform(
            ranked,
            lambda c: F.struct(F.array_position("lang_keys", c["lang_key"]).alias("p"), c["raw"].alias("raw")),
        )
    )
    rows = rows.withColumn("located", located).withColumn("foreign", foreign).select(
        "version_id", "audience", "block_ord", "name", "base", "aud", F.col("own.raw").alias("raw"),
        F.col("own.norm").alias("norm"), "located", "foreign",
    )
    enforce = F.coalesce(F.col("audience").isin("F", "M"), F.lit(False))
    mine = F.col("aud").isNull() | (F.col("aud") == F.col("audience"))
    # Variant groups are a handful of rows; the split by audience needs two facts of the group.
    group = Window.partitionBy("version_id", "base")
    rows = rows.withColumn(
        "_enforce",
        enforce & F.max(F.col("aud").isNotNull()).over(group) & F.max(mine).over(group),
    ).withColumn("n_variants", F.count(F.lit(1)).over(group))
    wanted = ~F.col("_enforce") | mine
    order = F.col("block_ord")

    def first(condition: Column, value: Column) -> Column:
        return F.min_by(value, F.when(condition, order))

    picked = F.struct("name", "raw")
    groups = rows.groupBy("version_id", "base").agg(
        F.max("n_variants").alias("n_variants"),
        F.max(wanted & F.col("located")).alias("matched"),
        first(wanted, picked).alias("head"),
        first(~wanted & F.col("located"), picked).alias("opp"),
        first(wanted & F.col("foreign").isNotNull(), F.struct("name", "raw", F.col("foreign.raw").alias("received"))).alias("wrong"),
        F.collect_list(F.when(wanted, F.struct("block_ord", "name", "raw", "norm"))).alias("expected"),
    )
    undecided = ~F.col("matched") & F.col("opp").isNull() & F.col("wrong").isNull()
    best = best_similar(groups.where(undecided), mails)
    out = groups.join(best, ["version_id", "base"], "left")
    label = F.when(
        F.col("n_variants") > 1, text(F.col("base"), " (any of ", F.col("n_variants"), " variants)")
    ).otherwise(F.col("head.name"))

    def by_state(matched, opp, wrong, near, absent) -> Column:
        return (
            F.when(F.col("matched"), matched).when(F.col("opp").isNotNull(), opp)
            .when(F.col("wrong").isNotNull(), wrong).when(F.col("best").isNotNull(), near)
            .otherwise(absent)
        )

    return out.select(
        "version_id", "base",
        by_state(*[F.lit(s) for s in ("matched", "wrong_audience", "wrong_language", "differs", "not_found")]).alias("state"),
        by_state(label, F.col("opp.name"), F.col("wrong.name"), F.col("best.name"), label).alias("name"),
        by_state(F.col("head.raw"), F.col("head.raw"), F.col("wrong.raw"), F.col("best.raw"), F.col("head.raw")).alias("expected"),
        by_state(F.lit(None), F.col("opp.raw"), F.col("wrong.received"), F.col("best.received"), F.lit("")).alias("received"),
        F.col("best.sim").alias("sim"),
    )


def best_similar(undecided: DataFrame, mails: DataFrame) -> DataFrame:
    """JOIN-6: most similar text of the mail for each undecided group, at or above the mail's threshold.

    Texts meet only blocks of the same mail, and only where the lengths allow the threshold. Rows carry the
    texts alone, as arrays of their character pairs take many times their bytes."""
    blocks = undecided.select("version_id", "base", F.inline("expected"))
    texts = mails.select("version_id", "minimum", F.posexplode("originals").alias("i", "original")).withColumn(
        "t", norm_text(F.col("original"))
    )
    pairs = blocks.join(texts, "version_id").where(can_reach(F.length("norm"), F.length("t"), F.col("minimum")))
    scored = pairs.withColumn("sim", dice_of_pair(F.col("norm"), F.col("t"))).where(F.col("sim") >= F.col("minimum"))
    return scored.groupBy("version_id", "base").agg(
        F.max_by(
            F.struct("name", "raw", F.col("original").alias("received"), "sim"),
            F.struct("sim", -F.col("block_ord"), -F.col("i")),
        ).alias("best")
    )


def outcome_severity(state: Column, confidence: Column) -> Column:
    """A block that is nowhere in the mail is critical when the language is certain."""
    return F.when((state == "not_found") & (confidence == "high"), "CRITIQUE").when(
        state != "matched", "MAJEUR"
    )


def block_findings(outcomes: DataFrame, mails: DataFrame) -> DataFrame:
    """RUL-31 finding rows, from outcomes and mails (version_id, detected_lang, lang_confidence)."""
    state, lang, name = F.col("state"), F.col("detected_lang"), F.col("name")
    pct = F.floor(F.col("sim") * 100 + 0.5).cast("int")
    message = (
        F.when(state == "wrong_audience", text('Wrong audience variant: the mail has "', name, '"'))
        .when(state == "wrong_language", text('Block "', name, '" is in another language than ', lang))
        .when(state == "differs", text('Block "', name, '" (', lang, ") differs from the brief (", pct, "% similar)"))
        .otherwise(text('Block "', name, '" (', lang, ") not found in the mail"))
    )
    rows = outcomes.where(state != "matched").join(mails, "version_id")
    return rows.select(
        "version_id",
        finding(
            "brief-block-content", "brief", outcome_severity(state, F.col("lang_confidence")), message,
            text("Block ", name), "contenu", None, F.col("expected"), F.col("received"),
        ).alias("f"),
    ).select("version_id", "f.*")


def planned_labels(links: DataFrame, cta_labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Labels of JOIN-7: (campaign_id, link_ord, lang_key, label).

    links (campaign_id, link_ord, block), cta_labels (campaign_id, link_ord, lang_key, label), blocks
    (campaign_id, block_ord, block, lang_key, value). A label of the link's own counts; else the value of
    the first block whose name equals the link's, holds it or is held by it. Both sides of a campaign
    are the lines of one brief."""
    of = links.select("campaign_id", "link_ord", norm_text(F.col("block")).alias("wanted"))
    names = blocks.select("campaign_id", "block_ord", norm_text(F.col("block")).alias("name")).distinct()
    alike = (F.col("name") == F.col("wanted")) | F.contains("name", F.col("wanted")) | F.contains("wanted", F.col("name"))
    first = of.join(names, "campaign_id").where(alike).groupBy("campaign_id", "link_ord").agg(F.min("block_ord").alias("block_ord"))
    values = first.join(blocks, ["campaign_id", "block_ord"]).select("campaign_id", "link_ord", "lang_key", "value")
    own = cta_labels.where(nonempty(F.col("label")))
    return own.join(values, ["campaign_id", "link_ord", "lang_key"], "full").select(
        "campaign_id", "link_ord", "lang_key", F.coalesce("label", "value").alias("label")
    ).where(nonempty(F.col("label")))


def expected_link_plans(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Plans of JOIN-7: long links (campaign_id, link_ord, block, market, url) with the label of the
    block by language (campaign_id, link_ord, lang_key, label). Both groups are one brief line."""
    by_market = links.where(nonempty(F.col("url"))).groupBy("campaign_id", "link_ord").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.upper(F.trim("market")).alias("market"), "url", normalize_url(F.col("url")).alias("norm"))
            )
        ).alias("urls")
    )
    named = labels.select(
        "campaign_id", "link_ord", "lang_key", "label", norm_text(F.col("label")).alias("norm_label")
    ).where(F.length("norm_label") >= 2)
    return by_market.join(named, ["campaign_id", "link_ord"])


def expected_link_findings(prepared: DataFrame, plans: DataFrame) -> DataFrame:
    """JOIN-7 / RUL-32: CTAs whose label the brief names must lead where it says.

    Equi-join on campaign, language key and label; the markets of a plan are a short array."""
    cta = F.struct(
        F.col("x.pos").alias("pos"), norm_text(F.col("x.text")).alias("norm_label"),
        normalize_url(F.col("x.href")).alias("n1"), normalize_url(F.col("x.final_url")).alias("n2"),
        F.coalesce("x.final_url", "x.href").alias("received"),
    )
    ctas = prepared.select(
        "version_id", "campaign_id", F.col("grid_key").alias("lang_key"), "effective_market",
        "explicit_market", F.explode_outer("testable").alias("x"),
    ).where("x IS NOT NULL").withColumn("c", cta).select(
        "version_id", "campaign_id", "lang_key", "effective_market", "explicit_market", "c.*"
    ).where(F.col("n1").isNotNull() | F.col("n2").isNotNull())
    rows = skew_join(ctas, plans, ["campaign_id", "lang_key", "norm_label"], "inner")
    market = F.col("effective_market")

    def of(m: Column) -> Column:
        return F.get(F.filter("urls", lambda u: u["market"] == m), 0)

    rows = rows.withColumn("want", F.coalesce(of(market), of(F.lit("WW")), F.get("urls", F.lit(0))))

    def hits(norm: Column) -> Column:
        return F.coalesce(norm == F.col("n1"), F.lit(False)) | F.coalesce(norm == F.col("n2"), F.lit(False))

    wrong = F.get(
        F.filter("urls", lambda u: (u["market"] != market) & (u["norm"] != F.col("want.norm")) & hits(u["norm"])), 0
    )
    rows = rows.where(F.col("want.norm").isNotNull() & ~hits(F.col("want.norm"))).withColumn("wrong", wrong)
    note = F.when(F.col("explicit_market").isNull(), " (inferred market)").otherwise("")
    message = F.when(
        F.col("wrong").isNotNull(),
        text('CTA "', F.col("label"), '" points to the ', F.col("wrong.market"), " link in a ", market, " mail", note),
    ).otherwise(text('CTA "', F.col("label"), '" does not point to the URL planned for ', market))
    return rows.select(
        "version_id", "pos",
        finding(
            "expected-links-market", "liens", "MAJEUR", message, text("Expected (", market, ")"),
            text("lien#", F.col("pos")), None, F.col("want.url"), F.col("received"),
        ).alias("f"),
    ).select("version_id", "pos", "f.*")
