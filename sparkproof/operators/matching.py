"""Inbox mails to campaigns, by tracking value and words in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.text import norm_tokens, token_set
from sparkproof.operators.skew import skew_join

# Words that say nothing about the campaign.
STOPWORDS = ["test", "proof", "draft", "final", "preview", "email", "mail", "newsletter", "campagne",
             "campaign", "adhoc", "global", "oto", "ww", "worldwide", "the", "les", "des", "pour",
             "avec", "and", "new"]
AUTO_THRESHOLD = 0.6
MIN_SCORE = 0.25


def _overlaps(left: DataFrame, right: DataFrame, out: str) -> DataFrame:
    """Token overlap of every pair that shares a token.

    Texts are first reduced to distinct token lists (many mails repeat a subject, many campaigns a
    name), the tokens of these few lists are joined, and the pairs are spread to ids afterwards."""
    l_sets = left.select("tokens").distinct().withColumn("l_key", F.array_join("tokens", " "))
    r_sets = right.select("tokens").distinct().withColumn("r_key", F.array_join("tokens", " "))
    l_tok = l_sets.select("l_key", F.size("tokens").alias("ln"), F.explode("tokens").alias("t"))
    r_tok = r_sets.select("r_key", F.size("tokens").alias("rn"), F.explode("tokens").alias("t"))
    shared = skew_join(l_tok, r_tok, ["t"]).groupBy("l_key", "r_key").agg(
        (F.count(F.lit(1)) / F.least(F.first("ln"), F.first("rn"))).alias(out)
    )
    return shared


def match_by_score(mails: DataFrame, mail_utms: DataFrame, campaigns: DataFrame) -> DataFrame:
    """JOIN-9: best campaign of a mail by tracking value, subject and name; ties go to the lowest id.

    mails (mail_id, subject), mail_utms (mail_id, utm), campaigns (campaign_id, name, utm, subject,
    status). A pair without any word in common cannot reach the minimum, so only pairs that share
    one are built, and those between distinct texts instead of between rows."""
    open_ = campaigns.where("status <> 'ENVOYE'").select(
        "campaign_id", token_set(F.col("name"), 3).alias("name_tokens"),
        token_set(F.coalesce("subject", F.lit("")), 3).alias("subject_tokens"),
        norm_tokens(F.coalesce("utm", F.lit(""))).alias("want"),
        F.col("status").isin("EMAIL_ATTENDU", "CORRECTIONS").alias("awaited"),
    )
    # Campaigns that score alike for every mail: the lowest id stands for them.
    profile = ["name_tokens", "subject_tokens", "want", "awaited"]
    kinds = open_.groupBy(*profile).agg(F.min("campaign_id").alias("campaign_id"))
    kinds = kinds.withColumn("name_key", F.array_join("name_tokens", " ")).withColumn(
        "subject_key", F.array_join("subject_tokens", " ")
    )
    by_utm = mail_utms.select("mail_id", norm_tokens(F.col("utm")).alias("u")).where("u <> ''").groupBy(
        "mail_id"
    ).agg(F.array_sort(F.collect_set("u")).alias("utms"))
    texts = mails.select("mail_id", token_set(F.col("subject"), 3).alias("tokens")).join(
        by_utm, "mail_id", "left"
    ).withColumn("utms", F.coalesce("utms", F.array().cast("array<string>")))
    # Mails with the same words and values have the same best campaign.
    mail_kinds = texts.select("tokens", "utms").distinct().withColumn(
        "m_key", F.to_json(F.struct("tokens", "utms"))
    ).withColumn("s_key", F.array_join("tokens", " "))
    m_sub = mail_kinds.select("tokens")
    names = kinds.select(F.col("name_tokens").alias("tokens"))
    subjects = kinds.select(F.col("subject_tokens").alias("tokens"))
    on_name = _overlaps(m_sub, names, "on_name")
    on_subject = _overlaps(m_sub, subjects, "on_subject")
    utm_rows = mail_kinds.select("m_key", F.explode("utms").alias("u"))
    utm_tokens = utm_rows.select("u").distinct().withColumn("tokens", token_set(F.col("u"), 3))
    utm_name = _overlaps(utm_tokens, names, "overlap").where("overlap > 0.5")
    u_keys = utm_tokens.withColumn("l_key", F.array_join("tokens", " ")).select("u", "l_key")
    exact = utm_rows.join(kinds.where("want <> ''").select("campaign_id", F.col("want").alias("u")), "u").select(
        "m_key", "campaign_id", "u", F.lit(0.6).alias("part")
    )
    near = utm_rows.join(u_keys, "u").join(utm_name, "l_key").join(
        kinds.select("campaign_id", F.col("name_key").alias("r_key"), F.col("want")), "r_key"
    ).where("u <> want").select("m_key", "campaign_id", "u", F.lit(0.4).alias("part"))
    key_of = mail_kinds.select("m_key", F.col("s_key").alias("l_key"))
    by_subject = key_of.join(on_subject, "l_key").join(
        kinds.select("campaign_id", F.col("subject_key").alias("r_key")), "r_key"
    ).select("m_key", "campaign_id", (F.col("on_subject") * 0.4).alias("part"))
    by_name = key_of.join(on_name, "l_key").join(
        kinds.select("campaign_id", F.col("name_key").alias("r_key")), "r_key"
    ).select("m_key", "campaign_id", (F.col("on_name") * 0.3).alias("part"))
    parts = exact.drop("u").unionByName(near.drop("u")).unionByName(by_subject).unionByName(by_name)
    scored = parts.groupBy("m_key", "campaign_id").agg(F.sum("part").alias("score")).join(
        kinds.select("campaign_id", "awaited"), "campaign_id"
    ).withColumn("score", F.round(F.col("score") + F.when(F.col("awaited"), 0.1).otherwise(0.0), 6))
    best = scored.groupBy("m_key").agg(
        F.max_by(F.struct("campaign_id", "score"), F.struct("score", -F.col("campaign_id"))).alias("b")
    ).where(F.col("b.score") >= MIN_SCORE)
    return texts.withColumn("m_key", F.to_json(F.struct("tokens", "utms"))).join(best, "m_key").select(
        "mail_id", "b.campaign_id", F.least("b.score", F.lit(1.0)).alias("score"),
        (F.col("b.score") >= AUTO_THRESHOLD).alias("confirmed"),
    )


def significant_tokens(c):
    return F.array_except(token_set(c, 3), F.array(*[F.lit(w) for w in STOPWORDS]))


#: A word that more campaigns have than this is matched by classes of campaigns instead of pairs.
HOT_WORD = 1000


def weight(t) -> Column:
    return F.when(F.length(t) >= 5, 2).otherwise(1)


def token_candidates(m_tok: DataFrame, c_tok: DataFrame, hot: int) -> DataFrame:
    """Rows (m_key, campaign_id, score, ratio) among which is the best campaign of each word list.

    m_tok (m_key, t), c_tok (campaign_id, n, t), each word of a list once. Pairs are built for words that few
    campaigns have. Of campaigns that share only frequent words with a mail, all with the same frequent
    words score alike but for their length and id: the shortest with the lowest id stands for its class, and
    classes meet classes. So a word in every name costs its classes and not its pairs."""
    frequent = c_tok.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("t", F.lit(True).alias("hot"))
    c_all, m_all = skew_join(c_tok, frequent, ["t"], "left"), skew_join(m_tok, frequent, ["t"], "left")
    hots = F.array_sort(F.collect_list("t")).alias("hots")
    c_hot = c_all.where("hot").groupBy("campaign_id").agg(hots, F.first("n").alias("n"))
    m_hot = m_all.where("hot").groupBy("m_key").agg(hots)
    rare = skew_join(m_all.where("hot IS NULL").drop("hot"), c_all.where("hot IS NULL").drop("hot"), ["t"]).groupBy("m_key", "campaign_id").agg(
        F.sum(weight("t")).alias("points"), F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")
    )
    none = F.array().cast("array<string>")

    def scored(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        both = F.array_intersect(F.coalesce(mine, none), F.coalesce(theirs, none))
        points = F.aggregate(both, F.lit(0).cast("long"), lambda a, t: a + weight(t))
        return df.withColumn("score", F.col("points") + points).withColumn("ratio", (F.col("shared") + F.size(both)) / F.col("n"))

    mine, theirs = m_hot.withColumnRenamed("hots", "mine"), c_hot.select("campaign_id", F.col("hots").alias("theirs"))
    near = scored(rare.join(mine, "m_key", "left").join(theirs, "campaign_id", "left"), "mine", "theirs")
    classes = c_hot.groupBy(F.col("hots").alias("theirs")).agg(F.min(F.struct("n", "campaign_id")).alias("c")).select("theirs", "c.*")
    kinds = mine.select("mine").distinct()
    met = kinds.select("mine", F.explode("mine").alias("t")).join(classes.select("theirs", F.explode("theirs").alias("t")), "t").select("mine", "theirs").distinct()
    nothing = {"points": F.lit(0).cast("long"), "shared": F.lit(0).cast("long")}
    by_class = scored(met.join(classes, "theirs").withColumns(nothing), "mine", "theirs").groupBy("mine").agg(
        F.max_by(F.struct("campaign_id", "score", "ratio"), F.struct("score", "ratio", -F.col("campaign_id"))).alias("b")
    )
    columns = ["m_key", "campaign_id", "score", "ratio"]
    return near.select(columns).unionByName(mine.join(by_class, "mine").select("m_key", "b.*").select(columns))


def match_by_tokens(mails: DataFrame, campaigns: DataFrame, hot: int = HOT_WORD) -> DataFrame:
    """JOIN-10: best campaign by significant words (long ones count twice), with a confidence.

    mails (mail_id, subject, sender), campaigns (campaign_id, name, brand)."""
    texts = mails.select(
        "mail_id",
        F.array_sort(
            F.array_union(
                significant_tokens(F.coalesce("subject", F.lit(""))),
                significant_tokens(F.coalesce("sender", F.lit(""))),
            )
        ).alias("tokens"),
    ).withColumn("m_key", F.array_join("tokens", " "))
    words = campaigns.select(
        "campaign_id",
        F.array_sort(
            F.array_union(
                significant_tokens(F.col("name")), significant_tokens(F.coalesce("brand", F.lit("")))
            )
        ).alias("tokens"),
    ).where(F.size("tokens") > 0)
    # Campaigns with the same words score alike: the lowest id stands for them.
    kinds = words.groupBy("tokens").agg(F.min("campaign_id").alias("campaign_id"))
    c_tok = kinds.select("campaign_id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    m_tok = texts.select("m_key", "tokens").distinct().select("m_key", F.explode("tokens").alias("t"))
    best = token_candidates(m_tok, c_tok, hot).groupBy("m_key").agg(
        F.max_by(F.struct("campaign_id", "score", "ratio"), F.struct("score", "ratio", -F.col("campaign_id"))).alias("b")
    ).where("b.score >= 2")
    confidence = (
        F.when((F.col("b.score") >= 4) | (F.col("b.ratio") >= 0.75), "high")
        .when((F.col("b.score") >= 3) | (F.col("b.ratio") >= 0.5), "medium").otherwise("low")
    )
    return texts.join(best, "m_key").select(
        "mail_id", "b.campaign_id", "b.score", confidence.alias("confidence")
    )


def not_attached(arrivals: DataFrame, inbox: DataFrame) -> DataFrame:
    """JOIN-11: arrivals whose message id is neither known nor earlier in the same batch."""
    first = arrivals.groupBy("message_id").agg(F.min("mail_id").alias("mail_id"))
    return first.join(inbox.select("message_id").distinct(), "message_id", "left_anti")


ANY = object()


def search_inbox(mails: DataFrame, words: str = "", favourites: bool = False, campaign: object = ANY) -> DataFrame:
    """ORD-3, in the order of ORD-1: mails (mail_id, subject, sender, favourite, campaign_id, received_at)
    that hold the words in subject or sender. A campaign of None asks for mails without one."""
    found = mails
    if words.strip():
        q = F.lit(words.strip().lower())
        found = found.where(F.contains(F.lower("subject"), q) | F.contains(F.lower("sender"), q))
    if favourites:
        found = found.where("favourite")
    if campaign is None:
        found = found.where("campaign_id IS NULL")
    elif campaign is not ANY:
        found = found.where(F.col("campaign_id") == campaign)
    return found.orderBy(F.desc("received_at"), F.desc("mail_id"))
