"""Matching by words against comparing every pair, with words that all names have."""

import random

import pytest

from sparkproof.operators import matching

WORDS = ["silk", "scarf", "wool", "coat", "spring", "winter", "leather", "bag", "shoe", "linen"]


def brute(mails, campaigns):
    def weigh(ts):
        return sum(2 if len(t) >= 5 else 1 for t in ts)

    out = {}
    for i, m in mails:
        best = None
        for j, c in campaigns:
            both = m & c
            if both:
                rank = (weigh(both), len(both) / len(c), -j)
                best = max(best, rank) if best else rank
        if best and best[0] >= 2:
            out[i] = (-best[2], best[0])
    return out


@pytest.mark.parametrize("hot", [1000, 10, 0])
def test_best_campaign(spark, hot):
    rng = random.Random(hot)
    pick = lambda n: rng.sample(WORDS, rng.randrange(0, n))
    campaigns = [(i, ["maison", *(["gala"] if i % 2 else []), *pick(4), *([f"only{i}x"] if i % 3 == 0 else [])]) for i in range(150)]
    mails = [(i, [*(["maison"] if i % 4 else []), *(["gala"] if i % 5 == 0 else []), *pick(4), *([f"only{i}x"] if i % 7 == 0 else [])]) for i in range(120)]
    m = spark.createDataFrame([(i, " ".join(w), None) for i, w in mails], "mail_id long, subject string, sender string")
    c = spark.createDataFrame([(i, " ".join(w), None) for i, w in campaigns], "campaign_id long, name string, brand string")
    got = {r.mail_id: (r.campaign_id, r.score) for r in matching.match_by_tokens(m, c, hot).collect()}
    assert got == brute([(i, set(w)) for i, w in mails], [(i, set(w)) for i, w in campaigns])


def test_a_word_in_every_name_builds_few_pairs(spark):
    m = spark.range(2000).selectExpr("concat('m', id) AS m_key", "array('maison', concat('own', id)) AS ts").selectExpr("m_key", "explode(ts) AS t")
    c = spark.range(3000).selectExpr("id AS campaign_id", "2 AS n", "array('maison', concat('name', id)) AS ts").selectExpr("campaign_id", "n", "explode(ts) AS t")
    assert matching.token_candidates(m, c, 1000).count() == 2000
    assert matching.token_candidates(m, c.where("campaign_id < 50"), 1000).count() == 2000 * 50
