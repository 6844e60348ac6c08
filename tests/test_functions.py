"""Scalar functions on small tables of cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkproof.functions import names, text, urls
from sparkproof.functions.languages import canon_column, canon_lang
from sparkproof.functions.slots import personalization_match


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_classify_link(spark):
    cases = {
        "%%=RedirectTo(@x)=%%": "ampscript", "mailto:a@b.c": "mailto", "#": "anchor", "": "anchor",
        "https://click.brand.example/x": "tracked", "/relative": "ampscript",
        "https://a.b/c d": "statique", "http://x.exct.net/": "tracked", "tel:123": "statique",
    }
    assert values(spark, urls.classify_link, list(cases)) == list(cases.values())


def test_utm_last_wins_and_stray_percent(spark):
    got = values(spark, urls.parse_utm, [
        "https://a.b/?UTM_Source=x&utm_source=y&q=1", "https://a.b/?utm_term=50%&utm_x=a+b", "/r?utm_source=x"])
    assert got == [{"utm_source": "y"}, {"utm_term": "50%", "utm_x": "a b"}, {}]


def test_unwrap_and_normalize(spark):
    wrapped = "https://eu.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.b%2Fc&data=1"
    assert values(spark, urls.unwrap_safe_link, [wrapped, "https://a.b"]) == ["https://a.b/c", "https://a.b"]
    assert values(spark, urls.normalize_url, [
        "https://A.b/c/?utm_source=x&e=1&k=v w#z", "%%=v(@x)=%%", "https://a.b/é", "not a url"]
    ) == ["a.b/c?k=v+w", None, "a.b/%C3%A9", None]


def test_normalisation(spark):
    assert values(spark, text.norm_text, ["  L’Été «Noël» ​ !"]) == ['l\'été "noël" !']
    assert values(spark, text.norm_tokens, ["Été-Noël 7!"]) == ["ete noel 7"]
    assert values(spark, text.norm_message, ['Link "é"  IS: 5!']) == ["link é is 5"]
    assert values(spark, text.strip_control_chars, ["a\x00b\tc\x1f"]) == ["ab\tc"]


@pytest.mark.parametrize("a,b,want", [("night", "nacht", 0.25), ("aaaa", "aaa", 0.8), ("x", "y", 0.0), ("q", "q", 1.0)])
def test_dice(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(
        text.dice_similarity(F.col("a"), F.col("b")).alias("x"), text.dice_similarity(F.col("b"), F.col("a")).alias("y")
    ).first()
    assert row["x"] == pytest.approx(want) and row["x"] == row["y"]


def test_numbered_copies(spark):
    rows = ["", "a", "aaaa", "a😀😀😀b\n\n\nbaba\\$1", "été été"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", text.numbered(text.bigrams(F.col("t"))).alias("x"), text.numbered_bigrams(F.col("t")).alias("y")).collect()
    for r in got:
        pairs = sorted((r["t"][i : i + 2] for i in range(len(r["t"]) - 1)), key=str.encode)
        want = [p + text.COPY_MARK + str(i - pairs.index(p)) for i, p in enumerate(pairs)]
        assert r["x"] == r["y"] and (r["x"] == want or "😀" in r["t"])


def test_dice_of_pairs(spark):
    rows = [("night", "nacht"), ("aaaa", "aaa"), ("x", "y"), ("q", "q"), ("", "ab"), ("night", "nightly"), ("é😀b", "😀b"), (None, "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string").coalesce(1)
    got = df.select("i", text.dice_of_pair(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [0.25, 0.8, 0.0, 1.0, 0.0, 0.8, pytest.approx(2 / 3), None]


def test_dice_of_long_texts_is_no_square(spark):
    """100,000 pairs that differ took the square of their number."""
    rng = random.Random(5)
    a = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(100_000))
    df = spark.createDataFrame([(a, a[:50_000] + a[60_000:])], "a string, b string")
    start = time.monotonic()
    got = df.select(text.dice_similarity(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert got == pytest.approx(2 * 89_998 / (99_999 + 89_999), abs=1e-4) and time.monotonic() - start < 30


def test_personalization(spark):
    df = spark.createDataFrame(
        [("Dear [Name], hello", "x dear anna, hello y", True), ("Mr [Name] / Ms [Name]", "ms li", True), ("Dear [Name]!", "hello", False)],
        "raw string, t string, want boolean",
    )
    got = df.select(F.regexp("t", text.personalization_pattern(F.col("raw"))).alias("r"), "want").collect()
    assert all(r["r"] == r["want"] for r in got)


def test_slots_of_long_and_odd_blocks(spark):
    """A block of 40,000 words overflowed the stack of Java's matcher; short ones match as its pattern does."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rng = random.Random(9)
    parts = ["[Name]", "dear", "anna", " / ", "\n", " ", "B", "%%x%%", "b", "é", "(", "\u00a0", ","]
    rows = [("Dear [Name],\n" + long, "x dear anna, " + long, True), ("Dear [Name],\n" + long, "dear anna, " + long[:-1], False)]
    rows += [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))),
              " ".join(rng.choice(["dear", "anna", "b", "\n", "é", "(", ",", "z" * 70]) for _ in range(rng.randrange(0, 12))), None) for _ in range(400)]
    df = spark.createDataFrame(rows, "raw string, t string, want boolean")
    got = df.select("raw", "t", "want", personalization_match(F.col("t"), F.col("raw")).alias("r"))
    assert [r["r"] for r in got.where("want IS NOT NULL").collect()] == [True, False]
    short = got.where("want IS NULL").select("raw", "t", "r", F.regexp("t", text.personalization_pattern(F.col("raw"))).alias("w")).collect()
    assert [r for r in short if r["r"] != r["w"]] == [] and {r["r"] for r in short} == {True, False, None}


def test_names_and_languages(spark):
    got = values(spark, names.parse_test_name, [
        "[1294653 - My - Camp - MX - F] Hi", "[1294653 - Camp - ALL - FR] x", "[Camp - F] x", "no name", "[12 - Camp - mx - F] x"])
    assert (got[0]["campaign_name"], got[0]["market"], got[0]["audience"], got[0]["well_formed"]) == ("My - Camp", "MX", "F", True)
    assert got[1]["well_formed"] and got[1]["market"] == "FR" and got[1]["audience"] == "ALL"
    assert not got[2]["well_formed"] and got[3] is None
    assert got[4]["market"] is None and got[4]["test_number"] is None
    assert values(spark, canon_lang, ["fr-FR", "US - CA", "Italian (IT)", "xx-yy", ""]) == ["FR", "EN", "IT", "XX", ""]
    assert values(spark, canon_column, ["mx", "zht", "klingon"]) == ["MX", "ZHT", None]


def test_name_is_split_once(spark):
    """The steps of the parse are bound: unbound, a market repeats the splitting of its name."""
    df = spark.createDataFrame([("[1294653 - Camp - MX - F] Hi",)], "v string")
    plan = df.select(names.parse_test_name(F.col("v"))["market"].alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 1


def test_changed_tokens_of_urls(spark):
    df = spark.createDataFrame([("https://a.b/c/d?x=1&y=2#z", "https://a.b/c/e?x=1&y=3#z")], "a string, b string")
    assert df.select(text.changed_tokens(F.col("a"), F.col("b")).alias("r")).first()["r"] == ["&y=2", "/d"]


def test_private_hosts(spark):
    cases = {"http://10.0.0.1/": True, "http://172.32.0.1": False, "http://[::ffff:10.0.0.1]/": True,
             "http://u:p@localhost:80/x": True, "https://shop.example.com": False, "http://a.internal": True}
    assert values(spark, urls.private_host, list(cases)) == list(cases.values())
