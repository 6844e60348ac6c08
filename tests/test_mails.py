"""Extraction, headers and folding on small fixtures."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sparkproof.functions.mail_parser import facts_of, read_facts
from sparkproof.operators import auth, contain, dedup, extract, grid
from sparkproof.sources.documents import tsv_cells

HTML = """<html lang="fr"><head><title>Sujet</title></head><body>
<div style="DISPLAY : none">Un texte caché</div>
<table><tr><td>Court<br>deux<p>Bloc</p></td><td>Seul&nbsp;texte</td></tr></table>
<p>Un <b>gras<p>Deux</p>
<a href="https://a.b/?utm_source=x">Voir <span>tout</span></a><a href="https://a.b/?utm_source=x">Voir tout</a>
<p>Pour se désinscrire <a href="https://a.b/u">cliquez ici</a></p>
<img src="https://a.b/o.gif" style="width:1px"><img src="cid:logo" alt="">
<!--[if gte mso 9]><a href="#">Bouton</a><![endif]--></body></html>"""


def test_reader_nesting():
    f = read_facts(HTML, lambda t: "désinscri" in t)
    assert f["title"] == "Sujet" and f["html_lang"] == "fr" and f["preheader"] == "Un texte caché"
    assert [(x["href"], x["text"], x["in_mso"]) for x in f["links"]] == [
        ("https://a.b/?utm_source=x", "Voir tout", False), ("https://a.b/u", "cliquez ici", False), ("#", "Bouton", True)]
    assert f["texts"] == ["Bloc", "Seul texte", "Un gras", "Deux", "Pour se désinscrire cliquez ici"]
    assert f["unsub_context"] is True
    assert read_facts(None, lambda t: False)["links"] == []


def test_batch_is_read_in_slices():
    """The HTML of a whole batch was held as Python objects beside its Arrow form."""
    one = HTML + "<!--" + "x" * 100_000 + "-->"
    mails = pa.array([one] * 500)
    tracemalloc.start()
    got = facts_of(mails, lambda t: False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 and len(got) == 500 and got[499]["title"].as_py() == "Sujet"
    assert facts_of(mails[:0], lambda t: False).to_pylist() == []


def test_bare_references():
    html = ('<title>A &amp; B &amp</title><p>x &copy; y &copy 1 &#39;z&#39 &nosuch;</p><a href="/u?a=1&amp;b&copy">t &lt;&lt</a>'
            "<!--[if mso]><a href='#'>m &amp</a><![endif]-->")
    f, h = read_facts(html, lambda t: False, bare=False), read_facts(html, lambda t: False)
    assert f["title"] == "A & B &amp" and f["texts"] == ["x © y &copy 1 'z&#39 &nosuch;"]
    assert [(x["href"], x["text"]) for x in f["links"]] == [("/u?a=1&b&copy", "t <&lt"), ("#", "m &amp")]
    assert h["title"] == "A & B &" and h["texts"] == ["x © y © 1 'z' &nosuch;"] and h["links"][0]["text"] == "t <<"


def test_query_reads_whole_references(spark, tmp_path):
    from sparkproof.plans import load_all

    html = '<html lang="en"><title>Cut off &amp</title><body></body></html>'
    spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert load_all().QUERIES["ext10_subject_fallback"](spark, str(tmp_path)).first()["subject"] == "Cut off &amp"


def test_facts_row(spark):
    row = extract.with_facts(spark.createDataFrame([(1, HTML, None)], "version_id int, html string, name string")).first()
    f = row["facts"]
    assert f["has_unsubscribe"] and f["mso_count"] == 1 and f["size_bytes"] == len(HTML.encode())
    assert [(i["kind"], i["is_pixel"], i["alt"]) for i in f["images"]] == [("remote", True, None), ("cid", False, "")]
    assert f["links"][0]["utm"] == {"utm_source": "x"} and f["links"][2]["kind"] == "anchor"


def test_auth_header_forged_and_nested(spark):
    raw = ("From: A <a@b.c>\r\nAuthentication-Results: mx.google.com;\r\n  dkim=pass header.i=@x.b.c header.s=s1 (a (b) c);\r\n"
           " dkim=fail header.d=other.example;\r\n spf=softfail smtp.mailfrom=q@M.b.c; dmarc=pass (p=NONE) header.from=b.c\r\n\r\n"
           "Authentication-Results: forged; dmarc=fail\r\n")
    rows = auth.with_message_facts(spark.createDataFrame([(1, "gmail", raw), (2, "upload", "body only")], "version_id int, source string, raw string"))
    a, b = [r["auth"] for r in rows.orderBy("version_id").collect()]
    assert a["trusted"] and a["authserv"] == "mx.google.com" and a["dmarc"] == "pass" and a["policy"] == "NONE"
    assert [(d["result"], d["domain"], d["aligned"]) for d in a["dkim"]] == [("pass", "x.b.c", True), ("fail", "other.example", False)]
    assert a["mailfrom"] == "m.b.c" and not b["present"]


def fold(rows):
    """The ordered fold as the reference describes it."""
    order = {"CRITIQUE": 3, "MAJEUR": 2, "MINEUR": 1, "OK": 0}
    out = {}
    for r in rows:
        key = (r["report_id"], r["category"])
        old = out.get(key)
        if old is None:
            out[key] = dict(r)
            continue
        keep, lose = (r, old) if order[r["severity"]] > order[old["severity"]] else (old, r)
        agent = old["agent"] if old["agent"] == r["agent"] else old["agent"] + " + " + r["agent"]
        out[key] = {**keep, "agent": agent, **{c: keep[c] if keep[c] is not None else lose[c] for c in ("title", "expected", "received")}}
    return {k: tuple(v[c] for c in ("severity", "title", "expected", "received", "agent", "evidence")) for k, v in out.items()}


def test_dedup_equals_fold_and_is_idempotent(spark):
    rng = random.Random(7)
    rows = [
        {"report_id": rng.randrange(40), "seq": i, "category": rng.choice("ab"), "locator": "l", "message": "M!",
         "severity": rng.choice(["CRITIQUE", "MAJEUR", "MINEUR", "OK"]), "title": rng.choice([None, "t%d" % i]),
         "expected": rng.choice([None, "e%d" % i]), "received": rng.choice([None, None, "r%d" % i]),
         "agent": rng.choice(["x", "y"]), "evidence": "ev%d" % i}
        for i in range(400)
    ]
    ddl = "report_id int, seq int, category string, locator string, message string, severity string, title string, expected string, received string, agent string, evidence string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)
    got = dedup.dedup_findings(df, ["report_id"])
    table = {(r["report_id"], r["category"]): tuple(r[c] for c in ("severity", "title", "expected", "received", "agent", "evidence")) for r in got.collect()}
    assert table == fold(rows)
    again = dedup.dedup_findings(got.withColumnRenamed("first_seq", "seq"), ["report_id"])
    assert {tuple(r) for r in again.select(*got.columns).collect()} == {tuple(r) for r in got.collect()}


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "be", "gamma", "a", "delta", "eta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    blocks = []
    for i in range(80):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        blocks.append(t[a : a + rng.randrange(1, 60)].strip())
    bdf = spark.createDataFrame(list(enumerate(blocks)), "block_id int, block string")
    tdf = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {(r["block_id"], r["text_id"]) for r in contain.blocks_in_texts(bdf, tdf).collect()}
    want = {(i, j) for i, b in enumerate(blocks) for j, t in enumerate(texts) if len(b) >= 3 and b in t}
    assert got == want


def test_tsv(spark):
    texts = ['a\t"x\ty\n""q"""\tb"c\r\n\r\nlast\t', "one", "a\n", "\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "paste_id int, text string")
    cells = {}
    for r in tsv_cells(df).collect():
        cells.setdefault(r["paste_id"], {})[(r["row"], r["col"])] = r["text"]
    assert cells[0] == {(0, 0): "a", (0, 1): 'x\ty\n"q"', (0, 2): 'b"c', (1, 0): "", (2, 0): "last", (2, 1): ""}
    assert cells[1] == {(0, 0): "one"} and cells[2] == {(0, 0): "a"} and cells[3] == {(0, 0): "", (0, 1): ""}


def test_placeholders(spark):
    df = spark.createDataFrame([(" Shop   NOW ", "https://brand.cn/x"), ("Shop now!", "https://brand.com.evil/")], "t string, u string")
    rows = df.select(grid.is_placeholder_text(F.col("t")).alias("t"), grid.is_placeholder_url(F.col("u")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False)]
