"""One query for each operator, with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession

from sparkproof.llm import (
    context_trees,
    decontamination,
    divergence,
    fingerprints,
    languages,
    licenses,
    merge_replay,
    ngram_join,
    packing,
    sharding,
    token_counts,
    warc,
    whitening,
)
from sparkproof.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def license_sql() -> str:
    """The scan by comparing every block with every template."""
    notices = [(label, text.split()) for label, texts in licenses.TEMPLATES.items() for text in texts]
    m = max(len(words) for _, words in notices)
    rows = []
    for label, words in notices:
        held = sorted(set(words))
        rows.append(f"('{label}', {ceil(licenses.THRESHOLD * len(held) - 1e-9)}, {held})")
    places = [
        f"SELECT row, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(phrase.split())}] = {phrase.split()})) AS i FROM d"
        for phrase, label in licenses.BASE.items()
    ]
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
      t(label, need, tokens) AS (VALUES {", ".join(rows)}),
      b AS (SELECT row, list_distinct(w[i + 1 : i + {2 * m}]) AS block FROM (SELECT row, w, unnest(range(0, len(w), {m})) AS i FROM d)),
      met AS (SELECT row, label, need, len(list_intersect(block, tokens)) AS n, len(tokens) AS size FROM b, t),
      added AS (SELECT row, label, max(n / size) AS share FROM met WHERE n >= need GROUP BY 1, 2),
      places AS ({" UNION ALL ".join(places)}),
      base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
      labels AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT row, label FROM places UNION ALL SELECT row, label FROM added) GROUP BY 1),
      best AS (SELECT row, max(share) AS share FROM added GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
      FROM d LEFT JOIN base USING (row) LEFT JOIN labels USING (row) LEFT JOIN best USING (row)"""


@query("op1_license_scan", license_sql())
def scanned_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


@query("op2_packing")
def packed_documents(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query(
    "op3_decontamination",
    r"""WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
      d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM documents, word),
      b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM benchmark, word),
      bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
      ns AS (SELECT DISTINCT n FROM bw),
      dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
      hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
      words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
      items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
      SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def contaminated_documents(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.contaminated(documents(spark, sf_dir), benchmark)


@query("op5_token_counts")
def counted_tokens(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


@query("op7_sharding")
def sharded_documents(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


@query(
    "op8_warc",
    """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
      d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
        max(page_id) OVER (PARTITION BY payload) AS last FROM p)
      SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM d""",
)
def archived_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return warc.record_digests(warc.write_archive(pages))


@query(
    "op9_ngram_jaccard_join",
    r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
      e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
      reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON reach.r = e.x),
      c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
      SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def joined_documents(spark, sf_dir):
    return ngram_join.join_documents(documents(spark, sf_dir))


@query("op10_context_tree_scores")
def scored_documents(spark, sf_dir):
    return context_trees.score_documents(documents(spark, sf_dir))


@query("op4_fingerprints")
def fingerprinted_documents(spark, sf_dir):
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query("op6_language_id")
def identified_languages(spark, sf_dir):
    return languages.identify(documents(spark, sf_dir))


@query("op11_byte_bpe")
def encoded_and_decoded(spark, sf_dir):
    return merge_replay.round_trip(documents(spark, sf_dir))


@query(
    "op13_source_audit",
    r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
      t AS (SELECT lang, source, row, term, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM d) GROUP BY ALL),
      k AS (SELECT lang, term, sum(n) AS ln FROM t GROUP BY 1, 2 HAVING count(*) >= 10),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
        LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY 1, 2, 3) x USING (lang, source, term)),
      v AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY 1),
      s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
      p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (s.total + 2 * v.v) AS HUGEINT) AS p,
        CAST(1 + (1000000000 * (ln + 2)) // (v.total + 2 * v.v) AS HUGEINT) AS q FROM c JOIN s USING (lang, source) JOIN v USING (lang)),
      pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) f
          ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
      terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
      r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
        UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
          row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms) WHERE rank <= 10)
      SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r""",
)
def audited_sources(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


@query("op12_whitening")
def whitened_embeddings(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
