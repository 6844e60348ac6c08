"""Brief against campaign template: conformance, coherence of a template, ownership, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkproof.functions.languages import canon_column
from sparkproof.functions.names import content_hash
from sparkproof.operators.findings import array_rows, nonempty

DEFAULT_TEMPLATE = "default"


def norm_label(c: Column) -> Column:
    """SCL-26: a label without its final parenthesis, blanks folded, lower case."""
    bare = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
    return F.lower(F.regexp_replace(bare, r"\s+", " "))


def lookup_keys(label: Column, aliases: Column, kind: Column) -> Column:
    """SCL-26: keys under which a field is recognised; URL fields lose the word URL."""
    labels = F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>")))
    url = F.transform(
        labels, lambda x: norm_label(F.trim(F.regexp_replace(x, r"(?i)\s+URL(?![A-Za-z0-9_])", " ")))
    )
    return F.when(kind == "url", url).otherwise(F.transform(labels, norm_label))


def seen_rows(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Brief rows by normalised label: shown label, sources, filled languages.

    blocks (brief_id, ord, block, lang, value), links (brief_id, ord, block). A link counts as a row only
    where no block has its label. One aggregate with map-side combine."""
    rows = blocks.select(
        "brief_id", norm_label(F.col("block")).alias("cell"), F.struct("ord", "block").alias("source"),
        F.when(nonempty(F.trim("value")), F.col("lang")).alias("lang"), F.lit(True).alias("copy"),
    ).unionByName(links.select(
        "brief_id", norm_label(F.col("block")).alias("cell"), F.struct("ord", F.concat("block", F.lit(" URL")).alias("block")).alias("source"),
        F.lit(None).cast("string").alias("lang"), F.lit(False).alias("copy"),
    ))
    copy = F.col("copy")
    found = rows.groupBy("brief_id", "cell").agg(
        F.collect_set(F.when(copy, F.col("source"))).alias("own"), F.min_by("source", F.when(copy, F.col("source.ord"))).alias("first"),
        F.min(F.when(~copy, F.col("source"))).alias("link"), F.collect_set("lang").alias("langs"),
    )
    row = F.coalesce("first", "link")
    return found.select(
        "brief_id", "cell", row["block"].alias("label"), F.when(F.size("own") > 0, F.array_sort("own")).otherwise(F.array("link")).alias("sources"),
        "langs", row["ord"].alias("ord"),
    )


def template_row(fields: DataFrame, codes: DataFrame) -> Column:
    """A template as one value of a plan: its fields with their lookup keys, and its language columns.

    fields (field_ord, key, label, kind, required, translatable, aliases) and codes (code) are a sheet's
    worth of rows. As a subquery it needs no join."""
    keys = lookup_keys(F.col("label"), F.col("aliases"), F.col("kind")).alias("keys")
    known = fields.where("kind <> 'meta'").select("field_ord", "key", "label", "required", "translatable", keys)
    named = codes.select("code", canon_column(F.col("code")).alias("canon"))
    entry = known.select(F.struct("field_ord", "key", "label", "required", "translatable", "keys").alias("f"), F.lit(None).cast("struct<code:string,canon:string>").alias("c"))
    column = named.select(F.lit(None).cast(entry.schema["f"].dataType).alias("f"), F.struct("code", "canon").alias("c"))
    both = entry.unionByName(column).agg(F.array_sort(F.collect_list("f")).alias("fields"), F.array_sort(F.collect_list("c")).alias("codes"))
    return both.select(F.struct("fields", "codes").alias("t")).scalar()


def problem(rule: str, item: Column, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))


def joined(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), ", ")


def judged(briefs: DataFrame, seen: DataFrame, fields: DataFrame, codes: DataFrame) -> DataFrame:
    """JOIN-8 and RUL-26..30: each brief with its state and all its problems, computed on its own row.

    briefs (brief_id, family, langs); seen are `seen_rows`. A brief is a sheet, so its rows fit in an array.
    The four reasons for 'not applicable' stay apart from 'conformant' and 'deviation'; briefs to which
    the template does not apply have no problems."""
    folded = seen.groupBy("brief_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "cell", "label", F.size("sources").alias("n"), "langs"))).alias("rows")
    )
    none = F.array().cast("array<struct<ord:int,cell:string,label:string,n:int,langs:array<string>>>")
    df = briefs.join(folded, "brief_id", "left").withColumn("rows", F.coalesce("rows", none)).withColumn("t", template_row(fields, codes))
    cells = F.transform("rows", lambda r: r["cell"])
    row_of = lambda cell: F.get(F.filter("rows", lambda r: r["cell"] == cell), 0)
    hits = F.transform(
        F.col("t")["fields"],
        lambda f: F.struct(
            f["key"].alias("key"), f["label"].alias("label"), f["required"].alias("required"), f["translatable"].alias("translatable"),
            F.get(F.filter(f["keys"], lambda k: F.array_contains("cells", k)), 0).alias("cell"),
        ),
    )
    df = df.withColumn("cells", cells).withColumn("hits", hits)
    met = F.filter("hits", lambda h: h["cell"].isNotNull())
    # Columns whose language the brief activates; a language with several columns can't be judged.
    active = F.filter(F.col("t")["codes"], lambda c: c["canon"].isNotNull() & F.array_contains("langs", c["canon"]))
    df = df.withColumn("met", met).withColumn("active", active)
    alone = lambda c: F.size(F.filter("active", lambda o: o["canon"] == c["canon"])) == 1
    df = df.withColumn("clear", F.filter("active", alone)).withColumn("double", F.transform(F.filter("active", lambda c: ~alone(c)), lambda c: c["code"]))
    missing = F.transform(
        F.filter("hits", lambda h: h["cell"].isNull() & h["required"]), lambda h: problem("template-structure", h["label"], F.lit("missing"))
    )
    hit_cells = F.array_distinct(F.transform("met", lambda h: h["cell"]))
    extra = F.transform(
        F.filter("rows", lambda r: ~F.array_contains(hit_cells, r["cell"])), lambda r: problem("template-structure", r["label"], F.lit("extra"))
    )
    lacks = lambda h: F.transform(
        F.filter("clear", lambda c: ~F.array_contains(row_of(h["cell"])["langs"], c["canon"])), lambda c: c["code"]
    )
    untranslated = F.filter(
        F.transform(F.filter("met", lambda h: h["translatable"]), lambda h: problem("template-language-coverage", h["label"], joined(lacks(h)))),
        lambda p: p["detail"] != "",
    )
    keys_of = lambda cell: F.transform(F.filter("met", lambda h: h["cell"] == cell), lambda h: h["key"])
    shared = F.transform(
        F.filter(hit_cells, lambda c: (F.size(keys_of(c)) > 1) | (row_of(c)["n"] > 1)),
        lambda c: problem(
            "template-field-shared-cell", row_of(c)["label"],
            F.when(row_of(c)["n"] > 1, F.concat(row_of(c)["n"], F.lit(" rows"))).otherwise(F.array_join(F.array_sort(keys_of(c)), ",")),
        ),
    )
    strange = joined(F.transform(F.filter(F.col("t")["codes"], lambda c: c["canon"].isNull()), lambda c: c["code"]))
    nothing = F.lit(None).cast("string")
    remarks = F.array_compact(F.array(
        F.when(F.size("double") > 0, problem("template-language-ambiguous", joined(F.col("double")), nothing)),
        F.when(strange != "", problem("template-language-unsupported", strange, nothing)),
    ))
    df = df.withColumn("deviations", F.concat(missing, extra, untranslated)).withColumns({"shared": shared, "remarks": remarks})
    f, applies = F.col("family"), (F.col("family") == "field_value") & (F.size("met") > 0)
    state = (
        F.when(f.isNull(), "family_unknown").when(f == "none", "layout_unreadable").when(f != "field_value", "other_family")
        .when(F.size("met") == 0, "no_field_matched").when(F.size("deviations") > 0, "deviation").otherwise("conformant")
    )
    # Language remarks belong to a deviation only; a conformant brief is not judged on them.
    empty = F.array().cast("array<struct<rule_id:string,item:string,detail:string>>")
    problems = F.concat("deviations", F.when(F.size("deviations") > 0, F.col("remarks")).otherwise(empty), "shared")
    return df.select("brief_id", state.alias("state"), F.when(applies, problems).otherwise(empty).alias("problems"))


def conformance(briefs: DataFrame, seen: DataFrame, fields: DataFrame, codes: DataFrame) -> DataFrame:
    """JOIN-8 and RUL-26..30 as problem rows (brief_id, rule_id, item, detail)."""
    return array_rows(judged(briefs, seen, fields, codes), "problems", "rule_id", "brief_id").select("brief_id", "rule_id", "item", "detail")


def conformance_state(briefs: DataFrame, seen: DataFrame, fields: DataFrame, codes: DataFrame) -> DataFrame:
    """RUL-26: (brief_id, state)."""
    return judged(briefs, seen, fields, codes).select("brief_id", "state")


def coherence(fields: DataFrame, codes: DataFrame, named: DataFrame) -> DataFrame:
    """AGG-15: problem rows (template_id, severity, problem, item) of template definitions.

    fields (template_id, key, label, row_offset, kind, translatable, aliases), codes (template_id,
    code), named languages (template_id, code)."""

    def rows(df: DataFrame, severity: str, problem: str, item: Column) -> DataFrame:
        return df.select("template_id", F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), item.cast("string").alias("item"))

    n = F.count(F.lit(1)).alias("n")
    dup_key = fields.groupBy("template_id", "key").agg(n).where("n > 1")
    dup_row = fields.groupBy("template_id", "row_offset").agg(n).where("n > 1")
    lookups = fields.select(
        "template_id", F.explode(lookup_keys(F.col("label"), F.col("aliases"), F.col("kind"))).alias("cell")
    ).groupBy("template_id", "cell").agg(n).where("n > 1")
    no_text = fields.groupBy("template_id").agg(F.bool_or("translatable").alias("any")).where("NOT any")
    dup_col = codes.groupBy("template_id", "code").agg(n).where("n > 1")
    distinct = codes.distinct()
    orphan = named.join(distinct, ["template_id", "code"], "left_anti")
    unnamed = distinct.join(named, ["template_id", "code"], "left_anti")
    canon = distinct.withColumn("canon", canon_column(F.col("code")))
    unknown = canon.where("canon IS NULL")
    clash = canon.where("canon IS NOT NULL").groupBy("template_id", "canon").agg(n).where("n > 1")
    parts = [
        rows(dup_key, "error", "duplicate key", F.col("key")),
        rows(dup_row, "error", "duplicate row", F.col("row_offset")),
        rows(lookups, "warning", "shared label", F.col("cell")),
        rows(no_text, "warning", "nothing translatable", F.lit(None)),
        rows(dup_col, "error", "duplicate column", F.col("code")),
        rows(orphan, "warning", "language without column", F.col("code")),
        rows(unnamed, "warning", "column without name", F.col("code")),
        rows(unknown, "warning", "unknown language", F.col("code")),
        rows(clash, "warning", "colliding columns", F.col("canon")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layout_problems(heads: DataFrame, codes: DataFrame) -> DataFrame:
    """AGG-15: columns that stand in each other's place (template_id, severity, problem, item).

    heads (template_id, field_col, desc_col, value_col, first_lang_col); the language block is as wide as
    the template has columns in `codes` (template_id, code)."""
    width = codes.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    rows = heads.join(width, "template_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    names = {"FIELD": "field_col", "DESCRIPTION": "desc_col", "VALUE": "value_col"}
    pairs = [(a, b) for i, a in enumerate(names) for b in list(names)[i + 1 :]]
    entry = lambda problem, item: F.struct(F.lit("error").alias("severity"), F.lit(problem).alias("problem"), F.lit(item).alias("item"))
    found = [F.when(F.col(names[a]) == F.col(names[b]), entry("shared column", f"{a}, {b}")) for a, b in pairs]
    last = F.col("first_lang_col") + F.col("n") - 1
    found += [F.when(F.col(c).between(F.col("first_lang_col"), last), entry("column inside the language block", name)) for name, c in names.items()]
    return array_rows(rows.withColumn("p", F.array_compact(F.array(*found))), "p", "problem", "template_id")


def vanished_keys(fields: DataFrame, previous: DataFrame) -> DataFrame:
    """AGG-15: keys of a template's previous revision that it has no longer (template_id, severity, problem,
    item). Both are (template_id, key, ...); templates that are gone altogether are not judged."""
    still = previous.join(fields.select("template_id").distinct(), "template_id", "left_semi").select("template_id", "key").distinct()
    return still.join(fields.select("template_id", "key").distinct(), ["template_id", "key"], "left_anti").select(
        "template_id", F.lit("error").alias("severity"), F.lit("vanished key").alias("problem"), F.col("key").alias("item")
    )


def told(*parts: Column) -> Column:
    """Hash of values in their order, each behind its length; a missing one is told from an empty one."""
    return content_hash(*[p.cast("string") for p in parts], length=64)


HEAD = ["channel", "header_row", "field_col", "desc_col", "value_col", "first_lang_col", "glossary"]
FIELD = ["key", "label", "kind", "required", "translatable", "row_offset", "aliases", "note"]


def revision_tree(heads: DataFrame, fields: DataFrame, codes: DataFrame, languages: DataFrame) -> DataFrame:
    """SCL-23: what identifies a template's revision, as a tree of hashes.

    heads (template_id, HEAD columns), fields (template_id, ord, FIELD columns), codes (template_id, ord,
    code), languages (template_id, ord, code, name, note). Output: template_id, revision (12 digits), the
    hashes of head, fields, columns and languages, and `by_key` (key, hash) of each field. Order counts, as
    it decides cells; an absent note, glossary or list of aliases is an empty one. A template is a sheet."""
    value = lambda c: F.array_join(F.transform(c, lambda a: F.concat(F.length(a).cast("string"), F.lit(":"), a)), "") if c == "aliases" else F.col(c)
    blank = lambda c: F.coalesce(value(c).cast("string"), F.lit("")) if c in ("note", "glossary", "aliases") else value(c)

    def folded(df: DataFrame, name: str, *columns: str) -> DataFrame:
        leaf = F.struct("ord", told(*[blank(c) for c in columns]).alias("h"), F.col(columns[0]).alias("key"))
        rows = df.groupBy("template_id").agg(F.array_sort(F.collect_list(leaf)).alias(f"{name}_leaves"))
        return rows.withColumn(name, F.sha2(F.array_join(F.transform(f"{name}_leaves", lambda x: x["h"]), ""), 256))

    tree = heads.select("template_id", told(*[blank(c) for c in HEAD]).alias("head"))
    for part in (folded(fields, "fields", *FIELD), folded(codes, "columns", "code"), folded(languages, "languages", "code", "name", "note")):
        tree = tree.join(part, "template_id", "left")
    nothing = F.sha2(F.lit(""), 256)
    parts = ["head", "fields", "columns", "languages"]
    tree = tree.withColumns({c: F.coalesce(c, nothing) for c in parts[1:]})
    by_key = F.transform("fields_leaves", lambda x: F.struct(x["key"].alias("key"), x["h"].alias("hash")))
    return tree.select(
        "template_id", F.left(F.sha2(F.concat(*parts), 256), F.lit(12)).alias("revision"), *parts,
        F.coalesce(by_key, F.array().cast("array<struct<key:string,hash:string>>")).alias("by_key"),
    )


def revision_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two revisions of templates: rows (template_id, part, item, change).

    Trees of one revision are left out at once, and fields are looked at only where their hash differs.
    Part `field` lists keys as added, removed or changed (their order alone gives `order` changed); other
    parts are told as changed."""
    a, b = (df.select("template_id", F.struct("revision", "head", "fields", "columns", "languages", "by_key").alias(n)) for df, n in ((before, "a"), (after, "b")))
    rows = a.join(b, "template_id").where(F.col("a.revision") != F.col("b.revision"))
    entry = lambda part, item, change: F.struct(F.lit(part).alias("part"), F.lit(item).cast("string").alias("item") if item is None else item.alias("item"), F.lit(change).alias("change"))
    whole = F.array_compact(F.array(*[F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), entry(c, None, "changed")) for c in ("head", "columns", "languages")]))
    keys = lambda side: F.transform(F.col(f"{side}.by_key"), lambda x: x["key"])
    hashes = lambda side, k: F.array_sort(F.transform(F.filter(F.col(f"{side}.by_key"), lambda x: x["key"] == k), lambda x: x["hash"]))
    gone, new = F.array_distinct(F.array_except(keys("a"), keys("b"))), F.array_distinct(F.array_except(keys("b"), keys("a")))
    moved = F.filter(F.array_intersect(keys("a"), keys("b")), lambda k: hashes("a", k) != hashes("b", k))
    listed = F.concat(
        F.transform(gone, lambda k: entry("field", k, "removed")), F.transform(new, lambda k: entry("field", k, "added")),
        F.transform(moved, lambda k: entry("field", k, "changed")),
    )
    order = F.array(entry("order", None, "changed"))
    none = F.array().cast("array<struct<part:string,item:string,change:string>>")
    fields = F.when(F.col("a.fields") == F.col("b.fields"), none).when(F.size(listed) == 0, order).otherwise(listed)
    return array_rows(rows.withColumn("changes", F.concat(whole, fields)), "changes", "change", "template_id").select("template_id", "part", "item", "change")


def ownership(campaigns: DataFrame) -> DataFrame:
    """JOIN-19: campaigns per template and whether saving copies or edits in place."""
    rows = campaigns.withColumn("tpl", F.coalesce("template_id", F.lit(DEFAULT_TEMPLATE)))
    counts = rows.groupBy("tpl").agg(F.count(F.lit(1)).alias("n"))
    mode = F.when((F.col("tpl") == DEFAULT_TEMPLATE) | (F.col("n") > 1), "copy").otherwise("in-place")
    return rows.join(counts, "tpl").select("campaign_id", "tpl", F.col("n").alias("pinned"), mode.alias("mode"))


def resolution(campaigns: DataFrame, templates: DataFrame) -> DataFrame:
    """JOIN-20: stored / code / stored_invalid / pinned_missing. templates (template_id, blocking)."""
    rows = campaigns.select("campaign_id", F.coalesce("template_id", F.lit(DEFAULT_TEMPLATE)).alias("template_id"))
    source = (
        F.when(F.col("blocking"), "stored_invalid").when(F.col("blocking").isNotNull(), "stored")
        .when(F.col("template_id") == DEFAULT_TEMPLATE, "code").otherwise("pinned_missing")
    )
    return rows.join(templates, "template_id", "left").select("campaign_id", "template_id", source.alias("source"))
