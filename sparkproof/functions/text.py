"""Text normalisation as Spark columns (all JVM-side)."""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of ECMAScript regular expressions, which is wider than Java's \s.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Characters without width that copy-paste leaves in mails.
ZERO_WIDTH = r"[\u200b-\u200f\u2060\ufeff\u00ad]"
ZERO_WIDTH_FACTS = r"[\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]"
SINGLE_QUOTES = "‘’ʼ´`"
DOUBLE_QUOTES = "“”«»"


def _accent_table() -> tuple[str, str]:
    """Accented Latin/Greek/Cyrillic letters and their base letter, derived from Unicode itself."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not "\u0300" <= c <= "\u036f")
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _accent_table()


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that it is planned and evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def fold_space(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def clean_text(c: Column) -> Column:
    """SCL-7: zero-width characters removed, white space folded."""
    return fold_space(F.regexp_replace(c, ZERO_WIDTH_FACTS, ""))


def _unify_quotes(c: Column) -> Column:
    return F.translate(
        c, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    )


def norm_text(c: Column) -> Column:
    """SCL-8: comparable form of a copy block; quotes and blanks unified, lower case."""
    return F.lower(fold_space(_unify_quotes(F.regexp_replace(c, ZERO_WIDTH, ""))))


def norm_detect(c: Column) -> Column:
    """SCL-8, variant of language detection: U+200B becomes a blank and other marks stay."""
    return F.lower(fold_space(F.regexp_replace(_unify_quotes(c), r"\u200b", " ")))


def norm_tokens(c: Column) -> Column:
    """SCL-9: lower case, no accents, everything but a-z 0-9 a blank."""
    plain = F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _BASE), r"[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), " +", " "))


def token_set(c: Column, min_len: int) -> Column:
    """Distinct normalised tokens of at least `min_len` characters."""
    return F.array_distinct(
        F.filter(F.split(norm_tokens(c), " "), lambda t: F.length(t) >= min_len)
    )


def token_overlap(a: Column, b: Column) -> Column:
    """SCL-15: shared share of the smaller token set, 0 when either is empty."""
    ta, tb = token_set(a, 3), token_set(b, 3)
    smaller = F.least(F.size(ta), F.size(tb))
    return F.when(smaller > 0, F.size(F.array_intersect(ta, tb)) / smaller).otherwise(F.lit(0.0))


def norm_message(c: Column) -> Column:
    """SCL-11: message text that identifies a repeated finding."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def norm_quote(c: Column) -> Column:
    """Form in which a quotation is looked up in its source."""
    return F.lower(fold_space(c))


def quote_found(quote: Column, source: Column) -> Column:
    """JOIN-15 predicate: the quotation occurs in its source."""
    return F.coalesce(
        (F.length(quote) > 0) & F.contains(norm_quote(source), norm_quote(quote)), F.lit(False)
    )


def evidence_found(evidence: Column, source: Column) -> Column:
    """Evidence too short to be checked is accepted."""
    return F.coalesce(F.length(evidence) < 4, F.lit(True)) | quote_found(evidence, source)


def strip_control_chars(c: Column) -> Column:
    """SCL-35: characters that XML sheets cannot hold."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def bigrams(c: Column) -> Column:
    """Character pairs of a text in order, overlapping; one linear scan."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), 1)


COPY_MARK = "\x01"


def numbered(items: Column) -> Column:
    """Multiset as a set: the n-th copy of an item is tagged n, so set intersection counts copies.

    The first copy's place in the sorted array is found by bisection, as one scan for each item takes the
    square of their number."""
    halves = F.transform(
        F.sequence(F.length(F.bin(F.size(items))) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")
    )

    def first(ordered: Column, steps: Column, item: Column) -> Column:
        return F.aggregate(
            steps, F.lit(0), lambda at, s: at + F.when(F.get(ordered, at + s - 1) < item, s).otherwise(F.lit(0))
        )

    return let(
        F.array_sort(items),
        lambda ordered: let(
            halves,
            lambda steps: F.transform(
                ordered,
                lambda x, i: F.concat(x, F.lit(COPY_MARK), (i - first(ordered, steps, x)).cast("string")),
            ),
        ),
    )


def numbered_bigrams(c: Column) -> Column:
    """`numbered(bigrams(c))` in one scan of the sorted pairs: equal ones stand in one run."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(bigrams(c)), ""), F.lit(r"(?s)(..)\1*"), 0)

    def copies(run: Column) -> Column:
        return let(
            F.substring(run, 1, 2),
            lambda gram: F.transform(
                F.sequence(F.lit(0), (F.length(run) / 2).cast("int") - 1),
                lambda n: F.concat(gram, F.lit(COPY_MARK), n.cast("string")),
            ),
        )

    return F.flatten(F.transform(runs, copies))


def dice_of_numbered(a: Column, na: Column, b: Column, nb: Column) -> Column:
    total = F.size(na) + F.size(nb)
    shared = F.size(F.array_intersect(na, nb))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.size(na) == 0) | (F.size(nb) == 0), F.lit(0.0))
        .otherwise(2.0 * shared / total)
    )


def dice_similarity(a: Column, b: Column) -> Column:
    """SIM-1: Dice coefficient over the bigram multisets of two texts."""
    return let(
        numbered_bigrams(a), lambda na: let(numbered_bigrams(b), lambda nb: dice_of_numbered(a, na, b, nb))
    )


def pair_counts(texts: pa.Array) -> list[tuple[str, Counter] | None]:
    """Each text of a batch with the copies of its character pairs; a text that occurs again is counted once."""
    coded = texts.dictionary_encode()
    counted = [(t, Counter(map(operator.add, t, t[1:]))) for t in coded.dictionary.to_pylist()]
    return [None if i is None else counted[i] for i in coded.indices.to_pylist()]


def dice_of_counts(x: tuple[str, Counter], y: tuple[str, Counter]) -> float:
    (a, pairs_a), (b, pairs_b) = x, y
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    shared = sum([min(pairs_a[p], pairs_b[p]) for p in pairs_a.keys() & pairs_b.keys()])
    return 2.0 * shared / (len(a) + len(b) - 2)


def dice_of_pair(a: Column, b: Column) -> Column:
    """SIM-1 for rows in which the same texts occur again and again: no arrays of character pairs are made in the
    rows, and characters are whole code points."""

    def dice(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = zip(pair_counts(left), pair_counts(right), strict=True)
        return pa.array([None if x is None or y is None else dice_of_counts(x, y) for x, y in rows], pa.float64())

    return F.arrow_udf(dice, returnType=T.DoubleType())(a, b)


PERSONAL_SLOT = r"\[[^\]]{2,40}\]|%%[^%]{1,40}%%|\{\{[^}]{1,40}\}\}"


SLOT_MARK = "\ue000"


def has_slot(c: Column) -> Column:
    return c.rlike(PERSONAL_SLOT)


def _literal_pattern(part: Column) -> Column:
    """A copy line as a regular expression whose slots take up to 60 characters."""
    marked = norm_text(F.regexp_replace(part, PERSONAL_SLOT, SLOT_MARK))
    escaped = F.regexp_replace(marked, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.replace(
        F.replace(escaped, F.lit(SLOT_MARK), F.lit(r"[^\n]{0,60}?")), F.lit(" "), F.lit(WS + "+")
    )


def personalization_pattern(raw: Column) -> Column:
    """SCL-16: pattern of a block with slots, NULL when it has none.

    Lines of the form "a / b" are alternatives."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != "")

    def line_pattern(line: Column) -> Column:
        options = F.filter(F.transform(F.split(line, " / "), _literal_pattern), lambda p: p != "")
        both = has_slot(line) & F.contains(line, F.lit(" / "))
        return F.when(both, F.concat(F.lit("(?:"), F.array_join(options, "|"), F.lit(")"))).otherwise(
            _literal_pattern(line)
        )

    parts = F.filter(F.transform(lines, line_pattern), lambda p: p != "")
    return F.when(
        has_slot(raw) & (F.size(parts) > 0),
        F.concat(F.lit("(?iu)"), F.array_join(parts, WS + "*")),
    )


def diff_tokens(c: Column) -> Column:
    """SCL-17/18: comparable pieces: URL parts for a URL, else words and single characters."""
    url = F.trim(c)
    head = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"^https?://[^?#]+\?([^#]*)", 1)
    has_query = url.rlike(r"^https?://[^?#]+\?")
    fragment = F.regexp_extract(url, r"^https?://[^#]+(#.*)$", 1)
    params = F.transform(
        F.split(query, "&"), lambda p, i: F.concat(F.when(i == 0, F.lit("?")).otherwise(F.lit("&")), p)
    )
    none = F.array().cast("array<string>")
    url_tokens = F.concat(
        F.array(head),
        F.regexp_extract_all(path, F.lit("(/[^/]*)"), 1),
        F.when(has_query, params).otherwise(none),
        F.when(fragment != "", F.array(fragment)).otherwise(none),
    )
    words = F.regexp_extract_all(c, F.lit(rf"([A-Za-zÀ-ÿ0-9']+|{WS}+|.)"), 1)
    return F.when(url.rlike(r"^https?://\S+$"), url_tokens).otherwise(words)


def changed_tokens(a: Column, b: Column) -> Column:
    """SCL-17: pieces of `a` beyond the copies that `b` has (multiset difference, sorted)."""
    return F.transform(
        F.array_except(numbered(diff_tokens(a)), numbered(diff_tokens(b))),
        lambda t: F.regexp_replace(t, COPY_MARK + r"\d+$", ""),
    )


# Personal data patterns of the rule editor.
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
PHONE_PATTERN = r"(?:\+\d{1,3}[ .-]?)?(?:\d[ .-]?){9,13}\d"


def find_pii(c: Column) -> Column:
    """SCL-24: what kind of personal data a rule text seems to hold, else NULL."""
    return F.when(c.rlike(EMAIL_PATTERN), F.lit("an email address")).when(
        c.rlike(PHONE_PATTERN), F.lit("a phone number")
    )
