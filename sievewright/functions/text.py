"""Text normalisation, tokens and n-grams as column builders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievewright.functions.edits import edits

CJK = "一-鿿"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Null-safe strip of all Unicode white space."""
    return F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", "")


def norm_label(c: Column) -> Column:
    """Label without any white space and with ASCII brackets."""
    return F.translate(F.regexp_replace(c, r"(?U)[\s　]+", ""), "（）", "()")


@F.pandas_udf(StringType())
def _nfkc(s):
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility normalisation, in Arrow batches; ASCII text, for which it is the identity, is passed on as it is."""
    return _nfkc(c)


def norm_label_nfkc(c: Column) -> Column:
    return strip(F.regexp_replace(nfkc(c), r"[\n\t]", ""))


def clean_text(c: Column) -> Column:
    """NFKC, no control characters, single spaces."""
    plain = F.regexp_replace(nfkc(blank(c)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def excerpt(c: Column, n: int = 120, mark: str = "") -> Column:
    """First n code points, with a mark where something was cut off."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def join_non_blank(parts: list[Column], by: str) -> Column:
    return F.array_join(F.filter(F.array(*[blank(p) for p in parts]), lambda x: F.trim(x) != ""), by)


def dedup_sentences(c: Column, stop: str = "。") -> Column:
    """Sentences in order, each once, white space made plain."""
    flat = F.regexp_replace(blank(c), r"\s+", " ")
    found = F.array_distinct(F.filter(F.transform(F.split(flat, f"[{stop}]", -1), lambda x: F.trim(x)), lambda x: x != ""))
    return let(found, lambda s: F.when(F.size(s) > 0, F.concat(F.array_join(s, stop), F.lit(stop))).otherwise(F.lit("")))


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(c: Column, marks: list[tuple[str, str]]) -> Column:
    """Escaped text with every match of (class, pattern) wrapped in a marked span."""
    out = html_escape(c)
    for name, pattern in marks:
        out = F.regexp_replace(out, f"({pattern})", f"\u0002{name}\u0003$1\u0004")
    for sign, tag in (("\u0002", '<mark class="'), ("\u0003", '">'), ("\u0004", "</mark>")):
        out = F.replace(out, F.lit(sign), F.lit(tag))
    return out


def _grams(chars: Column, n: int) -> Column:
    """n-grams of an array of characters; each character is reached by its index, in constant time."""
    places = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
    made = F.transform(places, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)]))
    return F.when(F.size(chars) >= n, made).otherwise(F.array().cast("array<string>"))


def characters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(c, ""), lambda x: x != ""))


def char_grams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams in order of first place; none for shorter texts."""
    return let(characters(c), lambda chars: F.array_distinct(_grams(chars, n)))


def tokens(c: Column) -> Column:
    """ASCII runs as one lower-case token, other runs as character 2-grams, single characters kept."""
    runs = F.filter(F.split(blank(c), f"[^{CJK}A-Za-z0-9]+", -1), lambda s: s != "")

    def of(s: Column) -> Column:
        grams = let(characters(s), lambda chars: _grams(chars, 2))
        return F.when(s.rlike(r"^[\x00-\x7F]*$"), F.array(F.lower(s))).when(F.char_length(s) > 1, grams).otherwise(F.array(s))

    return F.flatten(F.transform(runs, of))


def any_term(c: Column, terms, case_sensitive: bool = True) -> Column:
    """Whether any of the terms occurs; blank terms never do."""
    hay = c if case_sensitive else F.lower(c)
    out = F.lit(False)
    for t in terms:
        if t:
            out = out | hay.contains(t if case_sensitive else t.lower())
    return out


def hits(c: Column, terms) -> Column:
    """The terms that occur, in list order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: (t != "") & F.contains(c, t))


def n_hits(c: Column, terms) -> Column:
    return sum((F.contains(c, F.lit(t)).cast("int") for t in terms if t), F.lit(0))


def bounded_term(c: Column, terms) -> Column:
    """Case-sensitive; an ASCII term must not touch another ASCII letter."""
    out = F.lit(False)
    for t in terms:
        out = out | (c.rlike(rf"(?<![A-Za-z])\Q{t}\E(?![A-Za-z])") if t.isascii() else c.contains(t))
    return out


def terms_in(c: Column, vocabulary) -> Column:
    """Vocabulary terms in a text: leftmost first, longest at a place, none inside another, in the
    text's own spelling."""
    low = F.lower(c)
    words = F.array(*[F.lit(w.lower()) for w in vocabulary])

    def places(w: Column) -> Column:
        cut = F.split(low, F.concat(F.lit(r"\Q"), w, F.lit(r"\E")), -1)
        ends = F.aggregate(F.slice(cut, 1, F.size(cut) - 1), F.array().cast("array<int>"), lambda acc, part: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1) + F.char_length(w), F.lit(1)) + F.char_length(part))))
        return F.transform(ends, lambda at: F.struct(at.alias("at"), (-F.char_length(w)).alias("n")))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(words, places))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int>>").alias("kept"))
    kept = F.aggregate(found, start, lambda acc, x: F.when(x["at"] >= acc["end"], F.struct((x["at"] - x["n"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
    return F.transform(kept, lambda x: F.substring(c, x["at"], -x["n"]))


def extract_days(c: Column, unit: str = "天|日") -> Column:
    """First number before a day unit, null if there is none."""
    return F.regexp_extract(c, rf"(\d{{1,3}})\s*(?:{unit})", 1).try_cast("int")


def cer(reference: Column, heard: Column, distance=edits) -> Column:
    """Character error rate; an empty reference has 0 against an empty text and 1 against others."""
    n = F.char_length(reference)
    return F.when(n > 0, distance(reference, heard) / n).otherwise(F.when(F.char_length(heard) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def is_empty(c: Column) -> Column:
    """Null, empty or white space only."""
    return strip(c) == ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


#: The wording of a question made from terms, and of filters put in words.
QUESTION = "有哪些詐騙手法？"
FILTER_LABELS = {"category": "類型", "channel": "接觸管道", "payment": "付款方式", "target": "常見對象"}


def as_question(terms: Column) -> Column:
    """A question that stands alone, from an array of terms; null where there are none."""
    return F.when(F.size(terms) > 0, F.concat(F.array_join(terms, "、"), F.lit(QUESTION)))


def describe(filters: Column, labels: dict[str, str] = FILTER_LABELS) -> Column:
    """A map of filters (name to values) in words, in the order of ``labels``; empty ones are left out."""
    said = [F.when(F.size(F.try_element_at(filters, F.lit(k))) > 0, F.concat(F.lit(label + "＝"), F.array_join(F.try_element_at(filters, F.lit(k)), "／"))) for k, label in labels.items()]
    return F.concat_ws("、", *said)


def label_variants(canon: Column, aliases: Column) -> Column:
    """All spellings of a label from two arrays: normalised, each once, in order, none empty."""
    each = F.transform(F.concat(F.coalesce(canon, F.array()), F.coalesce(aliases, F.array())), norm_label)
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: blank(x) != "")))
