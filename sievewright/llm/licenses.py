"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form (case, white space, punctuation, quotes, copyright lines,
equivalent spellings), and the SHA-256 of the whole form is looked up among the digests of known
license texts in a hash join. The same form of each line, whatever its length, is looked up among known
one-line notices. Long licenses are known by digest alone, each whole and without its appendix.

Defined results: a null or empty text, and one of copyright lines only, has the digest of the empty
form and no license; repeated rows each get a result, and ties can't occur (a digest has one license);
an empty table gives an empty result; texts of any length are read whole. Other columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import narrow
from sievewright.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: Equivalent spellings, British to American and the like, on the lower-cased text.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("https://", "http://"), ("(c)", " "), ("©", " "))
COPYRIGHT_LINE = r"(^|\n)[^\S\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
ALL_RIGHTS = r"(^|\n)[^\S\n]*all rights reserved\.?[^\S\n]*(\n|$)"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, known spellings, single spaces between runs of letters and digits."""
    form = F.lower(F.coalesce(text, F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT_LINE, "$1")
    form = F.regexp_replace(form, ALL_RIGHTS, "$1")
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


#: A notice is a sentence on a license: lines without any of these words need no digest.
SPEAKS_OF_IT = "licen[sc]e|spdx|public domain|cc by"


def known(spark, entries: dict[str, str], digests: dict[str, str]) -> DataFrame:
    """(license_id, digest) of the known texts; as many rows as the registry has."""
    made = spark.createDataFrame(list(entries.items()), "license_id string, body string").select("license_id", digest(F.col("body")).alias("digest"))
    return made.union(spark.createDataFrame(list(digests.items()), "license_id string, digest string"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """One row per input row: doc_id, digest, license_id (of the whole text; null if unknown),
    notices (sorted distinct license ids that single lines name), n_notice_lines."""
    spark = docs.sparkSession
    given = narrow(docs, doc_id=id_col, text=text_col)
    lines = spark.createDataFrame(list(notices.items()), "body string, license_id string").select(digest(F.col("body")).alias("d"), "license_id").collect()  # the registry's rows
    table = F.create_map(*[F.lit(x) for r in lines for x in (r["d"], r["license_id"])])
    speaks = re.compile(SPEAKS_OF_IT)
    pattern = SPEAKS_OF_IT if all(speaks.search(n.lower()) for n in notices) else ""  # else every line is looked up
    candidate = lambda line: F.lower(line).rlike(pattern)
    prints = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), candidate), lambda line: F.try_element_at(table, digest(line)))
    hits = F.filter(prints, lambda x: x.isNotNull())
    marked = given.select("doc_id", digest(F.col("text")).alias("digest"), hits.alias("hits"))
    found = marked.join(F.broadcast(known(spark, texts, digests)), "digest", "left")  # a fixed registry
    return found.select("doc_id", "digest", "license_id", F.array_join(F.sort_array(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").cast("long").alias("n_notice_lines"))
