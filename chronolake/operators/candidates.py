"""Texts linked to companies: exact codes and titles that hold one of their terms, by an inverted table of title n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter terms are grams themselves.
GRAM = 3
#: Grams and terms up to which their small side is broadcast.
BROADCAST_ROWS = 200_000


def candidate_terms(companies: DataFrame, code: str = "code", terms: str = "terms") -> DataFrame:
    """(code, term): each company's code, what stands before its dot, and its trimmed names; blanks and repeats are left out."""
    own = F.trim(F.col(code))
    given = F.array_compact(F.concat(F.array(own, F.when(own.contains("."), F.substring_index(own, ".", 1))), F.coalesce(F.transform(F.col(terms), lambda t: F.trim(t)), F.array().cast("array<string>"))))
    return companies.select(own.alias("code"), F.explode(given).alias("term")).where("code is not null and term <> ''").distinct()


def _grams(text: Column, size: int) -> Column:
    """The distinct parts of ``size`` characters; none of a shorter text."""
    last = F.char_length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def title_terms(index: DataFrame, terms: DataFrame, key: str = "text_id", title: str = "title") -> DataFrame:
    """(key, term): titles that hold a term, whatever its case.

    Each term stands under its rarest gram in the titles, so rows meet few terms; a term with a gram that no title has is left out before.
    Only grams of terms leave the scan of titles, and the term is looked for in the whole title at the end.
    """
    low = F.lower(F.col(title))
    wanted = terms.select("term").distinct().withColumn("_low", F.lower("term")).where("_low <> ''")
    own = wanted.select("term", "_low", F.explode(F.when(F.char_length("_low") < GRAM, F.array("_low")).otherwise(_grams(F.col("_low"), GRAM))).alias("_gram"))
    sizes = [r[0] for r in own.select(F.char_length("_gram")).distinct().collect()]  # 1 to GRAM
    titles = index.select(F.col(key), low.alias("_title"))
    if not sizes:
        return titles.select(key, F.lit("").alias("term")).where("false")
    seen = titles.select(key, "_title", F.explode(F.array_distinct(F.concat(*(_grams(F.col("_title"), n) for n in sizes)))).alias("_gram"))
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    counts = seen.join(small(own.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = own.join(counts, "_gram", "left").groupBy("term", "_low").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_least"))
    keyed = rarest.where("_least > 0").select("term", "_low", "_gram")
    return seen.join(small(keyed), "_gram").where(F.col("_title").contains(F.col("_low"))).select(key, "term")


def candidate_rows(index: DataFrame, companies: DataFrame, key: str = "text_id", own: str = "ts_code", title: str = "title") -> DataFrame:
    """(code, key), once each: texts whose ``own`` code is the company's, or whose title holds one of its terms."""
    terms = candidate_terms(companies)
    exact = index.select(F.col(own).alias("code"), key).join(terms.select("code").distinct(), "code")
    named = title_terms(index, terms, key, title).join(terms, "term").select("code", key)
    return exact.unionByName(named).distinct()
