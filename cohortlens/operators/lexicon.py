"""The lexicon of anchors: categories of words and phrases to search for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Lexicon = Mapping[str, Sequence[str]]

#: The terms searched for in clinical notes.
CLINICAL: dict[str, list[str]] = {
    "adamant": ["adamant", "adamantly", "adament", "adamently", "claim", "claimed", "claiming", "claims", "insist", "insisted", "insistence", "insisting", "insists"],
    "compliance": ["adherance", "adhere", "adhered", "adherence", "adherent", "adheres", "adhering", "compliance", "compliant", "complied", "complies", "comply", "complying", "declined", "declines", "declining", "nonadherance", "nonadherence", "nonadherent", "noncompliance", "noncompliant", "refusal", "refuse", "refused", "refuses", "refusing"],
    "other": ["aggression", "aggressive", "aggressively", "agitated", "agitation", "anger", "angered", "angers", "angrier", "angrily", "angry", "argumentative", "argumentatively", "belligerence", "belligerent", "belligerently", "charming", "combative", "combatively", "confrontational", "cooperative", "defensive", "delightful", "disheveled", "drug seeking", "drug-seeking", "exaggerate", "exaggerates", "exaggerating", "historian", "lovely", "malinger", "malingered", "malingerer", "malingering", "malingers", "narcotic seeking", "narcotic-seeking", "pleasant", "pleasantly", "poorly groomed", "poorly-groomed", "secondary gain", "uncooperative", "unkempt", "unmotivated", "unwilling", "unwillingly", "well groomed", "well-groomed"],
}

#: Common words, for tables that hold none of the clinical terms.
DEMO: dict[str, list[str]] = {"det": ["the", "a", "of"], "cop": ["is", "was", "are"], "conj": ["and", "that", "for"]}


def check(lexicon: Lexicon) -> Lexicon:
    """The lexicon itself; TypeError if it isn't a mapping, KeyError if a keyword occurs twice."""
    if not isinstance(lexicon, Mapping):
        raise TypeError("a lexicon maps categories to keywords")
    twice = sorted(k for k, n in Counter(k for words in lexicon.values() for k in words).items() if n > 1)
    if twice:
        raise KeyError(f"keywords that occur twice: {twice}")
    return lexicon


def lexicon_df(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """(keyword_category, ord, keyword), a few rows."""
    rows = [(c, i, k) for c, words in check(lexicon).items() for i, k in enumerate(words)]
    return spark.createDataFrame(rows, "keyword_category string, ord int, keyword string")


def show_categories(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """(keyword_category, keywords), the keywords in order."""
    held = lexicon_df(spark, lexicon)
    return held.groupBy("keyword_category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def pattern(keywords: Sequence[str]) -> str:
    """A Java pattern that finds the keywords as whole words, in the given order of preference, in any case."""
    return "(?iuU)" + "|".join(rf"\b{re.escape(k)}\b" for k in keywords)


def recover_category(df: DataFrame, lexicon: Lexicon, keyword: str = "keyword") -> DataFrame:
    """``df`` with the category of its keyword; KeyError if one isn't in the lexicon."""
    held = lexicon_df(df.sparkSession, lexicon).select(F.col("keyword").alias(keyword), "keyword_category")
    small = F.broadcast(held)  # the lexicon: a few rows
    unknown = df.select(keyword).distinct().join(small, keyword, "left_anti").limit(20).collect()
    if unknown:
        raise KeyError(f"unknown keywords: {sorted(str(r[0]) for r in unknown)}")
    return df.drop("keyword_category").join(small, keyword)
