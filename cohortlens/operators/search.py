"""Anchor search: every hit of a lexicon with its character offsets, and the words round it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import _let, clean_text, context_window, ends_blank, negated_keyword, normalize_text, unit_window, units_begun, word_units
from cohortlens.operators.guards import require_columns
from cohortlens.operators.lexicon import CLINICAL, Lexicon, check, lexicon_df, pattern

HIT = "array<struct<keyword_category:string,start:int,end:int,keyword:string>>"


#: Hits whose offsets are summed up together; an array grows by copying, so it is kept short.
_BLOCK = 64


def _running(values: Column) -> Column:
    """The sums of the numbers before each one of an array."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _category_spans(text: Column, category: str, keywords: list[str], units: Column | None = None, size: int = 0) -> Column:
    """The hits of one category, with their windows if there are ``units``; see :func:`spans` and :func:`windows`."""
    hits = F.regexp_extract_all(text, F.lit(pattern(keywords)), F.lit(0))
    gaps = F.slice(F.split(text, pattern(keywords), -1), 1, F.size(hits))

    def pair(gap: Column, hit: Column) -> Column:
        begun = [] if units is None else [(units_begun(gap) + ends_blank(gap).cast("int")).alias("before"), units_begun(hit).alias("inside")]
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), F.lower(hit).alias("keyword"), *begun)

    if units is not None:  # the text's first word begins behind a space too
        gaps = F.transform(gaps, lambda gap, i: F.when(i == 0, F.concat(F.lit(" "), gap)).otherwise(gap))
    pairs = F.zip_with(gaps, hits, pair)
    shift = 0 if units is None else 1
    width = lambda block: F.transform(block, lambda x: x["gap"] + x["hit"])
    words = lambda block: F.transform(block, lambda x: x["before"] + x["inside"])

    def placed(block: Column, base: Column) -> Column:
        def hit(x: Column, before: Column) -> Column:
            start = base["at"] + before["at"] + x["gap"] - shift
            out = [F.lit(category).alias("keyword_category"), start.alias("start"), (start + x["hit"]).alias("end"), x["keyword"].alias("keyword")]
            if units is not None:
                first = base["word"] + before["word"] + x["before"] - 1
                out.append(unit_window(units, F.length(text), first, first + x["inside"], start + x["hit"], size).alias("window"))
            return F.struct(*out)

        return F.zip_with(block, sums(width(block), words(block)), hit)

    def sums(widths: Column, counts: Column) -> Column:
        if units is None:
            return F.transform(_running(widths), lambda at: F.struct(at.alias("at")))
        return F.zip_with(_running(widths), _running(counts), lambda at, word: F.struct(at.alias("at"), word.alias("word")))

    def in_blocks(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(_BLOCK)), lambda k: F.slice(pairs, k, F.lit(_BLOCK)))

    def over_blocks(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, sums(F.transform(blocks, lambda x: _sum(width(x))), F.transform(blocks, lambda x: _sum(words(x))) if units is not None else F.lit(None)), placed))

    return _let(pairs, lambda x: _let(in_blocks(x), over_blocks))


def spans(text: Column, lexicon: Lexicon) -> Column:
    """All leftmost hits of each category, found independently; offsets in characters from 0; null texts have none.

    Texts between hits and hits alternate, so a running sum over their lengths gives the offsets: inside blocks of hits, and over the blocks.
    """
    found = [F.coalesce(_category_spans(text, category, keywords), F.array().cast(HIT)) for category, keywords in check(lexicon).items()]
    return F.concat(*found) if found else F.array().cast(HIT)


def windows(text: Column, lexicon: Lexicon, size: int) -> Column:
    """:func:`spans` with each hit's window, not cleaned yet.

    The text is cut into words once. Which word a hit is in follows from how many begin in the texts before it, a running sum like that of the offsets;
    a window is a slice of the words, so the time grows with the text and the hits and not with their product.
    """
    if size < 1:
        raise ValueError("the window holds at least one word")
    kind = HIT.replace("keyword:string", "keyword:string,window:string")

    def each(units: Column) -> Column:
        found = [F.coalesce(_category_spans(text, category, keywords, units, size), F.array().cast(kind)) for category, keywords in check(lexicon).items()]
        return F.concat(*found) if found else F.array().cast(kind)

    return _let(word_units(text), each)


def find_hits(df: DataFrame, lexicon: Lexicon = CLINICAL, text_col: str = "text") -> DataFrame:
    """``df`` with one row per hit: keyword_category, start, end and keyword added. No shuffle."""
    hit = df.withColumn("hit", F.explode(spans(F.col(text_col), lexicon)))
    return hit.select(*df.columns, "hit.keyword_category", "hit.start", "hit.end", "hit.keyword")


def search(df: DataFrame, lexicon: Lexicon = CLINICAL, context_size: int = 10, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document_id, keyword_category, start, end, keyword and the cleaned window of every hit; offsets refer to the raw text."""
    require_columns(df, id_col, text_col)
    hits = df.select(F.col(id_col).alias("document_id"), F.explode(windows(F.col(text_col), lexicon, context_size)).alias("hit"))
    return hits.select("document_id", "hit.keyword_category", "hit.start", "hit.end", "hit.keyword", normalize_text(clean_text(F.col("hit.window"))).alias("text"))


def format_for_model(found: DataFrame, keyword_category: str) -> DataFrame:
    """Ids, keywords and windows of one category; no rows if it has none."""
    return found.where(F.col("keyword_category") == keyword_category).select("document_id", "keyword", "text")


def search_corpus(notes: DataFrame, lexicon: Lexicon = CLINICAL, window: int = 10, text_col: str = "note_text", offsets_on: str = "clean", only: DataFrame | None = None, id_col: str = "encounter_note_id") -> DataFrame:
    """One row per hit of every note, its text replaced by the window.

    ``offsets_on`` "clean" searches the cleaned and normalised text, "raw" the text as it is (windows are then cleaned).
    ``only`` restricts the notes to the ids it holds.
    """
    if offsets_on not in ("clean", "raw"):
        raise ValueError("offsets_on is 'clean' or 'raw'")
    if only is not None:
        notes = notes.join(only.select(id_col).distinct(), id_col, "left_semi")
    text = F.col(text_col)
    notes = notes.withColumn(text_col, normalize_text(clean_text(text))) if offsets_on == "clean" else notes
    others = [c for c in notes.columns if c != text_col]
    hits = notes.select(*others, F.explode(windows(F.col(text_col), lexicon, window)).alias("__hit"))
    found = F.col("__hit.window")
    found = (normalize_text(clean_text(found)) if offsets_on == "raw" else found).alias(text_col)
    return hits.select(*[found if c == text_col else c for c in notes.columns], "__hit.keyword_category", "__hit.start", "__hit.end", "__hit.keyword")


def coverage(df: DataFrame, lexicon: Lexicon = CLINICAL, text_col: str = "text") -> DataFrame:
    """One row: documents searched, and those with a hit."""
    any_hit = F.greatest(*[F.coalesce(F.col(text_col).rlike(pattern(k)).cast("int"), F.lit(0)) for k in check(lexicon).values()], F.lit(0))
    return df.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(any_hit), F.lit(0)).alias("n_matched"))


def keyword_counts(df: DataFrame, lexicon: Lexicon = CLINICAL, text_col: str = "text") -> DataFrame:
    """Hits per category and keyword of all texts, most first within a category, found without their offsets."""
    def named(category: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(category).alias("keyword_category"), F.lower(x).alias("keyword"))

    each = [F.coalesce(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern(words)), F.lit(0)), named(c)), F.array().cast("array<struct<keyword_category:string,keyword:string>>")) for c, words in check(lexicon).items()]
    hit = df.select(F.explode(F.concat(*each)).alias("hit")).select("hit.*")
    return match_counts(hit)


def match_counts(hits: DataFrame) -> DataFrame:
    """Hits per category and keyword, most first within a category."""
    return hits.groupBy("keyword_category", "keyword").agg(F.count("*").alias("n")).orderBy("keyword_category", F.desc("n"), "keyword")


def with_negation(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """``hits`` with keyword_negated: the keyword with a negator before it, as the window has it."""
    return hits.withColumn("keyword_negated", negated_keyword(F.col("keyword"), F.col(text_col)))


def augment_labels(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Every label with its window, joined on note, category, keyword and offsets; columns of single annotators go."""
    keys = ["encounter_note_id", "keyword_category", "keyword", "start", "end"]
    require_columns(labels, *keys)
    labels = labels.drop(*[c for c in labels.columns if c.startswith("annotator_")])
    return windows.join(labels, keys, "right")


def rewindow(df: DataFrame, full_text_col: str, size: int, into: str = "note_text") -> DataFrame:
    """``df`` with its windows cut anew, at another size, from the full text."""
    return df.withColumn(into, context_window(F.col(full_text_col), F.col("start"), F.col("end"), size))


def remove_keywords(df: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` without rows whose keyword or negated keyword is in ``words``, and the words that no row has."""
    cols = [c for c in ("keyword", "keyword_negated") if c in df.columns]
    gone = F.lit(False)
    for c in cols:
        gone = gone | F.coalesce(F.col(c).isin(words), F.lit(False))
    listed = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    held = None
    for c in cols:
        one = df.select(F.col(c).alias("word"))
        held = one if held is None else held.unionByName(one)
    unknown = [r.word for r in listed.join(held.distinct(), "word", "left_anti").orderBy("word").collect()] if words and held is not None else list(words)
    return df.where(~gone), unknown


def exclude_keywords(df: DataFrame, words: list[str]) -> DataFrame:
    """``df`` without rows of the given keywords."""
    return df.where(~F.coalesce(F.col("keyword").isin(words), F.lit(False))) if words else df


def lexicon_join(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``df`` with category and place in the lexicon of its keyword; other rows go."""
    return df.join(F.broadcast(lexicon_df(df.sparkSession, lexicon)), ["keyword_category", "keyword"])
