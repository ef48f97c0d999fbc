"""Tokens of texts, vocabularies, co-occurrence counts and learned phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.shared import stored

from cohortlens.functions.text import _let, remove_keyword

#: A word with inner hyphens or apostrophes, or one mark.
TOKEN = "(?U)\\w+(?:[-'’]\\w+)*|[^\\w\\s]"
_PUNCTUATION = "^[!-/:-@\\[-`{-~]*$"


def _negator(t: Column) -> Column:
    return (t == "not") | t.endswith("n't")


def _not_like(pattern: str) -> Callable[[Column], Column]:
    return lambda t: ~t.rlike(pattern)


def _replaced(pattern: str, name: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(pattern), name).otherwise(t)


def add_negation(tokens: Column) -> Column:
    """Drops negators ("not", "...n't") and puts "not_" before the next token that stays; a trailing negator vanishes."""
    marked = F.transform(tokens, lambda t, i: F.when((i > 0) & ~_negator(t) & _negator(F.coalesce(F.get(tokens, i - 1), F.lit(""))), F.concat(F.lit("not_"), t)).otherwise(t))
    return F.filter(F.zip_with(tokens, marked, lambda t, m: F.when(~_negator(t), m)), lambda t: t.isNotNull())


def tokenize(text: Column, remove: Sequence[Column] = (), preserve_case: bool = False, punctuation: str = "drop", numbers: str = "drop", negation: bool = True) -> Column:
    """The tokens of a text as an array.

    ``remove`` holds keywords to take out first, each with a negator right before it. ``punctuation`` and ``numbers`` say what
    becomes of tokens of marks only and of tokens with a digit: "drop", "replace" (by <PUNC> or <NUM>) or "keep". Blank tokens go;
    negation is marked last.
    """
    for value in (punctuation, numbers):
        if value not in ("drop", "replace", "keep"):
            raise ValueError("punctuation and numbers are 'drop', 'replace' or 'keep'")
    text = reduce(remove_keyword, remove, text)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if not preserve_case:
        tokens = F.transform(tokens, F.lower)
    for what, pattern, name in ((punctuation, _PUNCTUATION, "<PUNC>"), (numbers, "\\p{Nd}", "<NUM>")):
        if what == "drop":
            tokens = F.filter(tokens, _not_like(pattern))
        elif what == "replace":
            tokens = F.transform(tokens, _replaced(pattern, name))
    tokens = F.filter(tokens, lambda t: F.length(F.trim(t)) > 0)
    return add_negation(tokens) if negation else tokens


def token_views(df: DataFrame, text_col: str = "note_text", keyword_col: str = "keyword") -> DataFrame:
    """``df`` with tokens (the keyword taken out) and tokens_full."""
    text = F.col(text_col)
    return df.withColumn("tokens", tokenize(text, [F.col(keyword_col)])).withColumn("tokens_full", tokenize(text))


def ngrams(tokens: Column, n: int) -> Column:
    """Arrays of ``n`` neighbouring tokens; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def token_counts(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, n) over all rows."""
    return df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def ranked_by_count(counts: DataFrame) -> DataFrame:
    """``counts`` (token, n) with rank from 0: by falling count, then by token.

    Rows are numbered inside (count, first two characters), after the sizes of the groups before; only the table of group sizes
    is ordered as a whole.
    """
    head = F.substring("token", 1, 2)
    counts = counts.withColumn("head", head)
    before = Window.orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("n", "head").agg(F.count("*").alias("size")).select("n", "head", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("n", "head").orderBy("token")
    return counts.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["n", "head"]).select("token", "n", (F.col("first") + F.col("at")).alias("rank"))


def vocabulary(df: DataFrame, tokens_col: str = "tokens", rm_top: int = 10, min_freq: int | None = 3, max_freq: int | None = None, stopwords: Sequence[str] = ("patient", "pt")) -> DataFrame:
    """(token, n, index): the vocabulary by falling count, ties by token; the index counts what :func:`kept_tokens` leaves."""
    return ranked_by_count(kept_tokens(df, tokens_col, rm_top, min_freq, max_freq, stopwords)).withColumnRenamed("rank", "index")


def kept_tokens(df: DataFrame, tokens_col: str = "tokens", rm_top: int = 10, min_freq: int | None = 3, max_freq: int | None = None, stopwords: Sequence[str] = ("patient", "pt")) -> DataFrame:
    """(token, n) of the vocabulary, in no order.

    In this order: the ``rm_top`` commonest go, then those under ``min_freq``, over ``max_freq``, and stopwords.
    """
    counts = token_counts(df, tokens_col)
    if rm_top:
        top = counts.orderBy(F.desc("n"), "token").limit(rm_top).select("token")
        counts = counts.join(F.broadcast(top), "token", "left_anti")  # rm_top rows
    if min_freq:
        counts = counts.where(F.col("n") >= min_freq)
    if max_freq:
        counts = counts.where(F.col("n") <= max_freq)
    if stopwords:
        counts = counts.where(~F.col("token").isin(list(stopwords)))
    return counts


def _coded(column: pa.Array, words: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts of each row's list, a number per token, the words in the order of these numbers). Given ``words`` name the numbers, others have -1; without, null is a word too."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    held = column.flatten().dictionary_encode(null_encoding="encode")
    codes = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if words is not None:
        place = pc.fill_null(pc.index_in(held.dictionary, words, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = place[codes] if len(codes) else codes
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), codes, held.dictionary


#: Tokens whose pairs are sorted together.
_SORTED = 1 << 21


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Rows of about ``_SORTED`` tokens together: (the row of each token, its number, the words in the order of these numbers)."""
    for batch in batches:
        whole = batch.column(0)
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)) // _SORTED
        ends = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(whole)]
        for i, j in zip(ends, ends[1:], strict=False):
            starts, codes, words = _coded(whole.slice(i, j - i))
            yield np.repeat(np.arange(j - i), np.diff(starts)), codes, words


#: Bits of a run's hash, and the powers of two between which the filter's bits are (2 to 32 MB).
_HASHED, _FILTER_BITS = 40, (24, 28)


def _runs(of: np.ndarray, codes: np.ndarray, words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of ``n`` tokens of one row start, a hash of each)."""
    m = max(0, len(codes) - n + 1)
    at = np.flatnonzero(of[:m] == of[n - 1 : n - 1 + m])
    word = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)[codes] if m else np.zeros(0, np.uint64)
    out = word[at]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[at + k]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return at, (out >> np.uint64(64 - _HASHED)).astype(np.int64)


def frequent_ngrams(df: DataFrame, tokens_col: str = "tokens", n: int = 2, least: int = 2) -> DataFrame:
    """(gram, n): runs of ``n`` tokens, joined by a space, that occur ``least`` times or more.

    Tasks count hashes first, and then the texts of only those runs whose hash passes a filter of the frequent ones: a run that passes without being
    frequent costs a row, and is counted like any other. ``df`` is read twice.
    """
    tokens = df.select(tokens_col)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            found, times = np.unique(_runs(*stretch, n)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["h", "n"])

    often = stored(tokens.mapInArrow(hashes, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "often")  # moved first: few are equal within a task, and their map would spill
    bits = min(max(_FILTER_BITS[0], (8 * often.count()).bit_length()), _FILTER_BITS[1])
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    marked = often.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("value")).toArrow()  # at most 2^22 words
    passing = np.zeros(1 << (bits - 6), np.int64)
    passing[marked.column("word").to_numpy()] = marked.column("value").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(passing.view(np.uint8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, codes, words in _stretches(batches):
            at, h = _runs(of, codes, words, n)
            h &= (1 << bits) - 1
            at = at[sent.value[h >> 3] >> (h & 7).astype(np.uint8) & 1 > 0]
            key = codes[at]
            for k in range(1, n):
                key = np.unique(key, return_inverse=True)[1] * len(words) + codes[at + k]
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            gram = pc.binary_join_element_wise(*[words.take(pa.array(codes[at[first] + k])) for k in range(n)], " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([gram, pa.array(times.astype(np.int64))], ["gram", "n"])

    return tokens.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cooccurrence(df: DataFrame, tokens_col: str = "tokens", left: int = 0, right: int = 1) -> DataFrame:
    """(a, b, n): how often b stands within ``left`` tokens before and ``right`` after a. Tasks count the pairs of stretches of rows as numbers before any is moved."""
    steps = [*range(-left, 0), *range(1, right + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, codes, words in _stretches(batches):
            keys = []
            for k in steps:
                n = max(0, len(codes) - abs(k))
                first, second = slice(max(0, -k), max(0, -k) + n), slice(max(0, k), max(0, k) + n)
                keys.append((codes[first] * len(words) + codes[second])[of[first] == of[second]])
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return df.select(tokens_col).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _scored(counts: DataFrame, pairs: DataFrame, min_count: int, threshold: float) -> DataFrame:
    """(a, b, n, score) of pairs above the threshold, from the counts of tokens and of pairs."""
    size = counts.count()
    one = lambda c: counts.select(F.col("token").alias(c), F.col("n").alias(f"n_{c}"))
    scored = pairs.where(F.col("n") > min_count).join(one("a"), "a").join(one("b"), "b").withColumn("score", (F.col("n") - min_count) * F.lit(float(size)) / (F.col("n_a") * F.col("n_b")))
    return scored.where(F.col("score") > threshold).select("a", "b", "n", "score")


def phrase_scores(df: DataFrame, tokens_col: str = "tokens", min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """(a, b, n, score) of neighbouring tokens whose score, (n - min_count) * |vocabulary| / (n_a * n_b), is above the threshold."""
    return _scored(token_counts(df, tokens_col), cooccurrence(df, tokens_col), min_count, threshold)


#: The most bytes of phrases that are sent to tasks: their distinct words, and eight for each phrase.
_IN_ROWS = 128 << 20


def _merged(t: Column, at: Column) -> Column:
    """Tokens with those at each place of ``at`` and after it joined by a space."""
    n = F.size(t)
    upto = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(n))
    joined = F.zip_with(at, upto, lambda i, j: F.concat(F.array(F.concat_ws(" ", F.get(t, i), F.get(t, i + 1))), F.slice(t, i + 3, F.greatest(j - i - 2, F.lit(0)))))
    return F.when(F.size(at) == 0, t).otherwise(F.concat(F.slice(t, F.lit(1), F.get(at, F.lit(0))), F.flatten(joined)))


def _placed(df: DataFrame, phrases: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, tokens, __at): where phrases are joined. Tasks look phrases up in sorted numbers of checked size; more of them are joined with the places."""
    t = F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias(tokens_col)
    phrases = phrases.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    words = phrases.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    chars = words.agg(F.coalesce(F.sum(F.octet_length("w") + 4), F.lit(0)).alias("n")).first().n
    if chars + 8 * phrases.count() <= _IN_ROWS:
        known = words.toArrow().column("w").combine_chunks()  # of checked size, as the phrases
        found = phrases.select("a", "b").toArrow()
        place = lambda c: pc.index_in(found.column(c), known).combine_chunks().to_numpy(zero_copy_only=False)
        keys = np.unique(place("a").astype(np.int64) * len(known) + place("b").astype(np.int64))
        sent = df.sparkSession.sparkContext.broadcast((known, keys))
        kinds = {f.name: f.dataType.simpleString() for f in df.select(id_col, t).schema}

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, keys = sent.value
            for batch in batches:
                starts, codes, _ = _coded(batch.column(tokens_col), known)
                of = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                key = np.where((codes[:-1] >= 0) & (codes[1:] >= 0) & (of[:-1] == of[1:]), codes[:-1] * max(1, len(known)) + codes[1:], -1)
                near = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                hits = np.flatnonzero(keys[near] == key) if len(keys) else np.zeros(0, np.int64)
                # the greedy scan from the left takes every other place of a run
                fresh = np.concatenate([[True], (np.diff(hits) > 1) | (np.diff(of[hits]) > 0)]) if len(hits) else np.zeros(0, bool)
                taken = hits[(np.arange(len(hits)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))) % 2 == 0] if len(hits) else hits
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[taken], minlength=batch.num_rows))]).astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(ends), pa.array((taken - starts[of[taken]]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(tokens_col), at], [id_col, tokens_col, "__at"])

        return df.select(id_col, t).mapInArrow(look, f"`{id_col}` {kinds[id_col]}, `{tokens_col}` array<string>, __at array<int>")
    n = F.size(tokens_col)
    pairs = F.arrays_zip(F.col(tokens_col).alias("a"), F.slice(tokens_col, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    places = df.select(id_col, F.posexplode(pairs).alias("pos", "pair")).select(id_col, "pos", "pair.a", "pair.b")
    hits = places.join(phrases.select("a", "b"), ["a", "b"], "left_semi").select(id_col, "pos")
    row = Window.partitionBy(id_col).orderBy("pos")
    nth = F.row_number().over(Window.partitionBy(id_col, "run").orderBy("pos"))
    starts = hits.withColumn("run", F.col("pos") - F.row_number().over(row)).withColumn("nth", nth).where("nth % 2 = 1")
    starts = starts.groupBy(id_col).agg(F.array_sort(F.collect_list("pos")).alias("__at"))
    return df.select(id_col, t).join(starts, id_col, "left").withColumn("__at", F.coalesce("__at", F.array().cast("array<int>")))


def merge_phrases(df: DataFrame, phrases: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """(id, tokens): tokens with phrases joined by a space, greedily from the left; null tokens give none.

    A map over rows while the phrases take up to 128 MB; beyond that the places where phrases start are joined with them, and ids have to be unique.
    """
    return _placed(df, phrases, id_col, tokens_col).select(id_col, _merged(F.col(tokens_col), F.col("__at")).alias(tokens_col))


def _changes(placed: DataFrame, tokens_col: str) -> DataFrame:
    """(a, b, n): what joining at the places of ``__at`` adds to the counts of pairs, and with b null to those of tokens. Only neighbours of joined places change."""
    t, at = F.col(tokens_col), F.col("__at")

    def pairs(x: Column, near: Column, sign: int) -> Column:
        inside = F.filter(F.array_distinct(near), lambda p: (p >= 0) & (p < F.size(x) - 1))
        return F.transform(inside, lambda p: F.struct(F.get(x, p).alias("a"), F.get(x, p + 1).alias("b"), F.lit(sign).alias("n")))

    def alone(token: Callable[[Column], Column], sign: int) -> Column:
        return F.transform(at, lambda i: F.struct(token(i).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(sign).alias("n")))

    gone = F.flatten(F.transform(at, lambda i: F.array(i - 1, i, i + 1)))
    come = F.flatten(F.transform(at, lambda i, k: F.array(i - k - 1, i - k)))
    single = [alone(lambda i: F.get(t, i), -1), alone(lambda i: F.get(t, i + 1), -1), alone(lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)), 1)]
    every = _let(_merged(t, at), lambda x: F.concat(pairs(t, gone, -1), pairs(x, come, 1), *single))
    return placed.where(F.size("__at") > 0).select(F.explode(every).alias("c")).groupBy("c.a", "c.b").agg(F.sum("c.n").cast("long").alias("n")).where("n != 0")


class PhraseLearner:
    """Phrases learned in rounds, each on the tokens that the last one made."""

    def __init__(self, passes: int = 2, min_count: int = 5, threshold: float = 10.0):
        self.passes, self.min_count, self.threshold, self.rounds = passes, min_count, threshold, []

    def fit_transform(self, df: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
        """Learns on ``df`` and returns (id, tokens); the tokens, and each round's counts and phrases, are stored in the shared folder.

        Only the first round counts the corpus; each later one adds what joining changed. Pairs of ``min_count`` or fewer are held only if a phrase is part
        of them: no others can become more.
        """
        self.rounds = []
        if not self.passes:
            return df.select(id_col, tokens_col)
        tokens = stored(df.select(id_col, tokens_col), "tokens")
        counts = stored(token_counts(tokens, tokens_col), "counts")
        live = (F.col("n") > self.min_count) | F.contains("a", F.lit(" ")) | F.contains("b", F.lit(" "))
        pairs = stored(cooccurrence(tokens, tokens_col).where(live), "pairs")
        for k in range(self.passes):
            found = stored(_scored(counts, pairs, self.min_count, self.threshold), "phrases")
            self.rounds.append(found)
            placed = _placed(tokens, found, id_col, tokens_col)
            tokens = placed.select(id_col, _merged(F.col(tokens_col), F.col("__at")).alias(tokens_col))
            if k + 1 < self.passes:
                changes = stored(_changes(placed, tokens_col), "changes")
                counts = stored(counts.unionByName(changes.where("b is null").select(F.col("a").alias("token"), "n")).groupBy("token").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
                pairs = stored(pairs.unionByName(changes.where("b is not null")).groupBy("a", "b").agg(F.sum("n").alias("n")).where((F.col("n") > 0) & live), "pairs")
        return tokens

    def fit(self, df: DataFrame, id_col: str, tokens_col: str = "tokens") -> PhraseLearner:
        """Learns on ``df``; the last round's tokens aren't made."""
        self.fit_transform(df, id_col, tokens_col)
        return self

    def transform(self, df: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
        """(id, tokens) of ``df`` under the learned rounds."""
        tokens = df.select(id_col, tokens_col)
        for found in self.rounds:
            tokens = merge_phrases(tokens, found, id_col, tokens_col)
        return tokens

    def phrases(self) -> DataFrame:
        """(epoch, a, b, score) by falling score."""
        found = [r.select(F.lit(k).alias("epoch"), "a", "b", "score") for k, r in enumerate(self.rounds)]
        return reduce(DataFrame.unionByName, found).orderBy("epoch", F.desc("score"), "a", "b")


def learned_on_train(df: DataFrame, learner: PhraseLearner, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """``df`` with phrases merged into its tokens, learned on the rows of split "train" if there is a split, else on all."""
    train = df.where(F.col("split") == "train") if "split" in df.columns else df
    learner.fit(train, id_col, tokens_col)
    return df.drop(tokens_col).join(learner.transform(df, id_col, tokens_col), id_col)
