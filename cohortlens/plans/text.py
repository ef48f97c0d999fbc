"""Queries on text: search, windows, normalisation, tokens and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators import search as se
from cohortlens.operators import tokens as tk
from cohortlens.operators.features import anchor_mask, label_ids, select_groups
from cohortlens.operators.lexicon import CLINICAL, DEMO, lexicon_df, recover_category, show_categories
from cohortlens.plans.common import table
from cohortlens.sources.shared import shared_dir, stored
from cohortlens.streaming.search import read_texts, stream_search


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "document_id")


def anchor_spans(spark: SparkSession, d: str) -> DataFrame:
    return se.find_hits(_docs(spark, d).select("document_id", "text"), DEMO).drop("text")


def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return se.keyword_counts(_docs(spark, d), DEMO)


def doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    return se.coverage(_docs(spark, d), {"a": ["this", "are"], "b": ["with"]})


def search_windows(spark: SparkSession, d: str) -> DataFrame:
    return se.search(_docs(spark, d), {"conj": DEMO["conj"]}, 5)


def corpus_windows(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("encounter_note_id"), F.col("text").alias("note_text"))
    return se.search_corpus(notes, {"cop": DEMO["cop"]}, 3)


def clinical_search(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i % 9 == 4, F.concat(w, F.lit(" not compliant"))).otherwise(w))
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("document_id"), F.array_join(words, " ").alias("text"))
    found = se.search(turns, CLINICAL, 2)
    return se.match_counts(se.with_negation(found)).withColumn("negated", F.lit(True))


def category_filter(spark: SparkSession, d: str) -> DataFrame:
    found = se.search(_docs(spark, d), {"cop": DEMO["cop"]}, 2)  # categories are found independently, so the others aren't searched
    return se.format_for_model(found, "cop").groupBy("keyword").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_docs"))


def negated_keyword(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit(" the "), F.lit(" not the ")).alias("text"), F.lit("the").alias("keyword"))
    return se.with_negation(turns).select("conv_id", "turn", "keyword_negated")


def keyword_removal(spark: SparkSession, d: str) -> DataFrame:
    left, unknown = se.remove_keywords(se.find_hits(_docs(spark, d), DEMO), ["the", "was", "absent"])
    return left.groupBy("keyword").agg(F.count("*").alias("n")).withColumn("unknown", F.lit(", ".join(unknown)))


def excluded_keywords(spark: SparkSession, d: str) -> DataFrame:
    return se.exclude_keywords(se.find_hits(_docs(spark, d), DEMO), ["of", "and"]).groupBy("keyword_category", "keyword").agg(F.count("*").alias("n"))


def augment_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("document_id").alias("encounter_note_id"), "text")
    hits = se.find_hits(docs, {"det": DEMO["det"]}).drop("text")
    first = hits.groupBy("encounter_note_id").agg(F.min_by(F.struct("keyword_category", "keyword", "start", "end"), F.col("start")).alias("h")).select("encounter_note_id", "h.*")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("encounter_note_id"), F.col("quality").alias("label"), F.lit("x").alias("annotator_a")).join(first, "encounter_note_id")
    return se.augment_labels(hits, labels.withColumn("end", F.when(F.col("encounter_note_id") % 2 == 0, F.col("end")).otherwise(-1)))


def rewindowed(spark: SparkSession, d: str) -> DataFrame:
    hits = se.find_hits(table(spark, d, "conversations").withColumnRenamed("text", "full"), {"cop": DEMO["cop"]}, "full")
    return se.rewindow(hits, "full", 2).select("conv_id", "turn", "start", "note_text")


def lexicon_categories(spark: SparkSession, d: str) -> DataFrame:
    counted = stored(se.keyword_counts(_docs(spark, d), DEMO).drop("keyword_category"), "keyword-counts")  # a row per keyword, read twice
    hits = recover_category(counted, DEMO)
    shown = show_categories(spark, DEMO).select("keyword_category", F.array_join("keywords", ", ").alias("keywords"))
    return hits.groupBy("keyword_category").agg(F.sum("n").alias("n")).join(shown, "keyword_category")


def annotated_only(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("encounter_note_id"), F.col("text").alias("note_text"))
    only = table(spark, d, "labels").select(F.col("doc_id").alias("encounter_note_id"))
    return se.search_corpus(notes, {"conj": DEMO["conj"]}, 2, only=only).groupBy("keyword").agg(F.count("*").alias("n"), F.count_distinct("encounter_note_id").alias("n_notes"))


_DIRTY = "concat('x=', replace(text, ' the ', ' &gt; the '), '\t''tail&amp;end''   ### invalid font number 12  ', chr(8226))"


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.concat(F.lit("x="), F.replace("text", F.lit(" the "), F.lit(" &gt; the ")), F.lit("\t'tail&amp;end'   ### invalid font number 12  •"))).alias("clean"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.normalize_text(F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("t")).alias("text"))


def strip_operators(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tx.strip_operators(F.concat(F.lit("-+= "), "text")).alias("text"))


def transliterate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.to_ascii(F.col("text")).alias("ascii"))


def swap_identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" she saw her husband ")), F.lit(" of "), F.lit(" Mr. Smith, a man himself, "))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.swap_identifiers(text).alias("text"))


def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.title_case(F.concat_ws("-", "p_name", F.upper("p_type"))).alias("title"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _simple(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))


_SIMPLE = "t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as tokens from documents)"
_FLAT = "f as (select doc_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos from t)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.array_join(tk.tokenize(F.col("text"), numbers="replace", negation=False), " ").alias("tokens"))


def negation_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _simple(spark, d).select("doc_id", F.transform("tokens", lambda x: F.when(x == "the", "not").otherwise(x)).alias("tokens"))
    return t.select("doc_id", F.array_join(tk.add_negation(F.col("tokens")), " ").alias("tokens"))


def removed_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", tx.remove_keyword(F.replace("text", F.lit(" of "), F.lit(" not of ")), F.lit("of")).alias("text"))


def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return tk.frequent_ngrams(_simple(spark, d), "tokens", 3, 3)


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return tk.vocabulary(_simple(spark, d), rm_top=10, min_freq=3, max_freq=500, stopwords=["with", "by"])


def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return tk.cooccurrence(_simple(spark, d), left=1, right=2).where("n >= 2")


def phrase_scores(spark: SparkSession, d: str) -> DataFrame:
    return tk.phrase_scores(_simple(spark, d), min_count=2, threshold=5.0).withColumn("score", F.round("score", 6))


def phrase_merge(spark: SparkSession, d: str) -> DataFrame:
    t = stored(_simple(spark, d), "tokens")  # read three times
    found = stored(tk.cooccurrence(t).where("n >= 20").select("a", "b"), "phrases")  # read four times
    return tk.merge_phrases(t, found, "doc_id").select("doc_id", F.array_join("tokens", "|").alias("tokens"))


def phrase_rounds(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    learner = tk.PhraseLearner(2, 5, 10.0).fit(words, "doc_id")
    return learner.phrases()


def masks(spark: SparkSession, d: str) -> DataFrame:
    t = _simple(spark, d).withColumn("keyword", F.array(F.lit("of"), F.lit("the")))
    count = lambda mode: F.size(F.filter(anchor_mask(F.col("tokens"), F.col("keyword"), mode), lambda x: x)).alias(mode)
    best = F.array_position(anchor_mask(F.col("tokens"), F.col("keyword"), "keyword"), True).cast("int").alias("at")
    return t.select("doc_id", count("all"), count("cls"), count("keyword_all"), best)


def grouped_hits(spark: SparkSession, d: str) -> DataFrame:
    groups = select_groups(["det"], {"det": [["the", "a"], ["of"]]})
    rows = [("det", k, w) for k, g in enumerate(groups["det"]) for w in g]
    held = spark.createDataFrame(rows, "keyword_category string, group_id int, keyword string")
    return se.find_hits(_docs(spark, d), DEMO).join(F.broadcast(held), ["keyword_category", "keyword"]).groupBy("keyword_category", "group_id").agg(F.count("*").alias("n"))


def ids_of_labels(spark: SparkSession, d: str) -> DataFrame:
    return label_ids(se.find_hits(_docs(spark, d), DEMO), "keyword_category", "keyword")


def lexicon_ranks(spark: SparkSession, d: str) -> DataFrame:
    hits = se.lexicon_join(se.find_hits(_docs(spark, d).drop("n_chars"), DEMO), DEMO)
    return hits.groupBy("keyword_category", "ord").agg(F.count("*").alias("n")).join(lexicon_df(spark, DEMO), ["keyword_category", "ord"])


def stream_search_hits(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from pyspark.sql.functions import col

    batch = table(spark, d, "conversations")
    stream = read_texts(spark, f"{d}/{{conversations.parquet}}", batch.schema)  # a pattern, so that a file and a folder of files both serve
    found = stream_search(stream.withColumn("document_id", col("conv_id")), {"cop": DEMO["cop"]}, 3)
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    from cohortlens.streaming.search import run_available

    return run_available(found, f"{where}/rows", f"{where}/progress").groupBy("keyword_category", "keyword").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def _spans_sql(categories: dict[str, list[str]], source: str = "select doc_id as document_id, text from documents", key: str = "document_id") -> str:
    """CTEs ending in hits(key, keyword_category, start, end, keyword, text)."""
    parts = []
    for c, words in categories.items():
        p = "(?i)" + "|".join(rf"\b{w}\b" for w in words)
        parts.append(f"select *, '{c}' as keyword_category, regexp_extract_all(text, '{p}') as h, regexp_split_to_array(text, '{p}') as g from src")
    return f"""src as ({source}), parts as ({" union all ".join(parts)}),
    hits as (select * exclude (h, g, i), lower(h[i]) as keyword,
      cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as int) as "start",
      cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i], lambda x: length(x))), 0) as int) as "end"
      from (select *, unnest(generate_series(1, len(h))) as i from parts))"""


def _window_sql(size: int, text: str = "text") -> str:
    """CTE windows, of hits with the column w."""
    strip = r"'^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g'"
    return f"""w1 as (select *, "start" - length(regexp_extract(substr({text}, 1, "start"), '[^ ]*$')) as a,
      greatest("end", least("end" + case when strpos(substr({text}, "end" + 1), ' ') > 0 then strpos(substr({text}, "end" + 1), ' ') - 1 else length({text}) end, length({text}) - 1)) as b from hits),
    w2 as (select *, string_split(regexp_replace(substr({text}, 1, a), {strip}), ' ') as l, string_split(regexp_replace(substr({text}, a + 1, b - a), {strip}), ' ') as m, string_split(regexp_replace(substr({text}, b + 1), {strip}), ' ') as r from w1),
    windows as (select * exclude (l, m, r, a, b), array_to_string(list_concat(list_concat(l[greatest(len(l) - {size} + 1, 1):], m), r[1:{size}]), ' ') as w from w2)"""


def _ascii_sql(x: str) -> str:
    return f"regexp_replace(strip_accents(replace({x}, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')"


def _clean_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '[\t\r\n]', '   ', 'g')"
    for old, new in (("chr(160) || ' '", "' '"), ("''''", "'\"'"), ("'&gt;'", "'>'"), ("'&lt;'", "'<'"), ("'&amp;'", "' and '"), ("'&#x20;'", "' '"), ("'   '", "chr(10)"), ("chr(8226)", "chr(9)")):
        x = f"replace({x}, {old}, {new})"
    x = rf"regexp_replace(regexp_replace({x}, '[\x1d\x{{a0}}\x1c\x14]', ' ', 'g'), '### invalid font number [0-9]+', ' ', 'g')"
    return _ascii_sql(f"regexp_replace({x}, ' +', ' ', 'g')")


def _norm_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[\s\x1c-\x1f]+', ' ', 'g'), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


_ALL = _spans_sql(DEMO)
_TURNS = "select concat_ws('-', conv_id, turn) as encounter_note_id, {} as text from conversations"

SQL = {
    "anchor_spans": f'with {_ALL} select document_id, keyword_category, "start", "end", keyword from hits',
    "match_stats": f"with {_ALL} select keyword_category, keyword, count(*) as n from hits group by all",
    "doc_coverage": r"select count(*) as n_documents, count(*) filter (regexp_matches(text, '(?i)\bthis\b|\bare\b|\bwith\b')) as n_matched from documents",
    "search_windows": f'with {_spans_sql({"conj": DEMO["conj"]})}, {_window_sql(5)} select document_id, keyword_category, "start", "end", keyword, {_norm_sql(_clean_sql("w"))} as text from windows',
    "corpus_windows": f'with {_spans_sql({"cop": DEMO["cop"]}, _TURNS.format(_norm_sql(_clean_sql("text"))))}, {_window_sql(3)} select encounter_note_id, w as note_text, keyword_category, "start", "end", keyword from windows',
    "clinical_search": "select 'compliance' as keyword_category, 'compliant' as keyword, sum((len(string_split(text, ' ')) + 4) // 9)::bigint as n, true as negated from conversations",
    "category_filter": f"with {_ALL} select keyword, count(*) as n, count(distinct document_id) as n_docs from hits where keyword_category = 'cop' group by all",
    "negated_keyword": r"select conv_id, turn, coalesce(nullif(regexp_extract(replace(text, ' the ', ' not the '), '(?i)(cannot|not|\w*n''t)(\s)?\bthe\b', 0), ''), 'the') as keyword_negated from conversations",
    "keyword_removal": f"with {_ALL} select keyword, count(*) as n, 'absent' as unknown from hits where keyword not in ('the', 'was') group by all",
    "excluded_keywords": f"with {_ALL} select keyword_category, keyword, count(*) as n from hits where keyword not in ('of', 'and') group by all",
    "augment_labels": f'with {_spans_sql({"det": DEMO["det"]}, "select doc_id as encounter_note_id, text from documents")}, l as (select encounter_note_id, keyword_category, keyword, "start", case when encounter_note_id % 2 = 0 then "end" else -1 end as "end" from (select *, row_number() over (partition by encounter_note_id order by "start") as k from hits) where k = 1) select l.*, quality as label from l join labels on doc_id = encounter_note_id',
    "rewindowed": f'with {_spans_sql({"cop": DEMO["cop"]}, "select conv_id, turn, text from conversations")}, {_window_sql(2)} select conv_id, turn, "start", {_norm_sql(_clean_sql("w"))} as note_text from windows',
    "lexicon_categories": f"with {_ALL} select keyword_category, count(*) as n, any_value(case keyword_category {' '.join(f'''when '{c}' then '{', '.join(ws)}' ''' for c, ws in DEMO.items())} end) as keywords from hits group by 1",
    "annotated_only": f"with {_spans_sql({'conj': DEMO['conj']}, 'select doc_id, ' + _norm_sql(_clean_sql('text')) + ' as text from documents where doc_id in (select doc_id from labels)')} select keyword, count(*) as n, count(distinct doc_id) as n_notes from hits group by all",
    "clean_text": f"select doc_id, {_clean_sql(_DIRTY.replace(chr(9), chr(9)))} as clean from documents",
    "normalize_text": f"select doc_id, {_norm_sql('''concat(' ', chr(9), text, chr(10), ' ')''')} as text from documents",
    "strip_operators": r"select conv_id, turn, regexp_replace(regexp_replace(concat('-+= ', text), '^[-+*/=]+', ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') as text from conversations",
    "transliterate": f"select doc_id, {_ascii_sql('text')} as ascii from documents",
    "title_case": "select p_partkey, array_to_string(list_transform(regexp_extract_all(concat_ws('-', p_name, upper(p_type)), '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') as title from part",
    "tokens": r"select doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]'), lambda x: not regexp_full_match(x, '[!-/:-@\[-`{-~]*')), lambda x: case when regexp_matches(x, '[0-9]') then '<NUM>' else x end), ' ') as tokens from documents",
    "negation_tokens": f"with {_SIMPLE}, {_FLAT}, n as (select *, lag(token) over (partition by doc_id order by pos) as before from f) select doc_id, coalesce(string_agg(case when before = 'the' then 'not_' || token else token end, ' ' order by pos) filter (token <> 'the'), '') as tokens from n group by doc_id union all select doc_id, '' from t where len(tokens) = 0",
    "removed_keyword": r"select doc_id, regexp_replace(replace(text, ' of ', ' not of '), '(cannot|not|\w*n''t)?(\s)?\bof\b', '', 'g') as text from documents",
    "ngrams": f"with {_SIMPLE}, {_FLAT} select concat_ws(' ', token, b, c) as gram, count(*) as n from (select token, lead(token) over w as b, lead(token, 2) over w as c from f window w as (partition by doc_id order by pos)) where c is not null group by 1 having count(*) >= 3",
    "vocabulary": f"with {_SIMPLE}, {_FLAT}, c as (select token, count(*) as n from f group by 1), r as (select *, row_number() over (order by n desc, token) as k from c) select token, n, row_number() over (order by n desc, token) - 1 as index from r where k > 10 and n between 3 and 500 and token not in ('with', 'by')",
    "cooccurrence": f"with {_SIMPLE}, {_FLAT} select x.token as a, y.token as b, count(*) as n from f x join f y on x.doc_id = y.doc_id and y.pos - x.pos in (-1, 1, 2) group by 1, 2 having count(*) >= 2",
    "phrase_scores": f"with {_SIMPLE}, {_FLAT}, c as (select token, count(*) as n from f group by 1), p as (select token as a, lead(token) over (partition by doc_id order by pos) as b from f), q as (select a, b, count(*) as n from p where b is not null group by 1, 2 having count(*) > 2) select a, b, q.n, round((q.n - 2) * (select count(*) from c)::double / (x.n * y.n), 6) as score from q join c x on a = x.token join c y on b = y.token where (q.n - 2) * (select count(*) from c)::double / (x.n * y.n) > 5",
    "phrase_merge": f"""with {_SIMPLE}, {_FLAT}, p as (select *, lead(token) over (partition by doc_id order by pos) as b from f), q as (select token, b from p where b is not null group by 1, 2 having count(*) >= 20),
      m as (select p.*, q.token is not null as hit from p left join q on p.token = q.token and p.b = q.b), r as (select *, sum(case when hit then 0 else 1 end) over (partition by doc_id order by pos) as run from m),
      s as (select *, hit and row_number() over (partition by doc_id, run, hit order by pos) % 2 = 1 as starts from r), u as (select *, coalesce(lag(starts) over (partition by doc_id order by pos), false) as gone from s)
      select t.doc_id, coalesce(string_agg(case when starts then token || ' ' || b else token end, '|' order by pos) filter (not gone), '') as tokens from t left join u on t.doc_id = u.doc_id group by t.doc_id""",
    "grouped_hits": f"with {_ALL} select keyword_category, cast(keyword = 'of' as int) as group_id, count(*) as n from hits where keyword_category = 'det' group by all",
    "ids_of_labels": f"with {_ALL}, k as (select distinct keyword_category as task, keyword as label from hits) select task, label, (dense_rank() over (order by task) - 1)::int as task_id, (dense_rank() over (partition by task order by label) - 1)::int as label_id from k",
    "lexicon_ranks": f"with {_ALL} select keyword_category, (case keyword {' '.join(f'''when '{w}' then {i} ''' for ws in DEMO.values() for i, w in enumerate(ws))} end)::int as ord, count(*) as n, keyword from hits group by all",
    "anchor_masks": f"with {_SIMPLE}, {_FLAT}, s as (select doc_id, pos from (select *, lead(token) over (partition by doc_id order by pos) as b from f) where token = 'of' and b = 'the'), x as (select doc_id, len(tokens) as n, floor(len(tokens) / 2) as mid from t) select x.doc_id, n::int as \"all\", least(n, 1)::int as cls, (2 * count(pos))::int as keyword_all, coalesce(arg_min(pos, struct_pack(d := abs(pos - 1 - mid), p := pos)), 0)::int as at from x left join s on x.doc_id = s.doc_id group by x.doc_id, n, mid",
    "stream_search": f'with {_spans_sql({"cop": DEMO["cop"]}, "select conv_id, text from conversations")} select keyword_category, keyword, count(*) as n, sum("start")::bigint as starts from hits group by all',
}
_SWAP = r"replace(replace(text, ' the ', ' she saw her husband '), ' of ', ' Mr. Smith, a man himself, ')"
for _new, _old in tx.IDENTIFIERS:
    _SWAP = rf"regexp_replace({_SWAP}, '(?i)\b(?:{_old})\b', '{_new}', 'g')"
SQL["swap_identifiers"] = f"select conv_id, turn, {_SWAP} as text from conversations"

QUERIES = {f.__name__: f for f in (anchor_spans, match_stats, doc_coverage, search_windows, corpus_windows, clinical_search, category_filter, negated_keyword, keyword_removal, excluded_keywords, augment_labels, rewindowed, lexicon_categories, annotated_only, clean_text, normalize_text, strip_operators, transliterate, swap_identifiers, title_case, tokens, negation_tokens, removed_keyword, ngrams, vocabulary, cooccurrence, phrase_scores, phrase_merge, phrase_rounds, grouped_hits, ids_of_labels, lexicon_ranks)} | {"anchor_masks": masks, "stream_search": stream_search_hits}
