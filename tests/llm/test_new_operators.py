import base64
import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import importance as im
from cohortlens.llm import packing, queries
from cohortlens.llm import rare_features as rf
from cohortlens.llm import token_alignment as ta
from cohortlens.llm import token_counts
from cohortlens.llm.common import read
from cohortlens.llm.encoding import byte_of_letter

SCHEMA = "doc_id long, text string, n_features int, weight string, score int, fingerprint int, k int, row int, line int, rank int"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (4, "two words"), (5, "one"), (None, "no id here"), (None, None), (6, "a " * 3000), (7, "x" * 20000), (8, "ab"),
    (9, "don't 'S <|endoftext|> </s> <0x41> é́ \xa0 　 日本 １２ \x1c \x85 #%a|b&"), (10, "Zeile eins\nZeile eins\r\n\n| menu | login |\n\tx \n y"), (11, "▁ held by a sign"), (12, "ß" * 60 + "  tail  "),
    (13, "the same line of words over and over again " * 40), (14, " \x00 nul \x00"), (15, "word line  \x0b\x0c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *[7, "w", 7, 7, 7, 7, 7, 7]) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# ---- fingerprints ---------------------------------------------------------------------------------------


def plain_class(window):
    n = len(window)
    whole = lambda c: round(c * math.log2(c) * 65536)
    return 1000 - sum(whole(c) for c in collections.Counter(window).values()) * 1000 // whole(n)


def plain_widths(n):
    top = 4
    while top < 64 and n >= top * 32:
        top *= 2
    return [top] if top == 4 or n >= 2048 else [top, top // 2]


def plain_ranks(texts):
    seen = {w: collections.Counter() for w in rf.WIDTHS}
    for t in texts:
        for w in plain_widths(len(t)):
            seen[w].update(plain_class(t[i : i + w]) for i in range(len(t) - w + 1))
    return {w: {c: k + 1 for k, c in enumerate(sorted(range(1, 1001), key=lambda c: (n[c], -c)))} for w, n in seen.items()}


def plain_fingerprint(t, ranks):
    out = []
    for w in sorted(plain_widths(len(t))):
        rank = [ranks[w].get(plain_class(t[i : i + w]), 0) for i in range(len(t) - w + 1)]
        times = collections.Counter()
        for i in range(1 - w, len(rank)):
            run = [(rank[j], j) for j in range(max(0, i), min(len(rank), i + w)) if rank[j]]
            if run:
                times[min(run)[1]] += 1
        found = list(dict.fromkeys(t[i : i + w] for i in sorted(times) if 4 * times[i] >= w))
        if found:
            out.append(plain_chain(w, found))
    return ";".join(out) if out or not t else plain_chain(0, [t])


def plain_chain(w, features):
    size = 256 if w == 64 else 64
    most, parts = size * 5 // 8, []
    for k in range(0, len(features), most):
        bits = [0] * (size * 8)
        for x in features[k : k + most]:
            for j in range(5):
                bits[(xxhash.xxh64_intdigest(x) >> 12 * j) % (size * 8)] = 1
        parts += [str(len(features[k : k + most])), base64.b64encode(bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))).decode()]
    return f"{w}:" + ".".join(parts)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    sides = [{int(p.split(":")[0]): p.split(":")[1].split(".") for p in x.split(";") if p} for x in (a, b)]
    both = set(sides[0]) & set(sides[1])
    if not both:
        return 0.0
    chains = [[(int(n), int.from_bytes(base64.b64decode(f))) for n, f in zip(x[::2], x[1::2], strict=True)] for x in (s[max(both)] for s in sides)]
    size = 8 * len(base64.b64decode(sides[0][max(both)][1]))
    best = []
    for one, other in (chains, chains[::-1]):
        total = 0
        for n, f in one:
            near = []
            for _, g in other:
                chance = f.bit_count() * g.bit_count() / size
                near.append(min(1, max(0, ((f & g).bit_count() - chance) / max(1e-9, min(f.bit_count(), g.bit_count()) - chance))))
            total += n * max(near)
        best.append((len(one), sum(n for n, _ in one), total / sum(n for n, _ in one)))
    return min(best)[2] if best[0][:2] != best[1][:2] else tuple(x[2] for x in best)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(r[1].encode(), 42))))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_fingerprints_follow_the_plain_version(spark, sf_dir, odd, which):
    docs = odd if which == "odd" else read(spark, sf_dir, "documents").where("length(text) < 3000")
    rows = in_order(held(docs))
    ranks = plain_ranks([t.encode() for _, t in rows])
    want = collections.Counter()
    prints = {t: plain_fingerprint(t.encode(), ranks) for _, t in rows}
    near = {}
    for (doc, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        edited = plain_fingerprint(new.encode(), ranks)
        key = (doc, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[t], edited)
        want[key] += 1
        near[key] = plain_likeness(prints[t], edited), plain_likeness(prints[t], prints[after])
    found = rf.edit_likeness(docs, rf.rarity(docs)).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in found) == want
    for r in found:
        for got, plain in zip((r.near_edited, r.near_next), near[r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint], strict=True):
            assert any(abs(got - p) < 1e-9 for p in (plain if isinstance(plain, tuple) else (plain,)))


def test_long_texts_are_whole_at_every_stretch(monkeypatch, spark, sf_dir):
    texts = [(r.text or "").encode() for r in read(spark, sf_dir, "documents").orderBy("doc_id").limit(40).collect()]
    ranks = {w: rf.rarity(spark.createDataFrame([(t.decode(),) for t in texts], "text string")).ranks[w] for w in rf.WIDTHS}
    whole = [rf.selected(texts, w, ranks[w]) for w in rf.WIDTHS]
    monkeypatch.setattr(rf, "_CHUNK", 700)
    assert [rf.selected(texts, w, ranks[w]) for w in rf.WIDTHS] == whole


def test_fingerprints_of_few_and_no_rows(spark, empty):
    rarity = rf.rarity(empty)
    assert rf.edit_likeness(empty, rarity).collect() == []
    lone = spark.createDataFrame([(3, "a single text that follows itself in the order")], "doc_id long, text string")
    (row,) = rf.edit_likeness(lone, rarity).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a single text that follows itself i" b"a single te").hexdigest()


def test_likeness_of_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    prints = rf.fingerprints(docs, rf.rarity(docs))
    pairs = prints.alias("a").join(prints.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select("a.doc_id", "a.fingerprint", F.col("b.fingerprint").alias("other_fingerprint"))
    near = {r.doc_id: r.likeness for r in rf.compared(pairs, into="likeness").collect()}
    whole = {r.doc_id: r.near_next for r in rf.edit_likeness(docs, rf.rarity(docs)).collect()}
    assert near and all(near[d] == whole[d] for d in near)


def test_edited_texts_are_nearer_than_others(spark, sf_dir):
    rows = [r for r in queries.queries()["op11_document_fingerprints"](spark, sf_dir).collect() if r.n_chars >= 64]
    assert sum(r.near_edited > 0.5 for r in rows) > 0.99 * len(rows) and sum(r.near_next < 0.4 or r.near_next == 1 for r in rows) > 0.97 * len(rows)


# ---- importance resampling ------------------------------------------------------------------------------


def plain_features(t, n=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent, n, buckets, seed, least):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in plain_features(x, n)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc, x in rows:
        words, features = plain_features(x, n)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    draw = len(order) * percent // 100
    return collections.Counter([(*r[:4], k + 1) for k, r in enumerate(order[:draw])] + [(*r[:4], None) for r in order[draw:]] + [(*r[:4], None) for r in out if not r[4]])


@pytest.mark.parametrize(("which", "args"), [("table", (25, 2, 10_000, 7, 20)), ("odd", (60, 3, 50, 1, 1)), ("repeated", (50, 1, 100, 7, 2))])
def test_resampling_follows_the_plain_version(spark, sf_dir, odd, which, args):
    docs = {"table": lambda: read(spark, sf_dir, "documents"), "odd": lambda: odd, "repeated": lambda: odd.union(odd).union(spark.createDataFrame([(20, "Same row here")] * 30, "doc_id long, text string").selectExpr("*", *[f"null as x{i}" for i in range(8)]))}[which]()
    target = read(spark, sf_dir, "benchmark")
    percent, n, buckets, seed, least = args
    found = im.resample(docs, target, percent, n, buckets, seed, least)
    rows = found.collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == plain_resample(held(docs), [r.text or "" for r in target.collect()], *args)
    assert all(t == "bigint" for _, t in found.dtypes)
    kept = im.drawn(docs, found)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r["rank"] and r.doc_id is not None}


def test_lines_are_counted_once_and_runs_across_them_apart(spark):
    rows = [("the Cat\nsat on\n\nthe mat",), ("the cat\r\nsat ON\nthe mat",), (None,), ("",), ("\n\n",), ("ünder\nß 1２",)]
    want = collections.Counter(zlib.crc32(f.encode()) % 997 for (t,) in rows for f in plain_features(t or "", 4)[1])
    assert {b: n for b, n in enumerate(im.bucket_counts(spark.createDataFrame(rows, "text string"), 4, 997).tolist()) if n} == want


def test_crc_of_joined_strings():
    import numpy as np

    tails = [b"", b"x", b" word", b"\x00" * 70, b"y" * 100_001]
    got = im.shifted(np.full(len(tails), zlib.crc32(b"head"), np.uint32), np.array(list(map(len, tails)))) ^ np.array(list(map(zlib.crc32, tails)), np.uint32)
    assert got.tolist() == [zlib.crc32(b"head" + t) for t in tails]


def test_resampling_of_no_rows(spark, sf_dir, empty):
    assert im.resample(empty, read(spark, sf_dir, "benchmark")).collect() == [] and im.resample(empty, empty).collect() == []
    docs = read(spark, sf_dir, "documents").limit(5)
    assert len(im.resample(docs, empty).collect()) == 5
    assert len(im.Words(pa.array([], pa.string())).alone) == 0


# ---- two tokenizers -------------------------------------------------------------------------------------


def plain_alignment(rows):
    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    byte = byte_of_letter()
    of_a = lambda i: bytes(byte[c] for c in a_side.id_to_token(i))
    of_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for doc, text in rows:
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids if text else [], b_side.encode(text) if text else []
        if not text or not (b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == (" " + text).encode()):
            out.append((doc, 0, 0, [], []))
            continue
        ends = []
        for ids, of in ((a, of_a), (b, of_b)):
            n, e = 0, []
            for i in ids:
                n += len(of(i))
                e.append(n)
            ends.append(e)
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        out.append((doc, len(a), len(b), groups, links))
    count = collections.Counter(x for r in out for x in r[4])
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return collections.Counter((d, a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, x in out)


@pytest.mark.parametrize("frequent", [ta.FREQUENT, 20, 0])
@pytest.mark.parametrize("which", ["odd", "table"])
def test_alignment_follows_the_plain_version(spark, sf_dir, odd, which, frequent):
    docs = odd if which == "odd" else read(spark, sf_dir, "documents")
    rows = held(docs)
    found = ta.alignment(docs, BYTES, PIECES, frequent=frequent)
    got = collections.Counter(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == plain_alignment(rows)
    if which == "odd":  # a held sign is read as a space, so its text gives no tokens
        assert (11, 0, 0, 0, 0, 0, 0, "") in got


def test_units_keep_nothing_that_changes_results(monkeypatch, spark):
    texts = [f"text {i} with its own words {i * 7919} and <|endoftext|>\n\tlines\n {i} x\ny " for i in range(200)]
    units = ta.Units(BYTES, PIECES)
    whole = [[units.groups[k] for k in units.of([t])[0]] for t in texts]
    monkeypatch.setattr(ta, "_ROOM", 500)
    small = ta.Units(BYTES, PIECES)
    assert [[small.groups[k] for k in small.of([t])[0]] for t in texts] == whole
    monkeypatch.setattr(small, "parts", False)
    small.clear()
    assert [";".join(small.groups[k] for k in small.of([t])[0]) for t in texts] == [";".join(g) for g in whole]


def test_successors_of_long_chains():
    import numpy as np

    ends_a, ends_b = np.arange(2, 4001, 2), np.append(np.arange(1, 4000, 2), 4000)  # each token overlaps the next one of the other side
    assert set(ta.successors(ends_a, ends_b).tolist()) == {len(ends_a) + len(ends_b) - 1}


def test_alignment_of_no_rows_and_kept_groups(spark, empty):
    assert ta.alignment(empty, BYTES, PIECES).collect() == []
    (row,) = ta.aligned(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), BYTES, PIECES, keep_groups=True).collect()
    assert row.groups and hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and sum(row.times) == row.n_links


def test_long_texts(spark):
    long = spark.createDataFrame([(1, "many words of a long text " * 60_000), (2, "y" * 300_000), (3, "\n" * 200_000)], "doc_id long, text string")
    assert len(rf.edit_likeness(long, rf.rarity(long)).collect()) == 3
    assert len(im.resample(long, long).collect()) == 3
    assert {r.doc_id: r.n_groups > 0 for r in ta.alignment(long, BYTES, PIECES).collect()} == {1: True, 2: True, 3: True}


# ---- token counts ---------------------------------------------------------------------------------------


def test_an_entry_held_twice_counts_once_and_texts_of_megabytes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text here"), (2, "some text here"), (3, "long words of a text " * 100_000), (4, None)], "doc_id long, text string")
    cache = f"{tmp_path}/cache"
    once = sorted(map(tuple, token_counts.cached_counts(docs, BYTES, cache).collect()))
    spark.read.parquet(cache).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(cache)
    assert sorted(map(tuple, token_counts.cached_counts(docs, BYTES, cache).collect())) == once and len(once) == 4
    assert {r[0]: r[2] for r in once} == {i: len(Tokenizer.from_file(BYTES).encode(t or "").ids) for i, t in [(r.doc_id, r.text) for r in docs.collect()]}


# ---- packing --------------------------------------------------------------------------------------------


def test_several_sizes_open_and_cost_less_than_one_rule(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    bins = {r.bin_id: r for r in packing.pack(docs).collect()}.values()
    assert len({r.opened_size for r in bins}) >= 3
    ours = sum(packing.attention_cost(r.bin_size) for r in bins)
    lengths = [(r.piece_len) for r in packing.pack(docs).collect()]

    def by_rule(size_of):
        room, fill = [], []
        for n in sorted(lengths, reverse=True):
            fits = [(r, b) for b, r in enumerate(room) if r >= n]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(size_of(n))
                fill.append(0)
            room[b] -= n
            fill[b] += n
        return sum(packing.attention_cost(next(c for c in packing.SIZES if c >= f)) for f in fill)

    assert ours < by_rule(lambda n: next(c for c in packing.SIZES if c >= n)) and ours < by_rule(lambda n: packing.SIZES[-1])
