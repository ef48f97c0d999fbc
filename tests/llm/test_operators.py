import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import decontamination as dc
from cohortlens.llm import near_duplicates as nd
from cohortlens.llm import packing, page_text, queries, repeated_passages, sharding, token_counts, token_files, toxicity
from cohortlens.llm import quality as ql
from cohortlens.llm.common import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "no id here"), (None, None), (6, "a " * 3000), (7, "x" * 20000),
    (8, "don't 'S <|endoftext|> é́ \xa0 　 日本 １２ \x1c \x85 #%a|b&"), (9, "Zeile eins\nZeile eins\n\n| menu | login |"), (10, "ß" * 60 + " tail"), (11, "the same line of words over and over again " * 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, 0) for i, t in ODD]
    clash = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "shard", "n_bytes", "fp", "key", "k", "bucket", "size", "digest", "spans", "predicted"):
        clash = clash.withColumn(c, F.lit(7))
    return clash


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def texts(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


# ---- packing --------------------------------------------------------------------------------------------


def plain_best_fit(lengths, sizes, opens):
    fill, room, opened = [], [], []
    for k, n in enumerate(lengths):
        fits = [(r, -b) for b, r in enumerate(room) if r >= n]
        if fits:
            least = min(r for r, _ in fits)
            b = max(b for b, r in enumerate(room) if r == least)
        else:
            b = len(room)
            opened.append(opens(n, lengths[k + 1 :], sizes))
            room.append(opened[-1])
            fill.append(0)
        room[b] -= n
        fill[b] += n
    return fill, opened


def cheapest(n, later, sizes):
    return min((packing.bin_cost(c) / max(1, n + min(c - n, sum(x for x in later if x <= c - n))), c) for c in sizes if c >= n)[1]


def smallest(n, later, sizes):
    return min(c for c in sizes if c >= n)


def shrunk(fill, sizes):
    return [min(c for c in sizes if c >= f) for f in fill]


def test_packing_fills_like_a_plain_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted((rng.randint(0, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        _, caps, fill, opened = packing.pack_lengths(lengths, (16, 32, 64))
        want, at = plain_best_fit(lengths, (16, 32, 64), cheapest)
        assert sorted(zip(fill, opened, strict=True)) == sorted(zip(want, at, strict=True))
        assert caps == shrunk(fill, (16, 32, 64))


def test_bins_open_larger_than_needed_shrink_and_cost_less(docs):
    lengths = sorted((min(4096, len(t.split()) + 1) for _, t in texts(docs)), reverse=True)
    _, caps, fill, opened = packing.pack_lengths(lengths)
    first = {}
    for n, b in zip(lengths, packing.pack_lengths(lengths)[0], strict=True):
        first.setdefault(b, n)
    assert any(opened[b] > smallest(n, (), packing.SIZES) for b, n in first.items())
    plain = shrunk(plain_best_fit(lengths, packing.SIZES, smallest)[0], packing.SIZES)
    assert sum(map(packing.bin_cost, caps)) < sum(map(packing.bin_cost, plain))
    # the shorter long item opens a large bin for the short ones, which then fill what the others left
    _, caps, fill, opened = packing.pack_lengths([3000] * 3 + [2000] + [90] * 24)
    assert any(c < o for c, o in zip(caps, opened, strict=True)) and sum(fill) == 11000 + 24 * 90


def test_packing_keeps_every_token_once(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = packing.pack(df, group_rows=70).collect()
        want = defaultdict(int)
        for i, t in texts(df):
            want[i] += len(re.findall(rb"[^\x20\x09-\x0D]+", t)) + 1
        got, bins = defaultdict(int), defaultdict(list)
        for r in rows:
            got[r.doc_id] += r.piece_len
            bins[r.bin_id].append(r)
        assert got == want
        for rs in bins.values():
            rs.sort(key=lambda r: r.bin_pos)
            assert [r.bin_start for r in rs] == [sum(x.piece_len for x in rs[:k]) for k in range(len(rs))]
            assert {r.bin_fill for r in rs} == {sum(r.piece_len for r in rs)} and rs[0].bin_size == min(c for c in packing.SIZES if c >= rs[0].bin_fill)
    assert packing.pack(empty).count() == 0


# ---- tokens ---------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, docs, odd, empty):
    t = Tokenizer.from_file(BYTES)
    for df in (docs, odd):
        got = sorted(map(tuple, token_counts.cached_counts(df, BYTES).collect()), key=str)
        n = {x: len(t.encode(x.decode(), add_special_tokens=False).ids) for _, x in texts(df)}
        assert got == sorted(((i, len(x), n[x], n[x] > 512) for i, x in texts(df)), key=str)
    assert token_counts.cached_counts(empty, BYTES).count() == 0


def test_cache_encodes_misses_only_and_keeps_versions_apart(spark, docs, tmp_path):
    path = f"{tmp_path}/cache"
    token_counts.cached_counts(docs.limit(40), BYTES, path).count()
    first = spark.read.parquet(path).count()
    a = token_counts.cached_counts(docs, BYTES, path).collect()
    assert spark.read.parquet(path).count() == docs.select("text").distinct().count() > first
    token_counts.cached_counts(docs, BYTES, path).count()
    assert spark.read.parquet(path).count() == docs.select("text").distinct().count()
    b = token_counts.cached_counts(docs, WORDS, path).collect()
    assert spark.read.parquet(path).count() == 2 * docs.select("text").distinct().count()
    assert {r.doc_id: r.n_tokens for r in a} != {r.doc_id: r.n_tokens for r in b}


def test_number_code_round_trip():
    rng = np.random.RandomState(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32) >> rng.randint(0, 32, n).astype(np.uint32)
        control, data = token_files.encode_numbers(x)
        assert (token_files.decode_numbers(control, data, n) == x).all() and len(control) == -(-n // 4)


def test_token_files_give_back_the_library_ids(spark, docs, odd, empty):
    t = Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        rows = token_files.read_ids(spark, token_files.write_ids(df, WORDS, block_ids=500)).collect()
        ids = {x: [*t.encode(x.decode(), add_special_tokens=False).ids, 1] for _, x in texts(df)}
        plain = sorted(((-1 if i is None else i, len(ids[x]), zlib.crc32(np.array(ids[x], "<u4").tobytes())) for i, x in texts(df)), key=lambda r: r[0])
        got = sorted(rows, key=lambda r: r.start)
        assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _, _ in plain]
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(plain)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert token_files.read_ids(spark, token_files.write_ids(empty, WORDS)).count() == 0


# ---- sharding -------------------------------------------------------------------------------------------


def plain_shard(i, tree):
    def draw(children):
        u = lambda name: ((xxhash.xxh64_intdigest(f"{name}|{'null' if i is None else i}".encode(), 42) >> 12) + 0.5) / 2.0**52
        return min((-math.log(u(n)) / w, n) for n, w in children.items())[1]

    g = draw({g: sum(w for ss in rs.values() for w in ss.values()) for g, rs in tree.items()})
    r = draw({f"{g}/{r}": sum(ss.values()) for r, ss in tree[g].items()}).split("/")[1]
    return int(draw({f"{g}/{r}/{s}": w for s, w in tree[g][r].items()}).split("/")[2])


def test_shards_equal_plain_draws_and_growth_moves_rows_to_the_new_one(spark, docs, odd, empty):
    small, large = sharding.even_tree(24), sharding.even_tree(25)
    for df in (docs, odd):
        rows = sharding.assign_shards(df, small, large, buckets=8).collect()
        assert len(rows) == df.count()
        crc = defaultdict(set)
        for i, t in texts(df):
            crc[i].add((len(t) + 8, zlib.crc32(t)))
        slots = defaultdict(list)
        for r in rows:
            assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, small), plain_shard(r.doc_id, large)) and (r.size, r.text_crc32) in crc[r.doc_id] and r.law == "key"
            assert r.grown_shard in (r.shard, 24)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, small).count() == 0


def test_a_weight_change_moves_rows_to_its_subtree_only(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    tree = {"a": {"r": {0: 1.0, 1: 1.0}}, "b": {"r": {2: 1.0}, "s": {3: 1.0}}}
    more = {"a": {"r": {0: 1.0, 1: 1.0}}, "b": {"r": {2: 1.0}, "s": {3: 3.0}}}
    rows = sharding.assign_shards(ids, tree, more).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard in (2, 3) for r in moved) and all(r.grown_shard == 3 for r in moved if r.shard in (2, 3))
    share = sum(r.grown_shard == 3 for r in rows) / len(rows)
    assert abs(share - 0.5) < 0.05
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), {"a": {"r": {0: 0.0}}})


# ---- near duplicates ------------------------------------------------------------------------------------


def plain_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for a in known:
        for b in known:
            if a < b and bin(a ^ b).count("1") <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in known}


def test_masks_cover_every_pair_of_bits():
    masks = nd.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not (m >> i & 1) and not (m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def test_near_duplicates_equal_all_pairs(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = nd.near_duplicate_components(df).collect()
        assert len(rows) == df.count()
        fp = {(i, t): plain_fingerprint(t) for i, t in texts(df)}
        roots = plain_components(set(fp.values()))
        least = {}
        for (i, _), f in fp.items():
            if i is not None:
                least[roots[f]] = min(i, least.get(roots[f], i))
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((str(i), f"{fp[i, t]:016x}", least.get(roots[fp[i, t]])) for i, t in texts(df))
    assert nd.near_duplicate_components(empty).count() == 0


@pytest.mark.parametrize("most", [2, 24])
def test_links_of_crowded_buckets_lose_nothing(spark, most):
    rng = random.Random(5)
    fps = {0}
    for base in (rng.getrandbits(64) for _ in range(6)):
        cloud = {base}
        for _ in range(60):
            cloud.add(rng.choice(sorted(cloud)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps |= cloud
    signed = [nd._signed(f) for f in fps]
    found = nd.components(nd.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most=most)).collect()
    root = {r.node % 2**64: r.root for r in found}
    want = plain_components(fps)
    groups = defaultdict(set)
    for f in fps:
        groups[root.get(f, ("alone", f))].add(f)
    plain = defaultdict(set)
    for f in fps:
        plain[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_one_row_of_each_group_stays(spark, docs, odd):
    many = "alpha beta gamma delta epsilon zeta eta theta"
    mixed = spark.createDataFrame([(1, "t"), (None, "t"), (7, "t"), (7, "other words here"), (9, "u"), (9, "u"), (None, "alone"), (None, "alone"), (None, many), (None, many.upper()), (3, None), (2, ""), (4, " ")], "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2), "first": F.lit(3)})
    for df in (docs, odd, mixed):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        roots = plain_components({plain_fingerprint(t.encode()) for _, t in rows})
        groups = defaultdict(set)
        for i, t in rows:
            groups[roots[plain_fingerprint(t.encode())]].add((i is None, i, t))
        kept = nd.one_per_component(df)
        got = [(r.doc_id is None, r.doc_id, r.text or "") for r in kept.collect()]
        assert kept.columns == df.columns and len(got) == len(groups)
        for r in got:
            group = groups.pop(roots[plain_fingerprint(r[2].encode())])
            assert r in group and r[:2] == min((x[:2] for x in group), key=lambda x: (x[0], x[1] or 0))
    assert nd.one_per_component(docs.limit(0)).count() == 0


# ---- repeated passages ----------------------------------------------------------------------------------


def plain_removal(rows, span):
    first = {}
    for i, t in rows:
        for p in range(len(t) - span + 1):
            first[t[p : p + span]] = min(i, first.get(t[p : p + span], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(df, **how):
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((2**63 - 1 if r.doc_id is None else r.doc_id, *(r[c] for c in cols)) for r in repeated_passages.remove_repeats(df, **how).collect())


def test_removal_equals_a_plain_scan(spark, docs, odd, empty):
    for df in (docs, odd):
        assert removal(df) == plain_removal([(2**63 - 1 if i is None else i, t) for i, t in texts(df)], 50)
    assert removal(empty) == []
    out = repeated_passages.remove_repeats(odd)
    assert set(out.columns) == set(odd.columns) | {"n_bytes", "n_removed", "n_spans", "kept_sha256"}


@pytest.mark.parametrize("hot", [1, 20_000])
def test_crowded_passages_and_borders(spark, hot):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = noise(300), noise(120)
    rows = [(i, noise(rng.randint(0, 80)) + passage[rng.randint(0, 40) : 300 - rng.randint(0, 40)] + noise(rng.randint(0, 80)) + (other if i % 3 == 0 else "")) for i in range(60)]
    rows += [(i, t) for i, t in rows[:10]] + [(100 + i, "ab" * 200) for i in range(4)] + [(200, "x" * 49), (201, "x" * 49), (202, "x" * 50), (203, "yx" + "x" * 50)]
    rows += [(-1, noise(200)), (-1, noise(70) + passage), (300, passage[:90] * 40)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert removal(df, hot=hot) == plain_removal([(i, t.encode()) for i, t in rows], 50)


@pytest.mark.parametrize("most", [2, 100])
def test_longest_previous_factor(most):
    rng = np.random.RandomState(3)
    rows, counts, owners = rng.randint(97, 99, (40, 16)).astype(np.uint8), rng.randint(0, 8, 40), rng.randint(0, 9, 40)
    got = repeated_passages.longest_previous_factor(rows, counts, owners, 9, most).tolist()
    runs = [(r[p : p + 9].tobytes(), o) for r, n, o in zip(rows, counts, owners, strict=True) for p in range(n)]
    assert got == [9 if any(x == y and p < o for y, p in runs) else 0 for x, o in runs]


def test_the_arrays_decide(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 100_000, "text").limit(50))
    found = lambda: sum(r[2] for r in removal(rows))
    assert found() > 0
    cloudpickle.register_pickle_by_value(repeated_passages)
    try:
        monkeypatch.setattr(repeated_passages, "longest_previous_factor", lambda windows, counts, owners, width: np.zeros(int(counts.sum()), np.int16))
        assert found() == 0  # without the arrays nothing goes, neither copies nor passages
    finally:
        cloudpickle.unregister_pickle_by_value(repeated_passages)


# ---- decontamination ------------------------------------------------------------------------------------


def plain_passages(doc, item, share=0.8, least=13):
    """Whether some diagonal has a passage, by every diagonal."""
    need = min(len(item), max(5, min(least, math.ceil(share * len(item) - 1e-9))))
    for d in range(1 - len(item), len(doc)):
        a, b = max(0, d), min(len(doc), d + len(item))
        if dc.best_overlap(doc[a:b], item[a - d : b - d], share)[2] >= need > 0:
            return True
    return False


def test_passages_equal_all_diagonals_for_every_length(spark, odd, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(n)] for n in (*range(1, 26), 40, 60, 300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(2, " ".join(items[2])), (90, None), (91, "")], "item_id long, text string").withColumns({"contaminated": F.lit(1), "item_ids": F.lit(2)})
    rows = []
    for k in range(600):
        text, item = [word() for _ in range(rng.randint(0, 60))], items[k % len(items)]
        if k % 5:
            changed = set(rng.sample(range(len(item)), rng.choice((0, len(item) // 5, len(item) // 5, len(item) // 4, len(item) // 2))))
            text = text + [word() if n in changed else w.upper() + "," for n, w in enumerate(item)] + [word() for _ in range(30)]
        rows.append((k, " ".join(text)))
    rows.append((600, " ".join([*items[-1][:150], *[word() for _ in range(130)], *items[-1][280:]])))  # a long gap inside a passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: set(r.item_ids) for r in dc.contaminated(df, bench).collect()}
    hashed = [dc.word_hashes(" ".join(w).encode()) for w in items]
    missed, found = defaultdict(int), defaultdict(int)
    for k, t in rows:
        doc = dc.word_hashes(t.encode())
        want = {i for i, w in enumerate(hashed) if plain_passages(doc, w)}
        assert out[k] <= want
        for i in want:
            found[len(items[i])] += 1
            missed[len(items[i])] += i not in out[k]
    assert all(missed[n] == 0 for n in found if n < 12) and all(missed[n] <= 0.1 * found[n] for n in found) and set(found) == {len(w) for w in items}
    assert sum(missed.values()) <= 0.02 * sum(found.values())
    assert not any(r.contaminated for r in dc.contaminated(odd, bench).collect()) and dc.contaminated(odd, bench).count() == len(ODD)
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(odd, bench.limit(0)).where("contaminated").count() == 0


def test_a_passage_across_a_long_text_counts_once(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(9000)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([word() for _ in range(500)] + item)), (None, " ".join(item)), (None, " ".join(item)), (3, None)], "doc_id long, text string")
    rows = dc.contaminated(docs, bench).collect()
    assert [(r.n_passages, r.n_words) for r in rows if r.contaminated] == [(1, 9000)] * 3 and len(rows) == 4


def test_every_copied_item_of_the_tables_is_found(spark, docs, sf_dir):
    bench = {r.item_id: dc.word_hashes(r.text.encode()).tolist() for r in read(spark, sf_dir, "benchmark").collect()}
    want = set()
    for i, t in texts(docs):
        words = dc.word_hashes(t).tolist()
        at = defaultdict(list)
        for p, w in enumerate(words):
            at[w].append(p)
        if any(words[p : p + len(b)] == b for b in bench.values() for p in at.get(b[0], ())):
            want.add(i)
    out = {r.doc_id: r.item_ids for r in queries.benchmark_decontamination(spark, sf_dir).where("contaminated").collect()}
    assert want <= set(out)
    text = dict(texts(docs))
    hashed = {i: np.array(b, np.uint64) for i, b in bench.items()}
    assert all(plain_passages(dc.word_hashes(text[i]), hashed[item]) for i, items in out.items() for item in items)


def test_best_overlap_equals_all_runs():
    rng = np.random.RandomState(0)
    for _ in range(50):
        a, b = rng.randint(0, 2, 30).astype(np.uint64), rng.randint(0, 2, 30).astype(np.uint64)
        same = a == b
        plain = max([same[i:j].sum() for i in range(30) for j in range(i + 1, 31) if same[i] and same[j - 1] and same[i:j].mean() >= 0.8 - 1e-12], default=0)
        assert dc.best_overlap(a, b, 0.8)[2] == plain


# ---- quality --------------------------------------------------------------------------------------------


def plain_counts(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    windows = defaultdict(list)
    for p in range(len(words) - 7):
        windows[tuple(words[p : p + 8])].append(p)
    again = {q for ps in windows.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), dup, len(again)


def test_quality_counts_and_verdicts(spark, docs, odd, empty, sf_dir):
    crf = ql.fit(docs, read(spark, sf_dir, "labels"))
    for df in (docs, odd):
        rows = ql.judge(df, crf).collect()
        want = [(str(i), *plain_counts(t)) for i, t in texts(df)]
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(want)
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert ql.judge(empty, crf).count() == 0
    good = {r.doc_id for r in read(spark, sf_dir, "labels").where("quality = 1").collect()}
    judged = [r for r in ql.judge(docs, crf).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in judged) >= 0.95 * len(judged)


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.RandomState(4)
    for _ in range(20):
        crf = ql.Crf(rng.randn(len(ql.FEATURES), 2), rng.randn(2, 2))
        lines = [rng.choice(len(ql.FEATURES), 3, replace=False).tolist() for _ in range(rng.randint(1, 7))]
        score = lambda ys, crf=crf, lines=lines: sum(crf.emit[f, y].sum() for f, y in zip(lines, ys, strict=True)) + sum(crf.step[a, b] for a, b in itertools.pairwise(ys))
        best = max(itertools.product((0, 1), repeat=len(lines)), key=score)
        assert abs(score(crf.label(lines)) - score(best)) < 1e-9
    assert crf.label([]) == []


# ---- toxicity -------------------------------------------------------------------------------------------


def plain_kernel(a, b, decay, reach):
    def entries(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + reach)):
                for j in range(i + 1, k):
                    out[w[i] + w[j] + w[k]] += decay ** (k - i + 1)
        return out

    x, y = entries(a), entries(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_equals_its_definition():
    words = ["idiot", "id1ot", "ixdxiot", "banana", "ab", "moron"]
    w, c, v = toxicity.subsequences(words, 0.6, 6)
    rows = [dict(zip(c[w == k].tolist(), v[w == k].tolist(), strict=True)) for k in range(len(words))]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(sum(x * rows[j].get(u, 0) for u, x in rows[i].items()) - plain_kernel(a, b, 0.6, 6)) < 1e-9


def test_toxicity_learns_and_tolerates_gaps(spark, odd, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstnlm") for _ in range(rng.randint(3, 9)))
    bad = ["dregblip", "zwackfog", "quorbjix"]

    def text(toxic, spoil=lambda w: w):
        out = [word() for _ in range(60)]
        for _ in range(4 if toxic else 0):
            out[rng.randrange(60)] = spoil(rng.choice(bad))
        return " ".join(out) + "."

    model = toxicity.train([(text(k % 2), k % 2) for k in range(400)])
    score = lambda toxic, spoil=lambda w: w: np.array(model.scores([text(toxic, spoil) for _ in range(60)]))
    assert (score(0) < 0.3).mean() > 0.95 and (score(1) >= 0.3).mean() > 0.95
    assert (score(1, lambda w: w[:3] + "*" + w[3:]) >= 0.3).mean() > 0.9
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([]).scores(["a"]) == [0.5] and toxicity.train([("a b c", 0)]).scores(["x"])[0] < 0.01


def test_held_out_labels_are_not_learned_from(spark, sf_dir):
    rows = queries.toxic_documents(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == read(spark, sf_dir, "documents").count()


def test_held_out_toxicity_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels").select("doc_id", "toxic")
    rows = queries.toxic_documents(spark, sf).where("held_out").join(labels, "doc_id").collect()
    bad, good = ([r for r in rows if r.toxic == y] for y in (1, 0))
    assert len(bad) >= 5 and sum(r.predicted for r in bad) >= 0.5 * len(bad) and sum(r.predicted for r in good) <= 0.1 * len(good)


# ---- pages ----------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/x>Menu {n}</a></ul></nav><!-- c -->
<div class="cookie-notice">We use cookies</div><div class=ad>Buy {n}</div><article><h1>Head&amp;line {n}</h1><p><b>Bold{n}</b>text &lt;x&gt;<br>next   line {n}<p>Share this story<p>caf&eacute; {n} <div class="comments"><p>First!</div><form><p>mail</form></article><aside>Side</aside><footer>&copy; host</footer></body></html>"""


def test_main_text(spark, empty):
    rows = [(n, f"http://a.example/{n}", PAGE.replace("{n}", f"n{n}")) for n in range(12)]
    rows += [(50, "http://b.example/1", PAGE.replace("{n}", "solo")), (51, None, None), (52, "x", ""), (53, "http://c.example", "<p>only &nbsp; text"), (50, "http://b.example/1", PAGE.replace("{n}", "solo")), (None, "u", "<main>in<nav>out</nav></main>rest"), (54, "http://d.example", "<div><p>cut <b"), (55, "http://e.example", "no tags &amp; plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in page_text.extract_main_text(pages).collect()), key=str)
    text = {r[0]: r[1] for r in got}
    assert text[3] == "Head&line n3 Boldn3text <x> next line n3 café n3"  # what all the host's pages say is its template
    assert text[50] == "Head&line solo Boldsolotext <x> next line solo Share this story café solo"
    assert (text[51], text[52], text[53], text[None], text[54], text[55]) == ("", "", "only text", "in", "cut", "no tags & plain")
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert page_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("most", [32 << 20, -1])
def test_copies_of_an_article_are_one_page_of_their_host(spark, monkeypatch, most):
    monkeypatch.setattr(page_text, "_BROADCAST", most)  # both ways of joining templates
    rows = [(n, f"http://copies.example/{n}", PAGE.replace("{n}", "same")) for n in range(12)]
    rows += [(100 + n, f"http://mixed.example/{n}", PAGE.replace("{n}", f"n{n}" if n < 12 else "same")) for n in range(140)]
    text = {r.page_id: r.text for r in page_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {text[n] for n in range(12)} == {"Head&line same Boldsametext <x> next line same Share this story café same"}  # one page: no template
    assert text[103] == "Head&line n3 Boldn3text <x> next line n3 café n3"
    assert {text[100 + n] for n in range(12, 140)} == {"Head&line same Boldsametext <x> next line same café same"}


def test_names_of_other_things_stay_and_notices_go(spark):
    page = "<html><body><div class='main-content search-results'><h1>Title</h1><div class='share-price'>Price {n}</div><section id=social-history>History {n}</section><div class='widget-history'>Past {n}</div><div class='comment-list'>First {n}</div><div class='cookie-notice'>Cookies {n}</div><p>Text {n}</div></body></html>"
    rows = [(n, "http://x.example/", page.replace("{n}", str(n))) for n in range(3)]
    text = {r.page_id: r.text for r in page_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text == {n: f"Title Price {n} History {n} Past {n} Text {n}" for n in range(3)}


def plain_template(pages, least=3):
    """Places with their masses and texts of the template of one host's distinct pages, by occurrence vectors written out in full."""
    counts, firsts, up, size = [], [], {}, {}
    for page in pages:
        places, found, order = page_text.blocks(page)
        c, first = defaultdict(int), []
        for is_place, k in order:
            above = places[k][0] if is_place else found[k][0]
            above = ("place", places[above][1]) if above >= 0 else None
            t = ("place", places[k][1]) if is_place else ("text", above, found[k][1])
            c[t] += places[k][4] if is_place else 1
            up[t], size[t] = above, 0 if is_place else len(found[k][1])
            first += [t] if t not in first else []
        counts.append(c)
        firsts.append(first)
    vectors = {t: tuple(c.get(t, 0) for c in counts) for t in up}
    often = {t for t, v in vectors.items() if sum(map(bool, v)) >= (0.9 * (len(pages) + 1) if t[0] == "text" else max(least, 0.05 * len(pages)))}
    classes = defaultdict(set)
    for t in often:
        above = up[t]
        while above and vectors[above] == vectors[t]:
            above = up[above]
        classes[vectors[t], above].add(t)
    valid = set()
    for some in classes.values():
        orders = Counter(tuple(t for t in first if t in some) for first in firsts if some & set(first))
        if len(some) >= 2 and max(orders.values()) >= 0.9 * sum(orders.values()):
            valid |= some
    mass = {t[1]: 0 for t in valid if t[0] == "place"}
    for t in up:
        above = up[t]
        while above and above not in valid:
            above = up[above]
        if above:
            mass[above[1]] += size[t]
    return mass, {t for t in valid if t[0] == "text"}


def site(rng, n, line):
    """A page with a menu, an optional promotion, an article in an element of its own name, and two boxes whose order changes."""
    body = "".join(f"<p>{line()}</p>" for _ in range(rng.randint(1, 5)))
    boxes = ["<div class=one>A</div>", "<section>B</section>"]
    return f"<body><nav><ul>{''.join(f'<li>m{rng.randint(0, 50)}</li>' for _ in range(4))}</ul></nav>{'<div class=promo><b>Buy</b><div class=inner>now</div></div>' if n % 3 else ''}<div id=post-{n}><h1>{line()}</h1>{body}<p>Share this</p>{'<p>Share this</p>' if n == 4 else ''}<div class=box>Printed by us</div></div><div class=swap>{''.join(boxes[:: 1 if n % 2 else -1]) * (1 + n % 4)}</div><div>All rights</div></body>"


def test_the_template_equals_one_from_whole_occurrence_vectors(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) + str(rng.randint(0, 9)) for _ in range(9))
    pages = [site(rng, n, line) for n in range(30)]
    df = spark.createDataFrame([(n, "http://h.example/", p) for n, p in enumerate(pages + pages[:9])], "page_id long, url string, html string")
    got = page_text.templates(page_text.parsed_pages(df, "page_id", "url", "html")).collect()
    mass, fixed = plain_template(pages)
    h = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
    assert len(got) == 1 and (got[0].host, got[0].layout) == ("h.example", None) and dict(zip(got[0].paths, got[0].masses, strict=True)) == mass
    assert set(got[0].fixed) == {h(f"{p[1]}\n{t}") for _, p, t in fixed} and {t for *_, t in fixed} == {"Printed by us", "All rights"}
    elements = {path: element for page in pages for _, path, element, _, _ in page_text.blocks(page)[0]}
    assert "section" not in {elements[p] for p in mass} and "nav" in {elements[p] for p in mass}  # boxes in changing order are no class


def test_templates_of_the_table_equal_plain_ones(spark, sf_dir):
    found = page_text.parsed_pages(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    html = {r.page_id: r.html for r in read(spark, sf_dir, "pages").collect()}
    by = defaultdict(lambda: defaultdict(list))
    for r in found.withColumn("pick", F.xxhash64("layout", "token", "is_place", "parent", "times", "chars")).collect():
        if r.token:
            by[r.host][r.page].append((r.pick, r.layout, html[r.page_id]))
    groups = defaultdict(list)
    for host, some in by.items():
        for _, layout, page in map(min, some.values()):
            groups[(host, None) if len(some) >= 3 else (None, layout)].append(page)
    got = {(r.host, r.layout): dict(zip(r.paths, r.masses, strict=True)) for r in page_text.templates(found).collect()}
    plain = {k: plain_template(v)[0] for k, v in groups.items()}
    assert got == {k: v for k, v in plain.items() if v} and any(k[0] for k in got)


def test_what_differs_between_pages_is_the_main_text(spark):
    """Nothing is named here, and the longest text of every page says the same in other words of a small set: only pages side by side tell."""
    about = ["We print what our readers send us, and have done so for a long time, in this town and beyond. " * 6, "Our house stands beside the river, where the old mill was, and is open on every day of the week. " * 6]
    page = lambda n: f"<div><div><i>x</i></div><div id=a><h2>Welcome{n % 2}</h2><div class=k>{about[n % 2]}</div></div><div id=b><h2>Item {n}</h2><div class=k>Story {n} of {n * n} lines and {n + 7} words.</div></div></div>"
    rows = [(n, "http://about.example/", page(n)) for n in range(120)] + [(500, "http://alone.example/", page(3))]
    text = {r.page_id: r.text for r in page_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[n] == f"Item {n} Story {n} of {n * n} lines and {n + 7} words." for n in range(120))
    assert "Story" not in text[500]  # without pages beside it the longest region is taken


def test_small_hosts_share_the_template_of_their_layout(spark):
    rows = [(n, f"http://h{n}.example/", PAGE.replace("{n}", f"n{n}")) for n in range(30)]
    text = {r.page_id: r.text for r in page_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text == {n: f"Head&line n{n} Boldn{n}text <x> next line n{n} café n{n}" for n in range(30)}


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div>x", "<p>x", "<!", "<script ", '<a b="', "<x>", "<li><x>", "</y>", "<p></p>", "<tr><td>x"])
def test_malformed_pages_take_time_in_proportion(spark, part):
    def seconds(size):
        t = time.process_time()
        r = page_text._parsed(1, "http://a/", "<p>" + "<x>" * (size // 8) + part * (size // len(part)))
        places, found = list(zip(*r[5:9], strict=True)), list(zip(r[9], r[10], strict=True))
        page_text.main_blocks(places, found, page_text.own_template(places, found, r[11]), set())
        return time.process_time() - t

    assert seconds(250_000) < 10


def test_deep_and_cut_pages_through_spark(spark):
    rows = [(1, "http://d.example/", "<div>" * 50_000 + "deep"), (2, "http://d.example/", "<a " * 100_000), (3, "http://d.example/", "<p>in <b title='a>b'>bold</b> <i class=\"x>y\">z</i></p><p>after <a href=\"cut")]
    text = {r.page_id: r.text for r in page_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text == {1: "deep", 2: "", 3: "in bold z after"}


def test_rows_and_cells_close_each_other(spark):
    places, found, _ = page_text.blocks("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f")
    depth = []
    for above, *_ in places:
        depth.append(depth[above] + 1 if above >= 0 else 1)
    assert [(t, depth[k] if k >= 0 else 0) for k, t in found] == [("a", 3), ("b", 3), ("c", 3), ("d", 6), ("e", 3), ("f", 0)]
