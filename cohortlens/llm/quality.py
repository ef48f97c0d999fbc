"""Quality rules: counts over whole texts, and content or boilerplate lines by a linear-chain CRF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, labelled_sample, require, text_or_empty

#: Marks that count as symbols, and words that announce notices rather than content.
SYMBOLS = b"#*$%&|<>"
NOTICE_WORDS = frozenset(b"copyright license licensed licence rights reserved cookie cookies privacy subscribe newsletter login menu sitemap advertisement sponsored".split())
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STEPS = (0.0, 0.02, 0.1, 0.25, 0.5)
_WINDOW = 8
CONTENT = 1

#: Names of the line features, in order.
FEATURES = ["any", *[f"{n}>{s}" for n in ("symbols", "upper", "digits", "bars", "echoes", "bangs") for s in _STEPS], "repeated line", "notice", "address", "sentence end", "capital first", *[f"words>{n}" for n in (2, 5, 14, 39)], *[f"distinct<{s}" for s in (0.2, 0.4, 0.6)], *[f"word length>{n}" for n in (3, 6, 9, 14)]]
_PLACE = {n: i for i, n in enumerate(FEATURES)}


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """Indexes in ``FEATURES`` of what holds for a line with at least one word."""
    n, chars = len(words), max(1, sum(map(len, words)))
    out = [0]
    shares = (
        (len(line) - len(line.translate(None, SYMBOLS))) / chars, (len(line) - len(line.translate(None, _UPPER))) / chars, (len(line) - len(line.translate(None, _DIGITS))) / chars,
        words.count(b"|") / n, sum(map(bytes.__eq__, words, words[1:])) / n, line.count(b"!") / n,
    )
    for k, share in enumerate(shares):
        at = 1 + k * len(_STEPS)
        out += [at + j for j, s in enumerate(_STEPS) if share > s]
    if repeated:
        out.append(_PLACE["repeated line"])
    low = line.lower()
    if not NOTICE_WORDS.isdisjoint(w.strip(b".,:;!()") for w in low.split()):
        out.append(_PLACE["notice"])
    if b"http" in low or b"www." in low or b"@" in line:
        out.append(_PLACE["address"])
    if words[-1][-1:] in b".!?":
        out.append(_PLACE["sentence end"])
    if words[0][:1].isupper() or words[0][0] > 127:
        out.append(_PLACE["capital first"])
    out += [_PLACE[f"words>{k}"] for k in (2, 5, 14, 39) if n > k]
    if n > 5:
        distinct = len(set(words)) / n
        out += [_PLACE[f"distinct<{s}"] for s in (0.2, 0.4, 0.6) if distinct < s]
    out += [_PLACE[f"word length>{k}"] for k in (3, 6, 9, 14) if chars > k * n]
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of 8 words that occur twice or more in the text, first ones included."""
    m = len(words) - _WINDOW + 1
    if m < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    x = np.zeros(m, np.uint64)
    for k in range(_WINDOW):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(m, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + _WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


@dataclass
class Crf:
    """Weights of each feature for the two labels (0 boilerplate, 1 content) and of each step from one label to the next."""

    emit: np.ndarray
    step: np.ndarray

    def label(self, lines: list[list[int]]) -> list[int]:
        """The labels of the most probable path (Viterbi)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = self.emit.T.tolist()
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(lines):
            x, y = sum([zero[i] for i in f]), sum([one[i] for i in f])
            if k:
                to0, to1 = b + s10 > a + s00, b + s11 > a + s01
                back.append((to0, to1))
                a, b = (b + s10 if to0 else a + s00) + x, (b + s11 if to1 else a + s01) + y
            else:
                a, b = x, y
        out = [int(b >= a)] if lines else []
        for to in reversed(back):
            out.append(int(to[out[-1]]))
        return out[::-1]


def train_crf(documents: list[tuple[list[list[int]], list[int]]], rounds: int = 80, ridge: float = 1.0) -> Crf:
    """Maximum likelihood with a ridge by full-batch Adam steps; gradients by forward and backward sums over padded sequences."""
    n_feat = len(FEATURES)
    emit, step = np.zeros((n_feat, 2)), np.zeros((2, 2))
    documents = [d for d in documents if d[0]]
    if not documents:
        return Crf(emit, step)
    most, n = max(len(x) for x, _ in documents), len(documents)
    rows, cols, gold, real = [], [], np.zeros((n, most), int), np.zeros((n, most), bool)
    for d, (lines, labels) in enumerate(documents):
        for k, (f, y) in enumerate(zip(lines, labels, strict=True)):
            rows += [d * most + k] * len(f)
            cols += f
            gold[d, k], real[d, k] = y, True
    rows, cols = np.array(rows), np.array(cols)
    hot = np.eye(2)[gold] * real[..., None]

    def spread(per_line: np.ndarray) -> np.ndarray:
        flat = per_line.reshape(-1, 2)
        return np.stack([np.bincount(cols, flat[rows, y], n_feat) for y in (0, 1)], axis=1)

    both = real[:, 1:]
    want_emit, want_step = spread(hot), np.einsum("dka,dkb->ab", hot[:, :-1], hot[:, 1:])
    moments = [np.zeros_like(emit), np.zeros_like(step), np.zeros_like(emit), np.zeros_like(step)]
    for t in range(1, rounds + 1):
        score = np.stack([np.bincount(rows, emit[cols, y], n * most) for y in (0, 1)], axis=1).reshape(n, most, 2)
        fwd, bwd = score.copy(), np.zeros_like(score)
        for k in range(1, most):
            fwd[:, k] = np.where(both[:, k - 1, None], score[:, k] + np.logaddexp.reduce(fwd[:, k - 1, :, None] + step, axis=1), fwd[:, k - 1])
        for k in range(most - 2, -1, -1):
            bwd[:, k] = np.where(both[:, k, None], np.logaddexp.reduce(step + (score[:, k + 1] + bwd[:, k + 1])[:, None, :], axis=2), 0)
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)[:, None]
        p = np.exp(fwd + bwd - total[..., None]) * real[..., None]
        pair = np.exp(np.minimum(0, fwd[:, :-1, :, None] + step + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[..., None, None])) * both[..., None, None]
        grads = (want_emit - spread(p) - ridge * emit, want_step - pair.sum(axis=(0, 1)) - ridge * step)
        for j, (w, g) in enumerate(zip((emit, step), grads, strict=True)):
            moments[j] = 0.9 * moments[j] + 0.1 * g
            moments[j + 2] = 0.99 * moments[j + 2] + 0.01 * g * g
            w += 0.2 * moments[j] / (1 - 0.9**t) / (np.sqrt(moments[j + 2] / (1 - 0.99**t)) + 1e-8)
    return Crf(emit, step)


def parsed(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of those equal an earlier line."""
    seen: set[bytes] = set()
    features, sizes, again = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            repeated = line in seen
            again += repeated
            features.append(line_features(line, words, repeated))
            sizes.append(len(words))
        seen.add(line)
    return features, sizes, again


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, stretch: int = 60, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """Trains on at most ``most_rows`` labelled documents, half of each label, chosen by a hash of the id, with all their lines; a document of many lines is learned in stretches of ``stretch`` lines.

    There are no line labels: a line has its document's, but a repeated line or one with a notice word is boilerplate. The bound
    on rows holds for training alone. Without rows every line is content.
    """
    require(docs, id_col, text_col)
    bad = {_PLACE["repeated line"], _PLACE["notice"]}
    documents = []
    for text, label in labelled_sample(docs, labels, most_rows, text_col, label_col, id_col)[0]:
        lines = parsed(text.encode())[0]
        for at in range(0, len(lines), stretch):
            some = lines[at : at + stretch]
            documents.append((some, [label and int(bad.isdisjoint(f)) for f in some]))
    return train_crf(documents)


def judge(docs: DataFrame, crf: Crf, content_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's base counts, base_failed and kept, with the words of content lines.

    Words are runs without ASCII white space. n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal
    to an earlier line), n_repeat_words (see :func:`repeat_words`); base_failed under 20 words or with over 30 % repeat
    words. kept: not failed, and at least ``content_share`` of the words are in lines that the CRF calls content. A null
    text has no words; ids may be null or repeat, each row is judged; no rows give no rows.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(crf)  # a few hundred numbers
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in (some for whole in parts for some in byte_slices(whole, "text")):
            out = []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = text.split()
                features, sizes, again = parsed(text)
                content = sum(n for n, y in zip(sizes, model.label(features), strict=True) if y == CONTENT)
                out.append((len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), again, repeat_words(words), content))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(counts, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_content_words") >= content_share * F.col("n_words")))
