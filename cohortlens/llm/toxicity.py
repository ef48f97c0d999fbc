"""Toxicity by a support vector machine over a string kernel of gapped subsequences, with Nyström landmarks."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import labelled_sample, require, text_or_empty

#: Characters count by code, letters and digits by themselves and the others in shared classes.
_CLASSES = 64
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
_ENDS = frozenset(".!?|;:")


def _code(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o - 48 if 48 <= o <= 57 else 37 + o % 27


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Lower-cased words without marks at their ends, letters spelled out one by one joined to a word; and the sentence of each.

    A sentence ends with a line or with a word whose last mark ends one.
    """
    words, sentence, s, spelled = [], [], 0, False
    for line in text.lower().split("\n"):
        for raw in _WORD.findall(line):
            w = raw if raw.isalnum() else _EDGE.sub("", raw)
            if w:
                if len(w) == 1 and spelled:
                    words[-1] += w
                else:
                    words.append(w)
                    sentence.append(s)
                spelled = len(w) == 1
            if raw[-1] in _ENDS:
                s += 1
                spelled = False
        s += 1
        spelled = False
    return words, sentence


def subsequences(words: list[str], decay: float, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (word, subsequence code, weight) of the gapped three-character subsequences within ``reach`` characters.

    The weight of a subsequence is the sum over its places of decay^(characters spanned), over the norm of all the word's
    weights: products of two words' entries give the normalised subsequence kernel.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not words:
        return empty
    lens = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.fromiter((_code(c) for c in itertools.chain.from_iterable(words)), np.int64, int(lens.sum()))
    word = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(chars))  # characters from here to the word's end
    ws, codes, weights = [], [], []
    for span in range(3, reach + 1):
        at = np.flatnonzero(left >= span)
        for mid in range(1, span - 1):
            ws.append(word[at])
            codes.append((chars[at] * _CLASSES + chars[at + mid]) * _CLASSES + chars[at + span - 1])
            weights.append(np.full(len(at), decay**span))
    w, c, v = np.concatenate(ws), np.concatenate(codes), np.concatenate(weights)
    if not len(w):
        return empty
    key = w * _CLASSES**3 + c
    order = np.argsort(key, kind="stable")
    key, v = key[order], v[order]
    head = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    w, c, v = key[head] // _CLASSES**3, key[head] % _CLASSES**3, np.add.reduceat(v, head)
    return w, c, v / np.sqrt(np.bincount(w, v * v, len(words)))[w]


@dataclass
class Model:
    """``beta`` holds the machine's weight for each subsequence, folded from landmarks; then a sentence's bias and the scale of documents."""

    beta: np.ndarray
    bias: float
    scale: np.ndarray
    decay: float
    reach: int
    known: dict[str, float] = field(default_factory=dict)

    def word_scores(self, words: set[str]) -> dict[str, float]:
        if len(self.known) > 100_000:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 4_000):
            some = new[at : at + 4_000]
            w, c, v = subsequences(some, self.decay, self.reach)
            self.known.update(zip(some, np.bincount(w, v * self.beta[c], len(some)).tolist(), strict=True))
        return self.known

    def features(self, texts: list[str]) -> np.ndarray:
        """Per document: its three highest sentence margins, the sum of words' positive scores per root of their number, the log of that number, and 1."""
        parsed = [words_of(t) for t in texts]
        known = self.word_scores(set().union(*(p[0] for p in parsed)) if parsed else set())
        out = np.zeros((len(texts), 6))
        for row, (words, sentence) in zip(out, parsed, strict=True):
            row[5] = 1
            if not words:
                row[:3] = self.bias
                continue
            s = np.fromiter(map(known.__getitem__, words), float, len(words))
            head = np.flatnonzero(np.diff(np.array(sentence), prepend=-1))
            sums = np.sort(np.add.reduceat(s, head))[::-1][:3]
            row[:3] = self.bias
            row[: len(sums)] += sums
            high = np.sort(s)[::-1][:12]
            row[3], row[4] = np.maximum(high, 0).sum(), np.log1p(len(words))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.features(texts) @ self.scale, -30, 30)))).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * h[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 20) -> np.ndarray:
    """L2-regularised squared-hinge linear SVM by Newton steps on the active rows; y is +1 or -1; the last column is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        gram, pull = np.diag(reg), -reg * w
        for at in range(0, len(x), 10_000):  # in parts, to hold little at once
            part, sign, heavy = x[at : at + 10_000].astype(float), y[at : at + 10_000], weight[at : at + 10_000]
            slack = 1 - sign * (part @ w)
            on = slack > 0
            part = part[on]
            scaled = part * heavy[on][:, None]
            gram = gram + scaled.T @ part
            pull = pull + scaled.T @ (sign * slack)[on]
        step = np.linalg.solve(gram, pull)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def train(rows: list[tuple[str, int]], landmarks: int = 160, decay: float = 0.6, reach: int = 6) -> Model:
    """A model from (text, label) rows.

    Landmarks are words: half those that tell toxic documents best (by their log odds, weighted by how often), half the commonest of
    the others. Sentences are sums of their words' kernel features, projected on the landmarks; a sentence
    has its document's label. The SVM's weights over landmarks fold back into one weight per subsequence. With
    one class only, every score is that class's share.
    """
    y = np.array([int(t) for _, t in rows])
    zero = Model(np.zeros(_CLASSES**3), 0.0, np.zeros(6), decay, reach)
    if not len(y) or y.min() == y.max():
        zero.scale[5] = 0.0 if not len(y) else (10.0 if y[0] else -10.0)
        return zero
    place: dict[str, int] = {}
    parsed = []  # per document: its words as numbers, and where sentences start
    for text, _ in rows:
        words, sentence = words_of(text)
        numbers = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
        parsed.append((numbers, np.flatnonzero(np.diff(np.array(sentence, np.int32), prepend=-1))))
    names = list(place)
    df = np.zeros((2, len(names)))
    for (numbers, _), label in zip(parsed, y, strict=True):
        df[label, np.unique(numbers)] += 1
    n = np.bincount(y, minlength=2)
    odds = np.log((df[1] + 0.1) / (n[1] + 0.2)) - np.log((df[0] + 0.1) / (n[0] + 0.2))
    long = [k for k, w in enumerate(names) if len(w) > 2]
    telling = sorted((k for k in long if df[1, k]), key=lambda k: (-odds[k] * np.sqrt(df[1, k]), names[k]))[: landmarks // 2]
    plain = sorted(set(k for k in long if df[0, k]) - set(telling), key=lambda k: (-df[0, k], names[k]))[: landmarks - len(telling)]
    marks = [names[k] for k in (*telling, *plain)]
    w, c, v = subsequences(marks, decay, reach)
    used, c = np.unique(c, return_inverse=True)
    phi = np.zeros((len(marks), len(used)))
    phi[w, c] = v
    values, vectors = np.linalg.eigh(phi @ phi.T)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # projects kernel values on the landmarks' span
    basis = phi.T @ root  # subsequence -> Nyström feature

    column = np.full(_CLASSES**3, -1)
    column[used] = np.arange(len(used))
    basis32 = basis.astype(np.float32)

    def sentences(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The features of all sentences of some documents, a thousand words at a time."""
        used_words, at_word = np.unique(np.concatenate([numbers for numbers, _ in some]), return_inverse=True)
        feature = np.zeros((len(used_words), basis.shape[1]), np.float32)
        for at in range(0, len(used_words), 1000):
            few = [names[k] for k in used_words[at : at + 1000]]
            w, c, v = subsequences(few, decay, reach)
            held = column[c] >= 0
            part = np.zeros((len(few), len(used)), np.float32)
            part[w[held], column[c[held]]] = v[held]
            feature[at : at + 1000] = part @ basis32
        starts = np.concatenate([s + k for (_, s), k in zip(some, np.cumsum([0, *(len(x) for x, _ in some)]), strict=False)])
        return np.add.reduceat(feature[at_word], starts)

    held = [k for k, (numbers, _) in enumerate(parsed) if len(numbers)]
    label = np.concatenate([np.full(len(parsed[k][1]), y[k]) for k in held])
    x = np.ones((len(label), basis.shape[1] + 1), np.float32)
    done = 0
    for at in range(0, len(held), 25):
        some = sentences([parsed[k] for k in held[at : at + 25]])
        x[done : done + len(some), :-1] = some
        done += len(some)
    share = label.mean()
    w = _svm(x, 2.0 * label - 1, np.where(label == 1, 0.5 / share, 0.5 / (1 - share)), ridge=3.0)
    beta = np.zeros(_CLASSES**3)
    beta[used] = basis @ w[:-1]
    model = Model(beta, float(w[-1]), np.zeros(6), decay, reach)
    documents = np.concatenate([model.features([t for t, _ in rows[at : at + 50]]) for at in range(0, len(rows), 50)])
    model.scale = _logistic(documents, y, np.ones(len(y)))
    model.known = {}
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 2400, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """Trains on at most ``most_rows`` labelled documents (``most_rows`` bounds the sample; texts are whole), half of each label if there are so many.

    They are chosen by a hash of the id from ``labels`` alone, and their ids go to the documents, whose texts aren't shuffled. Null labels and repeated ids count once or not at all; the calibration undoes the change of shares.
    """
    require(docs, text_col, id_col)
    taken, seen = labelled_sample(docs, labels, most_rows, text_col, label_col, id_col)
    model = train(taken)
    kept = Counter(label for _, label in taken)
    if len(kept) == 2:
        model.scale[5] += np.log(seen[1] / kept[1]) - np.log(seen[0] / kept[0])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text is looked at; a null or empty one gets the score of a text without words. Columns of these names are replaced;
    repeated rows are each scored; no rows give no rows.
    """
    require(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one number per subsequence

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        values, out = texts.tolist(), []
        held = done = 0
        for k, text in enumerate(values):
            held += len(text)
            if held > 2_000_000 or k == len(values) - 1:  # by size, so that long texts don't meet
                out += shared.value.scores(values[done : k + 1])
                held, done = 0, k + 1
        return pd.Series(out, dtype="float64")

    return docs.withColumn("score", scored(text_or_empty(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
