"""Toxicity by a string-kernel support vector machine.

The kernel of two strings is the gap-weighted subsequence kernel: every three
letters in order that lie within ``SPAN`` characters count, with a weight that
decays with the span, and the kernel is normalised to 1 for equal strings. The
start of a word counts as a letter. Characters that are not letters make no
subsequence but widen the gaps, so an insult with inserted characters
(``i*d*i*o*t``, ``i d i o t``, ``idxiot``) stays close to the plain one.

A sentence is seen through its units: the parts between white space, and runs
of single letters with at most three other characters between. A support vector
machine over Nystroem features (the kernel to a fixed number of landmark units)
gives each unit a margin, and a document is scored by the largest margins of its
units, wherever its sentences hold them. As the features are linear in the kernel, and the kernel is linear in the
subsequence weights, the machine is one weight for each three letters.

Labels are given for documents. The units of positive documents are set apart by
how much more often they occur there than in negative ones; those, against
units of negative documents, train the machine, which then twice gets the worst
units of the negative documents it had wrong; the margins of the labelled
documents fix the scale of the score. All of it is fitted on at most
``MAX_LABELLED`` labelled documents, picked by a hash of their id. A unit of few
positive texts counts if chance would not make one such unit of all there are.
"""

from __future__ import annotations

import re
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.llm.arrow_rows import map_texts, rows_to, table

#: Bounds of what the machine is fitted on; every document is scored. Labelled
#: documents; units of negative ones, by hash and by frequency; landmarks.
MAX_LABELLED = 20_000
NEGATIVE_UNITS = 30_000
COMMON_UNITS = 2_000
LANDMARKS = 128
#: A positive unit stands in so many positive texts, by these odds (logarithm),
#: and more often than chance would make one of all units.
LEAST_TEXTS = 3
LEAST_ODDS = 3.0
ROUNDS = 3
TOP = 8
CHANGED = 30
SPAN = 7
DECAY = 0.7
UNIT = 32
THRESHOLD = 0.3
CACHE_ENTRIES = 800_000

_SPACED = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,3}\w(?!\w)){2,}")
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
_CLASSES: list[np.ndarray] = []
_START = 63  # the class of the start of a word
_BITS = 6


def _letters() -> np.ndarray:
    """Code point -> letter class: a to z 1-26, other letters 27-62."""
    if not _CLASSES:
        out = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():
                out[i] = i - 96 if 97 <= i <= 122 else 27 + i % 36
        _CLASSES.append(out)
    return _CLASSES[0]


def units(text: str) -> list[str]:
    """The distinct units of a text, without marks at their ends; a unit with
    marks inside also without those. A longer one than ``UNIT`` characters is
    covered by overlapping windows."""
    text = text.lower()
    out = set()
    runs = [re.sub(r"\W+", ".", m.group()) for m in _SPACED.finditer(text)]
    for w in {w.strip(_EDGES) for w in text.split()}.union(runs):
        for u in (w,) if w.isalpha() else (w, "".join(filter(str.isalpha, w))):
            if len(u) <= UNIT:
                out.add(u)
            else:
                out.update(u[i:i + UNIT] for i in range(0, len(u) - UNIT // 2, UNIT // 2))
    out.discard("")
    return list(out)


def variants(unit: str) -> list[str]:
    """A unit with one letter doubled, and with one inserted."""
    return [unit[:i] + x + unit[i:] for i in range(1, len(unit)) for x in (unit[i], "x")]


_PAIRS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, three letters as a number, weight) summed over places: the
    vectors whose products are the kernel."""
    joined = ["\n" + s for s in strings]
    sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(chars == 10, _START, _letters()[chars])
    owner = np.repeat(np.arange(len(joined)), sizes)
    # marks in front of a word do not part it from its start
    lead = (codes == 0) & (np.arange(len(codes)) < np.repeat(_first_letter(codes, sizes), sizes))
    codes, owner = codes[~lead], owner[~lead]
    codes = np.concatenate([codes, np.zeros(SPAN, codes.dtype)]).astype(np.int64)
    owner = np.concatenate([owner, np.full(SPAN, -1)])
    n = len(codes) - SPAN
    keys, weights = [], []
    for i, j in _PAIRS:
        a, b, c = codes[:n], codes[i:i + n], codes[j:j + n]
        ok = (a > 0) & (b > 0) & (c > 0) & (owner[j:j + n] == owner[:n])
        keys.append((owner[:n][ok] << 3 * _BITS) | (a[ok] << 2 * _BITS) | (b[ok] << _BITS) | c[ok])
        weights.append(np.full(len(keys[-1]), DECAY ** (j + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    if len(key):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, weight = key[start], np.add.reduceat(weight, start)
    return key >> 3 * _BITS, key & FEATURES - 1, weight


FEATURES = 1 << 3 * _BITS


def _first_letter(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the first letter of each string is, or where it ends."""
    ends = np.cumsum(sizes)
    at = np.flatnonzero((codes > 0) & (codes != _START))
    k = np.searchsorted(at, ends - sizes)
    return np.minimum(np.append(at, len(codes))[k], ends)


class Vectors:
    """Unit vectors of some strings, over the subsequences they hold."""

    def __init__(self, strings: list[str]):
        row, feature, weight = subsequences(strings)
        self.features, at = np.unique(feature, return_inverse=True)
        self.rows = np.zeros((len(strings), len(self.features)))
        self.rows[row, at] = weight
        norm = np.linalg.norm(self.rows, axis=1, keepdims=True)
        self.rows /= np.where(norm > 0, norm, 1)

    def times(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with each of these."""
        out = np.zeros((len(strings), len(self.rows)))
        for i in range(0, len(strings), 2000):
            row, feature, weight = subsequences(strings[i:i + 2000])
            n = min(2000, len(strings) - i)
            norm = np.sqrt(np.bincount(row, weight * weight, n))
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            ok = self.features[at] == feature
            part = np.zeros((n, len(self.features)), dtype=np.float32)
            part[row[ok], at[ok]] = weight[ok]
            out[i:i + n] = (part @ self.rows.T) / np.where(norm > 0, norm, 1)[:, None]
        return out


def project(strings: list[str], vector: np.ndarray) -> np.ndarray:
    """Product of each string's unit vector with a weight for each feature."""
    row, feature, weight = subsequences(strings)
    norm = np.sqrt(np.bincount(row, weight * weight, len(strings)))
    return np.bincount(row, weight * vector[feature], len(strings)) / np.where(norm > 0, norm, 1)


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 40):
    """(w, bias) of the squared-hinge machine by Newton steps; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xs, ws = x[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + (xs * ws[:, None]).T @ xs, (xs * ws[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_scale(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the logistic score over document features, the bias last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - label) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A weight for each three letters, a bias and the scale of the score."""

    def __init__(self, vector: np.ndarray, bias: float, scale: np.ndarray):
        self.vector, self.bias, self.scale = vector, bias, scale
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"vector": self.vector, "bias": self.bias, "scale": self.scale, "known": {}}

    def worst(self, texts: list[str]) -> tuple[list[list[tuple[float, str]]], np.ndarray]:
        """The ``TOP`` units of the largest margins of each text, and the
        features of its score: some of those margins, up to 1 and from there to 5
        (a machine's training asks for 1; far above it stand sure units), and the
        logarithm of the number of units."""
        cut = [units(t) for t in texts]
        every = {u for c in cut for u in c}
        missing = [u for u in every if u not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known.clear()
            missing = list(every)
        for i in range(0, len(missing), 20_000):
            part = missing[i:i + 20_000]
            self.known.update(zip(part, (project(part, self.vector) + self.bias).tolist(), strict=True))
        get = self.known.__getitem__
        top = [nlargest(TOP, zip(map(get, c), c, strict=True)) for c in cut]
        margins = np.array([[m for m, _ in t] + [self.bias] * (TOP - len(t)) for t in top]).reshape(-1, TOP)
        size = np.log(np.maximum([len(c) for c in cut], 50.0)).reshape(-1, 1)
        m = margins[:, [0, 1, 2, 4, 7]]
        return top, np.hstack([np.clip(m, 0, 1), np.clip(m, 1, 5) - 1, size])

    def scores(self, texts: list[str]) -> np.ndarray:
        _, x = self.worst(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.scale[:-1] + self.scale[-1], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most about ``limit`` labelled documents. A document
    with several labels takes the highest; rows without id or label are left
    out. The labels are picked first, so what is broadcast has that bound."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * limit / n)))
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(known), "doc_id").select("text", "toxic")


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, up, down): in how many different positive and negative texts."""
    def count(part: pa.RecordBatch):
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for u in {x.strip(_EDGES) for x in units(text)}:
                seen.setdefault(u, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
             pa.array([v[0] for v in seen.values()], pa.int64())], names=["unit", "up", "down"])

    return rows_to(sample, "text", "unit string, up long, down long", count) \
        .groupBy("unit").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Learn from the documents of ``docs`` that ``labels`` names. Without a
    positive or a negative one the score is the share of positives everywhere."""
    sample = labelled(docs, labels, limit).dropDuplicates(["text"])
    sample = sample.select("text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic")).checkpoint()
    totals = sample.agg(F.sum("toxic").alias("up"), F.count("*").alias("n")).first()
    n_up, n_down = int(totals["up"] or 0), int(totals["n"]) - int(totals["up"] or 0)
    flat = Model(np.zeros(FEATURES), 0.0, np.array([0.0] * 11 + [float(np.log((n_up + 0.5) / (n_down + 0.5)))]))
    if not n_up or not n_down:
        return flat
    counts = unit_counts(sample).where(F.length("unit") > 2)
    up, down = (F.col("up") + 0.5) / (n_up + 1), (F.col("down") + 0.5) / (n_down + 1)
    counts = counts.withColumn("odds", F.log(up / down)).checkpoint()
    # the chance that so many of a unit's texts are positive, by the divergence of the shares
    share = n_up / (n_up + n_down)
    both, own = F.col("up") + F.col("down"), F.col("up") / (F.col("up") + F.col("down"))
    apart = own * F.log(own / share) + F.when(own < 1, (1 - own) * F.log((1 - own) / (1 - share))).otherwise(0.0)
    n_units = counts.where(both >= LEAST_TEXTS).count()
    positive = counts.where((F.col("up") >= LEAST_TEXTS) & (F.col("odds") > LEAST_ODDS) & (both * apart > F.log(F.lit(max(1, n_units))))) \
        .orderBy(F.desc("up"), "unit").collect()
    negative = counts.where((F.col("down") > 0) & (F.col("odds") < 0.7))
    random = negative.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVE_UNITS).collect()
    common = negative.orderBy(F.desc("down"), "unit").limit(COMMON_UNITS).collect()
    good = {r["unit"]: r["up"] for r in positive}
    bad = {r["unit"] for r in random} | {r["unit"] for r in common}
    if not good or not bad:
        return flat
    for _ in range(ROUNDS):
        model = train(good, sorted(bad))
        shared = sample.sparkSession.sparkContext.broadcast(model)

        def worst(arr, shared=shared):
            top, x = shared.value.worst(arr.to_pylist())
            return [x.tolist(), [[u for m, u in t[:3] if m > -1] for t in top]]

        rows = map_texts(sample, "text", [T.StructField("x", T.ArrayType(T.DoubleType())),
                                          T.StructField("units", T.ArrayType(T.StringType()))], worst, keep=["toxic"]).collect()
        bad |= {u for r in rows if not r["toxic"] for u in r["units"]} - set(good)
    model.scale = fit_scale(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows]))
    return model


def train(good: dict[str, int], bad: list[str]) -> Model:
    """The machine on Nystroem features: positive units weigh by the documents
    they are in, and both sides weigh the same. The most frequent positive units
    also stand with a letter doubled or inserted, at a tenth of their weight."""
    names = list(good)
    changed = {v: good[u] / 100 for u in names[:CHANGED] for v in variants(u) if v not in good}
    good = good | changed
    landmarks = Vectors(pick_landmarks(names, bad))
    values, basis = np.linalg.eigh(landmarks.rows @ landmarks.rows.T)
    keep = values > 1e-6
    nystroem = basis[:, keep] / np.sqrt(values[keep])
    names = list(good)
    x = landmarks.times(names + bad) @ nystroem
    y = np.r_[np.ones(len(names)), -np.ones(len(bad))]
    seen = np.sqrt(np.array([good[u] for u in names], dtype=float))
    weight = np.r_[seen / seen.sum(), np.full(len(bad), 1 / len(bad))] * len(bad)
    w, bias = train_svm(x, y, weight)
    vector = np.zeros(FEATURES)
    vector[landmarks.features] = landmarks.rows.T @ (nystroem @ w)
    return Model(vector, bias, np.zeros(12))


def pick_landmarks(good: list[str], bad: list[str], n: int = LANDMARKS) -> list[str]:
    """Units spread over the positive ones, each the least like those before,
    from the most frequent on; the last quarter the negative ones most like
    them."""
    row, feature, weight = subsequences(good)
    norm = np.sqrt(np.bincount(row, weight * weight, len(good)))
    weight = weight / np.where(norm > 0, norm, 1)[row]
    starts = np.searchsorted(row, np.arange(len(good) + 1))
    dense = np.zeros(FEATURES)

    def like(k: int) -> np.ndarray:
        own = slice(starts[k], starts[k + 1])
        dense[feature[own]] = weight[own]
        out = np.bincount(row, weight * dense[feature], len(good))
        dense[feature[own]] = 0
        return out

    chosen, near = [0], like(0)
    while len(chosen) < min(n * 3 // 4, len(good)):
        k = int(np.argmin(near))
        if near[k] > 0.95:
            break
        chosen.append(k)
        near = np.maximum(near, like(k))
    marks = [good[k] for k in chosen]
    near = Vectors(marks).times(bad).max(axis=1)
    return marks + [bad[i] for i in np.argsort(-near, kind="stable")[:n // 4]]


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, all if None) with ``score`` from 0
    to 1, higher for likelier toxic, and ``predicted``. A null text counts as an
    empty one and has the score of a text without a unit; repeated rows score
    alike; a long text is scored as a whole, by its largest margins; an empty
    table gives an empty table; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(arr: pa.Array) -> list:
        s = shared.value.scores([t or "" for t in arr.to_pylist()])
        return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]

    return map_texts(docs, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())],
                     score, keep=keep)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every whole document; learned from three folds of four."""
    from lexiscope.session import checkpoint_dir
    checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    labels = table(spark, sf_dir, "labels").where(fold != 2)
    return score_documents(docs, fit(docs.where(fold != 2), labels), keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")
