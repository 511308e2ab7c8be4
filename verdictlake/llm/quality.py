"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a small network on figures of a text's form (classes of characters and
their pairs, words, repetition). With the class prior p, the risk is p times the positives' loss plus what remains of
the unlabelled texts' negative loss after p times the positives' negative loss; where that remainder is negative, the
step goes against it instead.

The prior is estimated from positives and unlabelled texts alone: a first network tells the two samples apart on two
thirds of them; on the third held back, the share of unlabelled texts above a threshold over the share of positives above it
bounds the prior at every threshold, and the threshold is taken at which that bound is least for certain (both shares
with their Dvoretzky-Kiefer-Wolfowitz margins). Labels 0 take no part in anything.

Training starts on a bounded sample (``most_positive`` labelled rows, ``most_start`` unlabelled ones, in expectation, by the
hash of the id) and ends with ``passes`` steps on the risk over every row that may be learned from: each adds up, a
partition at a time, the gradients of all positives and all unlabelled texts. Scoring covers every whole text in Arrow
batches, a bounded number of characters at a time.

Defined results: a null or empty text is scored as the text without characters; very long texts are measured whole; equal
texts, and so ties and repeated rows, get equal scores; labels that are null, or ids without a document, teach nothing, an
id with several labels is positive if one of them is; without any positive the score is the prior everywhere; an
empty table gives an empty result; of the other columns only text, and for learning the id and label, are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, id_fold, staged, text_or_empty
from .text_arrays import SPACES, chunks, code_points, shingle_hashes, word_hashes

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of characters: lower, upper, other letters, digits, space, line feed, stops, brackets and quotes, symbols, the rest.
CLASSES = 10
_TABLE = np.zeros(0, np.uint8)


def classes() -> np.ndarray:
    global _TABLE
    if not len(_TABLE):
        t = np.full(0x110000, 9, np.uint8)
        for i in range(0x30000):
            c = chr(i)
            if c.islower():
                t[i] = 0
            elif c.isupper():
                t[i] = 1
            elif c.isalpha():
                t[i] = 2
            elif c.isdigit():
                t[i] = 3
        t[SPACES] = 4
        t[10] = 5
        for kind, chars in ((6, ".,;:?!"), (7, "()[]{}\"'`"), (8, "#$%&*+-/<=>@\\^_|~")):
            t[[ord(c) for c in chars]] = kind
        _TABLE = t
    return _TABLE


def features(texts: list[str]) -> np.ndarray:
    """One row of figures a text."""
    rows = [np.zeros((0, width()), np.float32)]
    rows += [_features(texts[a:b]) for a, b in chunks(texts)]
    return np.concatenate(rows)


def width() -> int:
    return CLASSES + CLASSES * CLASSES + len(PUNCTUATION) + 12


def _features(texts: list[str]) -> np.ndarray:
    points, starts = code_points(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(starts))
    kind = classes()[points].astype(np.int64)
    one = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, -1).astype(np.float64)
    one[:, 5] -= 1  # the line feed behind each text
    inner = doc[1:] == doc[:-1]
    inner[starts[1:-1] - 2] = False  # pairs with that line feed
    if len(inner):
        inner[-1] = False
    two = np.bincount((doc[:-1] * CLASSES + kind[:-1])[inner] * CLASSES + kind[1:][inner], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    mark = np.full(128, -1, np.int64)
    mark[[ord(c) for c in PUNCTUATION]] = np.arange(len(PUNCTUATION))
    at = np.flatnonzero((kind >= 6) & (points < 128))
    which = mark[points[at]]
    marks = np.bincount(doc[at][which >= 0] * len(PUNCTUATION) + which[which >= 0], minlength=n * len(PUNCTUATION)).reshape(n, -1)
    chars = np.maximum(np.diff(starts) - 1, 1)[:, None]
    words, first, length = word_hashes(points, starts)
    more = np.zeros((n, 12))
    same = np.concatenate([[False], words[1:] == words[:-1]])
    shingles = shingle_hashes(words, first)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            w, k = words[a:b], length[a:b]
            distinct, times = np.unique(w, return_counts=True)
            more[i] = (
                np.log1p(b - a), k.mean(), k.std(), k.max() ** 0.5, len(distinct) / (b - a), same[a + 1 : b].mean() if b - a > 1 else 0, times.max() / (b - a),
                len(shingles[i]) / max(b - a - 4, 1), (k == 1).mean(), (k > 20).mean(), (times == 1).sum() / (b - a), len(distinct) / (b - a) ** 0.7,
            )
    return np.concatenate([np.sqrt(one / chars), np.sqrt(two / chars), np.sqrt(marks / chars), more], axis=1).astype(np.float32)


class Network:
    """One hidden layer, trained by Adam on the non-negative risk."""

    def __init__(self, prior: float, hidden: int = 24, seed: int = 7):
        self.prior, self.hidden, self.seed = prior, hidden, seed
        self.w: list[np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return np.round(1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))), 9)  # matrix products differ in the last bits with the batch

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def start(self, positive: np.ndarray, unlabelled: np.ndarray) -> Network:
        both = np.concatenate([positive, unlabelled]).astype(np.float64)
        rng, d = np.random.default_rng(self.seed), both.shape[1]
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        self.w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        return self

    def pulls(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden values, probability of the positive class and loss as a negative of normed rows."""
        h = np.tanh(z @ self.w[0] + self.w[1])
        g = h @ self.w[2] + self.w[3]
        return h, 1 / (1 + np.exp(-np.clip(g, -30, 30))), np.logaddexp(0, g)

    def slopes(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradient of the weights for the slopes of the outputs."""
        dh = np.outer(slope, self.w[2]) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ slope, np.array([slope.sum()])]

    def move(self, grads: list[np.ndarray], state: dict, rate: float, decay: float) -> None:
        """One step of Adam."""
        state["t"] = t = state.get("t", 0) + 1
        for i, g in enumerate(grads):
            g = g + decay * self.w[i] if i in (0, 2) else g
            m = state[i, "m"] = 0.9 * state.get((i, "m"), 0.0) + 0.1 * g
            v = state[i, "v"] = 0.999 * state.get((i, "v"), 0.0) + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def risk_slopes(self, p: float, k: int, n: int, rest: float, z: np.ndarray, h: np.ndarray, sig: np.ndarray, positive: np.ndarray) -> list[np.ndarray]:
        """Of rows among k positives and n unlabelled, the gradient of the non-negative risk: of both parts, or against the rest."""
        plus = np.where(positive, p * (sig - 1) / max(k, 1), 0.0)
        minus = np.where(positive, -p * sig / max(k, 1), sig / max(n, 1))
        return self.slopes(z, h, plus + minus if rest >= 0 else -minus)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, batch: int = 512, rate: float = 0.008, decay: float = 1e-4, apart: bool = False) -> Network:
        """Batches of both samples. ``apart``: tell the samples apart by plain loss instead."""
        if not len(positive) or not len(unlabelled):
            return self
        self.start(positive, unlabelled)
        rng, p, state = np.random.default_rng(self.seed), self.prior, {}
        zp, zu = self.norm(positive.astype(np.float64)), self.norm(unlabelled.astype(np.float64))
        steps = max(1, len(zu) // batch)
        for epoch in range(epochs):
            up, uu = rng.permutation(len(zp)), rng.permutation(len(zu))
            for s in range(steps):
                bu = zu[uu[s * batch : (s + 1) * batch]]
                bp = zp[np.take(up, np.arange(s * batch, s * batch + len(bu)), mode="wrap")]
                z, own, k = np.concatenate([bp, bu]), np.arange(2 * len(bu)) < len(bu), len(bu)
                h, sig, negative = self.pulls(z)
                if apart:
                    grads = self.slopes(z, h, (sig - own) / len(z))
                else:
                    grads = self.risk_slopes(p, k, k, negative[k:].mean() - p * negative[:k].mean(), z, h, sig, own)
                self.move(grads, state, rate * (1 - epoch / epochs), decay)
        return self


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1, seed: int = 3) -> float:
    """The share of positives among the unlabelled, from the two samples."""
    if len(positive) < 6 or len(unlabelled) < 6:
        return 0.5
    rng = np.random.default_rng(seed)
    up, uu = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    a, b = len(up) // 3, len(uu) // 3
    model = Network(0.5, hidden=16).fit(positive[up[a:]], unlabelled[uu[b:]], epochs=12, apart=True)
    sp, su = np.sort(model.score(positive[up[:a]])), np.sort(model.score(unlabelled[uu[:b]]))
    at = np.unique(np.concatenate([sp, su]))
    above = lambda s: 1 - np.searchsorted(s, at, side="left") / len(s)
    margin = lambda n: (np.log(4 / sure) / (2 * n)) ** 0.5
    p, u = above(sp), above(su)
    low = p - margin(a)
    bound = np.where(low > 0, (u + margin(b)) / np.maximum(low, 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(u[best] / max(p[best], 1e-9) if np.isfinite(bound[best]) else 1.0, 0.02, 0.98))


def feature_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """id, x (figures as bytes) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"id": part["id"], "x": [r.tobytes() for r in features(part["text"].tolist())]})

    return docs.select("id", text_or_empty(text).alias("text")).mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, x binary")


def added_up(rows: DataFrame, part) -> np.ndarray | None:
    """The sum of part(figures, positive) over all rows: one partial sum a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                found = part(np.stack([np.frombuffer(x, np.float32) for x in b["x"]]).astype(np.float64), b["kind"].to_numpy() == 1)
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    total = None
    for r in rows.select("kind", "x").mapInPandas(run, "sums binary").toLocalIterator():
        found = np.frombuffer(r["sums"], np.float64)
        total = found.copy() if total is None else total + found
    return total


def finish(model: Network, rows: DataFrame, passes: int, rate: float = 0.004, decay: float = 1e-4) -> Network:
    """Steps on the non-negative risk over all rows (kind 1: positives, which are unlabelled texts, too; x)."""
    state: dict = {}
    for s in range(passes):

        def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            z = model.norm(x)
            h, sig, negative = model.pulls(z)
            parts = [positive.sum(), len(z), negative[positive].sum(), negative.sum()]
            of = [model.slopes(z[m], h[m], f(sig[m])) for m, f in ((positive, lambda v: v - 1), (positive, lambda v: v), (slice(None), lambda v: v))]
            return np.concatenate([parts, *[g.ravel() for gs in of for g in gs]])

        sums = added_up(rows, part)
        if sums is None or not sums[0]:
            return model
        (k, n, of_positive, of_all), p = sums[:4], model.prior
        gains, losses, negative = np.split(sums[4:], 3)
        rest = of_all / n - p * of_positive / k
        against = negative / n - p * losses / k
        flat = p * gains / k + against if rest >= 0 else -against
        cuts = np.cumsum([w.size for w in model.w])[:-1]
        model.move([g.reshape(w.shape) for g, w in zip(np.split(flat, cuts), model.w, strict=True)], state, rate * (1 - s / passes), decay)
    return model


def learn(docs: DataFrame, labels: DataFrame, held_out_folds: int = 5, prior: float | None = None, most_positive: int = 6000, most_start: int = 12_000, passes: int = 8, caution: float = 0.97, doc_id: str = "doc_id", label: str = "quality") -> Network:
    """Fit on the rows whose fold is not 0."""
    open_docs = docs.where(id_fold(doc_id, held_out_folds) != 0).select(F.col(doc_id).alias("id"), F.col("text"))
    trusted = labels.where((id_fold(doc_id, held_out_folds) != 0) & (F.col(label) == 1)).select(F.col(doc_id).alias("id")).distinct()
    figures = staged(feature_rows(open_docs), "quality-figures", 1000)
    rows = staged(figures.join(trusted.withColumn("kind", F.lit(1)), "id", "left").select("id", F.coalesce("kind", F.lit(0)).alias("kind"), "x"), "quality-rows")
    drop_staged(figures)
    seen = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("kind"), F.lit(0))).first()
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = lambda c, seed, most, n: rows.where(c & (draw(seed) < min(1.0, most / max(n, 1)))).select("x").toPandas()["x"]
    matrix = lambda xs: np.frombuffer(b"".join(sorted(xs)), np.float32).reshape(len(xs), -1) if len(xs) else np.zeros((0, width()), np.float32)
    positive, unlabelled = matrix(sample(F.col("kind") == 1, 1, most_positive, seen[1])), matrix(sample(F.lit(True), 2, most_start, seen[0]))
    model = Network(caution * class_prior(positive, unlabelled) if prior is None else prior).fit(positive, unlabelled)
    if model.w is not None:
        model = finish(model, rows, passes)
    drop_staged(rows)
    return model


def scorer(spark, model: Network, most_rows: int = 256):
    """A column function: score of a text column."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series(np.concatenate([np.zeros(0)] + [shared.value.score(features(values[a : a + most_rows])) for a in range(0, len(values), most_rows)]))

    return lambda name="text": score(text_or_empty(name))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, Column]:
    """The documents and the condition under which the classifier keeps one."""
    return docs, scorer(docs.sparkSession, learn(docs, labels))() >= threshold
