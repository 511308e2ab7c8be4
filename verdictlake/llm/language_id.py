"""Language by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, runs of anything but letters become one space, and its n-grams of one to three characters fall
into 2**16 features by hash. A feature's value is its share of the text's n-grams times its inverse document frequency,
counted over every document that may be learned from. The weights come from follow-the-regularised-leader with elastic
net on a bounded sample (``most_a_language`` documents of each language, drawn by the hash of the id), most of them
exactly 0; a temperature fitted on a fifth of the sample held back calibrates the probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null language teach nothing;
very long texts are read whole; repeated rows are predicted alike; ties go to the first language by name; without anything to learn from all texts are
``und``; an empty table gives an empty result; columns other than id, text and language are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_fold, text_or_empty
from .text_arrays import chunks, code_points

SIZE = 1 << 16
SCALE = 30.0
_LETTERS = np.zeros(0, bool)


def letters() -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram (SIZE where it would leave its text) in three rows, starts of the texts, number of n-grams, whether any letter."""
    points, starts = code_points(["\n" + t.lower() for t in texts])
    is_letter = letters()[points]
    first = np.zeros(len(points), bool)
    first[starts[:-1]] = True
    keep = is_letter | first | np.concatenate([[True], is_letter[:-1]])
    at = np.concatenate([[0], np.cumsum(keep)])
    begin = at[starts]
    p = np.where(is_letter, points, 32).astype(np.uint32)[keep]
    n = np.diff(begin)
    out = np.full((3, len(p)), SIZE, np.int32)
    a = p * np.uint32(2654435761) + np.uint32(97)
    out[0] = (a ^ (a >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)
    b = (a[:-1] ^ (a[:-1] >> np.uint32(13))) * np.uint32(3266489917) + p[1:] * np.uint32(668265263)
    out[1, :-1] = (b ^ (b >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)
    c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(374761393) + p[2:] * np.uint32(2654435761)
    out[2, :-2] = (c ^ (c >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)
    last = begin[1:] - 1
    out[1, last] = SIZE
    out[2, last] = SIZE
    out[2, np.maximum(last - 1, begin[:-1])] = SIZE
    some = np.add.reduceat(is_letter, starts[:-1]) > 0 if len(points) else np.zeros(0, bool)
    return out, begin, np.maximum(3 * n - 3, 1), some


def text_features(out: np.ndarray, begin: np.ndarray, n: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(out[:, begin[i] : begin[i + 1]].ravel(), minlength=SIZE + 1)[:SIZE]
    idx = np.flatnonzero(counts)
    return idx.astype(np.int32), (counts[idx] / n[i]).astype(np.float32)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights, self.bias = np.zeros((SIZE + 1, len(languages)), np.float32), np.zeros(len(languages))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4, seed: int = 5) -> LanguageModel:
        """FTRL-proximal with per-coordinate rates; a fifth of the rows sets the temperature."""
        k = len(self.languages)
        if k < 1 or not rows:
            return self
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        back = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
        z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

        def weights(idx: np.ndarray) -> np.ndarray:
            zi = z[idx]
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2))

        for _ in range(epochs):
            for r in rng.permutation(order[len(back) :]):
                idx, tf = rows[r]
                idx, x = np.append(idx, SIZE), np.append(tf * self.idf[idx] * SCALE, 1.0)  # the last is the bias
                w = weights(idx)
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[labels[r]] -= 1
                g = x[:, None] * p
                sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
                z[idx] += g - sigma * w
                n[idx] += g * g
        w = weights(np.arange(SIZE + 1))
        self.bias = w[SIZE].copy()
        w[SIZE] = 0
        self.weights = (w * (np.append(self.idf, 0.0) * SCALE)[:, None]).astype(np.float32)
        if len(back):
            scores = np.stack([rows[r][1] @ self.weights[rows[r][0]] + self.bias for r in back])
            loss = lambda t: (np.log(np.exp((scores - scores.max(1, keepdims=True)) / t).sum(1)) - ((scores - scores.max(1, keepdims=True)) / t)[np.arange(len(back)), labels[back]]).mean()
            grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
            self.temperature = float(grid[np.argmin([loss(t) for t in grid])])
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in chunks(texts):
            out, begin, n, some = grams(texts[a:b])
            k = len(self.languages)
            total = np.zeros((b - a, max(k, 1)))
            if k:
                for row in out:
                    total[:, :k] += np.add.reduceat(self.weights[row], begin[:-1], axis=0)
                total = (total / n[:, None] + self.bias) / self.temperature
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            known = some & (k > 0)
            names += [self.languages[j] if ok else "und" for j, ok in zip(best, known, strict=True)]
            scores.append(np.where(known, p[np.arange(b - a), best], 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Of every feature, the number of documents that have it: one partial count a task, then a sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                out, begin, _, _ = grams(texts[a:b])
                for i in range(b - a):
                    seen = np.zeros(SIZE + 1, bool)
                    seen[out[:, begin[i] : begin[i + 1]]] = True
                    total += seen
        idx = np.flatnonzero(total[:SIZE])
        yield pd.DataFrame({"feature": idx.astype(np.int32), "n": total[idx]})

    return docs.select(text_or_empty().alias("text")).mapInPandas(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, held_out_folds: int = 4, held_out: int = 2, most_a_language: int = 1200, doc_id: str = "doc_id", lang: str = "lang") -> LanguageModel:
    bound_batches(docs.sparkSession)
    own = docs.where((id_fold(doc_id, held_out_folds) != held_out) & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    n = sum(sizes.values())
    df = np.zeros(SIZE)
    for r in document_frequencies(own).toLocalIterator() if n else []:
        df[r["feature"]] = r["n"]
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1)
    if not languages:
        return model
    wanted = docs.sparkSession.createDataFrame([(k, min(1.0, most_a_language / sizes[k])) for k in languages], "lang string, share double")
    # A broadcast row a language: the model itself holds a column of weights for each.
    sample = own.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("share"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, begin, n_, _ = grams(batch["text"].tolist())
            rows = [text_features(out, begin, n_, i) for i in range(len(batch))]
            yield pd.DataFrame({"lang": batch["lang"], "idx": [r[0].tobytes() for r in rows], "tf": [r[1].tobytes() for r in rows]})

    rows = sample.select("lang", text_or_empty().alias("text")).mapInPandas(run, "lang string, idx binary, tf binary").toPandas()
    rows = rows.sort_values(["lang", "idx", "tf"], ignore_index=True)
    pairs = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(rows["idx"], rows["tf"], strict=True)]
    return model.fit(pairs, np.array([languages.index(x) for x in rows["lang"]], int))


def predictor(spark, model: LanguageModel):
    """A column function: struct of lang_pred and score."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return lambda name="text": predict(text_or_empty(name))
