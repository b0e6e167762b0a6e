"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is predicted by a binary logistic classifier on hashed byte n-grams (one to
three bytes, ASCII case folded, whatever isn't a letter as a space). Decoding sums the logistic losses of a codeword's
bits, each weighted by how much better than chance that bit's classifier is on rows that it wasn't fitted on, and chooses the codeword with the smallest
loss. A second codeword nearly as close makes the answer ambiguous.

The classifiers are fitted in one task to a sample of at most about `sample` labelled texts, spread over the
languages. Prediction reads whole texts, in Arrow batches, without a shuffle.

Defined results: null texts and texts without a letter are `und`, score 0, not ambiguous; without any labelled row all
texts are; rows without a doc_id aren't learned from; repeated rows get equal answers; an empty table gives an empty
result; extra columns are ignored by predictions() and kept by keep_known(), which judges each row by its own text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm.folds import held_out, sampled
from candor.llm.shared import giving_back

#: Hash buckets of n-grams, labelled texts to learn from, and the lead below which an answer is ambiguous.
BUCKETS, SAMPLE, LEAD = 1 << 13, 3000, 0.2
UNKNOWN = "und"
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def features(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """One row a text: square roots of n-gram shares, of length one."""
    out = np.zeros((len(texts), buckets), dtype=np.float32)
    for i, t in enumerate(texts):
        b = _FOLD[np.frombuffer(t, dtype=np.uint8)]
        for n in (1, 2, 3):
            if len(b) >= n:
                code = b[: len(b) - n + 1].copy()
                for k in range(1, n):
                    code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
                code = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)
                out[i] += np.bincount(code, minlength=buckets)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages. Up to six: every split in two; more: random ones, all different."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        return np.array([[1 if k >> i & 1 else -1 for k in range(1, 1 << (n - 1))] for i in range(n)], dtype=np.int8)
    rng, width, best, far = np.random.default_rng(n), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, width))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > far and not (np.abs(code.sum(axis=0)) == n).any():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets + 1 by bits; the last row is the bias
    trust: np.ndarray  # of bits; sums to one

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30)))
        by_language = (loss * self.trust).sum(axis=2) * len(self.trust)
        p = np.exp(by_language.min(axis=1, keepdims=True) - by_language)
        return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-5) -> Model:
    languages = sorted(set(labels.tolist()))
    code = codewords(len(languages))
    target = (code[np.searchsorted(languages, labels)] > 0).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - target
        g = np.vstack([x.T @ error, error.sum(axis=0, keepdims=True)]) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, code, w, np.full(code.shape[1], 1 / code.shape[1]))


def trusted(x: np.ndarray, labels: np.ndarray, parts: int = 5) -> Model:
    """fit(), with bits weighted by how much better than chance they are on every fifth row, which a first fit, of
    fewer steps, doesn't see."""
    model, unseen = fit(x, labels), np.arange(len(x)) % parts == parts - 1
    if len(set(labels[~unseen].tolist())) < len(model.languages) or not unseen.any():
        return model
    first = fit(x[~unseen], labels[~unseen], steps=60)
    target = first.code[np.searchsorted(first.languages, labels[unseen])]
    right = (((x[unseen] @ first.weights[:-1] + first.weights[-1]) > 0) == (target > 0)).mean(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(model.languages, model.code, model.weights, trust / trust.sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns lang from text, on rows that aren't held out."""
    some = sampled(docs.select("doc_id", "text", "lang").where(~held_out() & F.col("text").isNotNull()), "lang", sample)

    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in H.text_slices(batch):
                rows = [r.astype(np.float16).tobytes() for r in features(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(texts)), pa.array(rows, pa.binary())], names=["lang", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "x"])
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
        return pd.DataFrame({"model": [pickle.dumps(trusted(x, rows["lang"].to_numpy().astype(str)))]})

    # the sample is bounded, and so is what this one task gets
    found = some.select("text", "lang").mapInArrow(encode, "lang string, x binary").groupBy().applyInPandas(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def judged(model: Model | None, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    named, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    known = [k for k, t in enumerate(texts) if _has_letter(t)] if model else []
    for i in range(0, len(known), 64):
        some = known[i : i + 64]
        p = model.decode(features([texts[k] for k in some]))
        best = p.argmax(axis=1)
        score[some] = p[np.arange(len(some)), best]
        if p.shape[1] > 1:
            two = np.partition(p, -2, axis=1)[:, -2:]
            unsure[some] = two[:, 1] - two[:, 0] < LEAD
        for k, b in zip(some, best, strict=True):
            named[k] = model.languages[b]
    return named, score, unsure


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    @giving_back
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in H.text_slices(batch):
                named, score, unsure = judged(shared.value, texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER[np.frombuffer(text[:64], dtype=np.uint8)].any() or _LETTER[np.frombuffer(text, dtype=np.uint8)].any()) or not text.isascii() and any(c.isalpha() for c in text.decode())


def keep_known(docs: DataFrame, sample: int = SAMPLE, ambiguous: bool = True) -> DataFrame:
    """docs without those whose language can't be told (und) and, unless ambiguous ones are kept, those for which the
    classifier finds two languages about equally likely. Rows are filtered where they are, without a shuffle; lang is
    left as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    @F.pandas_udf("boolean")
    @giving_back
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch]
            kept = [np.zeros(0, dtype=bool)]
            for a, b in H.chunks(texts):
                named, _, unsure = judged(shared.value, texts[a:b])
                kept.append(np.array([n != UNKNOWN for n in named]) & (ambiguous | ~unsure))
            yield pd.Series(np.concatenate(kept))

    return docs.where(known("text"))
