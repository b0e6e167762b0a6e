"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded by hashed byte pairs and triples (with
case and punctuation) and by a few shares (letters, capitals, digits, punctuation, distinct words), through one learned
layer. Gated attention, tanh(Vh) * sigmoid(Uh), weights the passages; labels are known for documents only, and the
weighted sum of passages is what a logistic output scores. All layers are learned together by gradient descent.

The network is fitted in one task to a sample of at most about `sample` labelled documents, of which it sees LEARNED
passages at most, evenly spread. Scoring reads whole texts, in Arrow batches, without a shuffle; of a long text it
encodes a part of whole passages at a time, and holds a few numbers for each passage.

Defined results: a null, empty or blank text is one empty passage and has a score like any other; without labelled rows
every score is 0.5; labels without a document or without a quality are ignored; a document with several labels is
learned once for each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm import hashing as H
from candor.llm.folds import held_out, sampled

#: Passages of a labelled document to learn from at most, spread over the whole of it.
LEARNED = 128
#: Words of a passage, hash buckets, labelled documents to learn from, units of the encoder and of the attention.
PASSAGE, BUCKETS, SAMPLE, UNITS, GATES = 100, 1 << 10, 3000, 24, 16
SHARES = 8
THRESHOLD = 0.7

_KIND = np.zeros(256, dtype=np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[128:] = 5


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has (one at least)."""
    words = H.Words(texts)
    per_text = np.maximum(1, -(-np.diff(words.first) // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_text)])
    n = int(first[-1])
    passage = first[words.doc] + (np.arange(len(words.doc)) - words.first[words.doc]) // PASSAGE
    # a byte belongs to the passage of the last word that began before it
    byte_passage = np.repeat(np.concatenate([[0], passage]), np.diff(np.concatenate([[0], words.start, [len(words.data)]])))
    data = words.data.astype(np.uint32)
    counts = np.zeros(n * BUCKETS, dtype=np.float32)
    for k in (2, 3):
        code = data[: len(data) - k + 1].copy()
        for j in range(1, k):
            code = code * np.uint32(257) + data[j : len(data) - k + 1 + j]
        code = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length())
        counts += np.bincount(byte_passage[: len(code)] * BUCKETS + code, minlength=n * BUCKETS)
    grams = np.sqrt(counts.reshape(n, BUCKETS))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    kinds = np.bincount(byte_passage * 6 + _KIND[words.data], minlength=n * 6).reshape(n, 6).astype(np.float32)
    total = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    count = np.bincount(passage, minlength=n).astype(np.float32)
    order = np.lexsort((words.hash, passage))
    p, h = passage[order], words.hash[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(p[new], minlength=n) / np.maximum(count, 1)
    shares = np.concatenate([2 * kinds[:, 1:] / total, distinct[:, None], (np.log1p(count) / 5)[:, None], (kinds[:, 1:].sum(axis=1) / np.maximum(count, 1) / 10)[:, None]], axis=1)
    return np.concatenate([grams, shares.astype(np.float32)], axis=1), per_text


def passage_parts(text: bytes, most: int = H.CHUNK_BYTES) -> Iterator[bytes]:
    """A text in parts of whole passages of about `most` bytes; its last part may end in a shorter one."""
    at = 0
    while len(text) - at > most:
        wide, cut = most, 0
        while not cut and at + wide < len(text):
            start = H.Words([text[at : at + wide]]).start
            cut = int(start[(len(start) - 1) // PASSAGE * PASSAGE]) if len(start) > PASSAGE else 0
            wide *= 2
        if not cut:
            break
        yield text[at : at + cut]
        at += cut
    yield text[at:]


class Network:
    """Encoder, gated attention and output; bags are passages in a row, with their sizes."""

    def __init__(self, rng: np.random.Generator):
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"E": init(BUCKETS + SHARES, UNITS), "e": np.zeros(UNITS, np.float32), "V": init(UNITS, GATES), "U": init(UNITS, GATES), "a": init(GATES, 1), "c": init(UNITS, 1), "b": np.zeros(1, np.float32)}

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["E"] + self.w["e"])

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        return self.pooled(self.hidden(x), sizes)

    def pooled(self, h: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w, start = self.w, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bag = np.repeat(np.arange(len(sizes)), sizes)
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = ((t * s) @ w["a"])[:, 0]
        up = np.exp(raw - np.maximum.reduceat(raw, start)[bag])
        attention = up / np.add.reduceat(up, start)[bag]
        z = np.add.reduceat(attention[:, None] * h, start, axis=0)
        p = 1 / (1 + np.exp(-np.clip((z @ w["c"])[:, 0] + w["b"], -30, 30)))
        return {"h": h, "t": t, "s": s, "attention": attention, "z": z, "p": p, "bag": bag, "start": start}

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, sizes)
        out = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = out[:, None] * w["c"].T
        weighted = (dz[f["bag"]] * f["h"]).sum(axis=1)
        draw = f["attention"] * (weighted - np.add.reduceat(f["attention"] * weighted, f["start"])[f["bag"]])
        dgate = draw[:, None] * w["a"].T
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["attention"][:, None] * dz[f["bag"]] + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ draw[:, None], "c": f["z"].T @ out[:, None], "b": out.sum(keepdims=True)}


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = 12, batch: int = 32, rate: float = 0.004) -> Network:
    rng = np.random.default_rng(7)
    net, start = Network(rng), np.concatenate([[0], np.cumsum(sizes)])
    m, v, step = {k: np.zeros_like(a) for k, a in net.w.items()}, {k: np.zeros_like(a) for k, a in net.w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(sizes))
        for i in range(0, len(order), batch):
            some, step = order[i : i + batch], step + 1
            g = net.gradient(np.concatenate([x[start[k] : start[k + 1]] for k in some]), sizes[some], y[some])
            for k in net.w:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                net.w[k] = net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) - rate * 1e-3 * net.w[k]
    return net


def learned_passages(text: bytes) -> np.ndarray:
    """Features of at most LEARNED passages, evenly spread."""
    parts = [encode_passages([p])[0].astype(np.float16) for p in passage_parts(text)]
    n = sum(map(len, parts))
    chosen = np.unique(np.linspace(0, n - 1, min(n, LEARNED)).round().astype(np.int64))
    return np.concatenate(parts)[chosen].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    chosen = sampled(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out()), "quality", sample)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in H.text_slices(batch):
                rows = [learned_passages(t).astype(np.float16).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, len(texts)), pa.array(rows, pa.binary())], names=["quality", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quality", "x"])
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float16).reshape(-1, BUCKETS + SHARES).astype(np.float32)
        sizes = rows["x"].map(len).to_numpy() // (2 * (BUCKETS + SHARES))
        return pd.DataFrame({"model": [pickle.dumps(fit(x, sizes, (rows["quality"].to_numpy() > 0).astype(np.float32)))]})

    found = some.select("text", "quality").mapInArrow(encode, "quality int, x binary").groupBy().applyInPandas(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, top_passage (the passage with the largest weight) and its weight."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for a, texts in H.text_slices(batch):
                n = len(texts)
                p, top, weight = np.full(n, 0.5), np.zeros(n, dtype=np.int32), np.zeros(n)
                if net:
                    if n == 1:
                        h = np.concatenate([net.hidden(encode_passages([part])[0]) for part in passage_parts(texts[0])])
                        sizes = np.array([len(h)])
                    else:
                        x, sizes = encode_passages(texts)
                        h = net.hidden(x)
                    f = net.pooled(h, sizes)
                    p = f["p"].astype(np.float64)
                    for k, s in enumerate(f["start"]):
                        own = f["attention"][s : s + sizes[k]]
                        top[k], weight[k] = own.argmax(), own.max()
                columns = [batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(top), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "top_passage", "top_weight"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int, top_passage int, top_weight double")
