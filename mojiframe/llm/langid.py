"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, fitted by follow-the-regularised-leader (FTRL-proximal)
with an elastic net, then calibrated by one temperature.

Features: the lower-cased text with every run of non-letters as one space;
n-grams of 1 to 3 characters hashed into ``dims`` columns; the value is the
n-gram's share of the document times its inverse document frequency.

The model is fitted on a bounded sample of labelled rows (``sample_rows`` and
``sample_bytes`` per language, the rows of smallest hash), in one task; it is
broadcast with ``dims * languages * 4`` bytes, at most ``MAX_MODEL_BYTES``.
Prediction reads every whole text, in the row, without a shuffle.

Defined results: null text, empty text and text without a letter give ``und``
with score 0; without any labelled row every text does; repeated rows give a
row each; equal probabilities go to the language that sorts first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import crc_mod, give_back, map_text, named_again, text_rows
from mojiframe.llm.sampling import training_sample

DIMS = 1 << 17
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 6 << 20
MAX_MODEL_BYTES = 256 << 20
ORDERS = (1, 2, 3)
SCALE = 20.0
BLOCK = 1 << 18
UNDETERMINED = "und"

_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each a run ``0 word 0 word ... 0``, and n+1 offsets;
    a text without letters is an empty run."""
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, low), np.int64, len(low))
    off = np.append(0, np.cumsum(lens))
    letter = _letters()[cp]
    has = np.add.reduceat(np.append(letter, False), off[:-1], dtype=np.int64) * (lens > 0) if len(low) else np.zeros(0, np.int64)
    # room for a separator before each text; one at the end of each comes with the next step
    pos = np.arange(len(cp)) + np.repeat(np.arange(len(low)), lens) * 2 + 1
    seq = np.zeros(len(cp) + 2 * len(low), np.uint32)
    seq[pos[letter]] = cp[letter]
    doc = np.repeat(np.arange(len(low)), lens + 2)
    keep = seq > 0
    keep[1:] |= (seq[1:] == 0) & ((seq[:-1] > 0) | (doc[1:] != doc[:-1]))
    keep[:1] = True
    keep &= (has > 0)[doc] if len(low) else keep
    # a separator right after the opening one is dropped by the rule above
    return seq[keep], np.append(0, np.cumsum(np.bincount(doc[keep], minlength=len(low)))).astype(np.int64)


def gram_columns(seq: np.ndarray, n: int, dims: int) -> np.ndarray:
    """The column of the n-gram that starts at each position but the last n - 1."""
    m = max(0, len(seq) - n + 1)
    h = np.full(m, n, _U)
    for i in range(n):
        h = (h + seq[i:i + m].astype(_U)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return (h >> _U(64 - dims.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """Multinomial FTRL-proximal with L1 and L2, per-coordinate rates."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z = np.zeros((dims + 1, classes))
        self.n = np.zeros((dims + 1, classes))
        self.a, self.b, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.b + np.sqrt(n)) / self.a + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, rows: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(rows)
        p = softmax((x @ w)[None, :])[0]
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.a * w
        self.n[rows] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], dims: int = DIMS, epochs: int = 3, seed: int = 7) -> dict:
    """Weights with the idf folded in, the languages and the temperature."""
    names = sorted(set(langs))
    if len(names) * dims * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(names)} languages at {dims} columns exceed {MAX_MODEL_BYTES} bytes; lower dims")
    docs, ys = [], []
    for t, y in zip(texts, langs):
        seq, _ = sequences([t])
        if len(seq):
            cols = np.concatenate([gram_columns(seq, n, dims) for n in ORDERS])
            f, c = np.unique(cols, return_counts=True)
            docs.append((f.astype(np.int32), (c / len(cols)).astype(np.float32)))
            ys.append(names.index(y))
    if not docs:
        return {}
    df = np.zeros(dims)
    for f, _ in docs:
        df[f] += 1
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held = order[:len(docs) // 6] if len(docs) >= 30 else order
    train = order[len(docs) // 6:] if len(docs) >= 30 else order
    model = Ftrl(dims, len(names))

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        f, c = docs[i]
        return np.append(f, dims), np.append(SCALE * c * idf[f], 1.0)

    for _ in range(epochs):
        for i in rng.permutation(train):
            model.step(*row(i), ys[i])
    w = model.weights(slice(None))
    logits = np.stack([x @ w[f] for f, x in map(row, held)])
    y = np.array(ys)[held]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return {"names": names, "bias": w[dims].astype(np.float32), "temperature": float(grid[int(np.argmin(loss))]),
            "weights": np.ascontiguousarray((w[:dims] * idf[:, None] * SCALE).astype(np.float32))}


def score(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Class (-1: undetermined) and calibrated probability of each text."""
    if not model:
        return np.full(len(texts), -1), np.zeros(len(texts))
    w, dims = model["weights"], len(model["weights"])
    seq, off = sequences(texts)
    z, total = np.zeros((len(texts), w.shape[1])), np.zeros(len(texts))
    lens = np.diff(off)
    for n in ORDERS:
        total += np.maximum(lens - n + 1, 0)
        for a in range(0, len(seq), BLOCK):  # blocks bound the memory of very long texts
            part = seq[a:a + BLOCK + n - 1]
            cols = gram_columns(part, n, dims)
            if not len(cols):
                continue
            d0, d1 = np.searchsorted(off, [a, a + len(cols) - 1], "right") - 1
            vals = w[cols]
            for k in range(1, n):  # n-grams that cross into the next text
                cross = off[d0 + 1:d1 + 2] - a - k
                vals[cross[(cross >= 0) & (cross < len(cols))]] = 0
            edges = np.maximum(off[d0:d1 + 1] - a, 0)
            z[d0:d1 + 1] += np.add.reduceat(vals, np.minimum(edges, len(cols) - 1), axis=0) * (off[d0 + 1:d1 + 2] > np.maximum(off[d0:d1 + 1], a))[:, None]
    some = lens > 0
    p = softmax((z / np.maximum(total, 1)[:, None] + model["bias"]) / model["temperature"])
    return np.where(some, p.argmax(1), -1), np.where(some, p.max(1), 0.0)


def train(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", dims: int = DIMS) -> dict:
    """Fit in one task over the bounded sample of the rows where ``where`` holds; the
    model comes back as one row."""
    sample = training_sample(docs, id_col, text_col, lang_col, where, SAMPLE_ROWS, SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(4)]))
        m = fit([r[2] for r in rows], [r[3] for r in rows], dims)
        del rows
        give_back()
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.array([json.dumps([m["names"], m["temperature"]])]), pa.array([m["bias"].tobytes()], pa.binary()),
                 pa.array([m["weights"].tobytes()], pa.binary())], names=["head", "bias", "weights"])

    got = sample.coalesce(1).mapInArrow(run, "head string, bias binary, weights binary").collect()
    if not got:
        return {}
    names, temperature = json.loads(got[0][0])
    return {"names": names, "temperature": temperature, "bias": np.frombuffer(got[0][1], np.float32),
            "weights": np.frombuffer(got[0][2], np.float32).reshape(dims, len(names))}


def identify_language(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred, score and the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = pa.array([*m.get("names", []), UNDETERMINED])

        def predict(b: pa.RecordBatch) -> list[pa.Array]:
            k, p = score(m, b.column(1).to_pylist())
            return [names.take(pa.array(np.where(k < 0, len(names) - 1, k))), pa.array(p)]

        return predict

    found = map_text(text_rows(docs, id_col, text_col, keep), make, "lang_pred string, score double", 1 << 20)
    return named_again(found, id_col, keep, "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return identify_language(docs, model).withColumn("held_out", held_out)
