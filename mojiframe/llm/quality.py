"""Quality classifier by compression.

Two zstandard dictionaries, one built from good and one from bad labelled text.  A
text is cut into pieces of ``piece`` bytes (all of it), each compressed with either
dictionary; the feature is (bytes with the bad - bytes with the good) / bytes of
the text.  A logistic curve fitted on labelled texts that neither dictionary has
seen makes it a probability.

The model is fitted in one task on a bounded sample (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` bytes per label, the rows of smallest hash) and is broadcast: two
dictionaries of ``DICTIONARY`` bytes and two numbers.

Defined results: null and empty text have feature 0 and the curve's value there;
texts with contrary labels are not learned from; if a label has no text, every
score is 0.5; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiframe.llm.common import crc_mod, map_text, named_again, narrow, text_buffer, text_rows
from mojiframe.llm.sampling import first_rows, training_sample

SAMPLE_ROWS = 3000
SAMPLE_BYTES = 8 << 20
DICTIONARY = 32 << 10
PIECE = 600
LEVEL = 3
THRESHOLD = 0.3


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICTIONARY]


class Sizes:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            kind = zstandard.ZstdCompressionDict(d)
            kind.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=kind, write_content_size=False, write_dict_id=False).compress)

    def feature(self, text: bytes) -> float:
        good, bad = self.by
        diff = 0
        for k in range(0, len(text), PIECE):
            part = text[k:k + PIECE]
            diff += len(bad(part)) - len(good(part))
        return diff / len(text) if text else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a slight ridge."""
    scale = float(x.std()) or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    target = (y * (y.sum() + 1) + (1 - y)) / (np.where(y > 0, y.sum(), (1 - y).sum()) + 2)  # smoothed labels
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (target - p) - 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def fit(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes, float, float] | None:
    """Dictionaries from three quarters of each label, the curve from the rest."""
    own = {k: [t for t, y in zip(texts, labels) if y == k] for k in (0, 1)}
    if not own[0] or not own[1]:
        return None
    learn = {k: [t for i, t in enumerate(v) if i % 4] or v for k, v in own.items()}
    rest = {k: [t for i, t in enumerate(v) if i % 4 == 0] for k, v in own.items()}
    good, bad = build_dictionary(learn[1]), build_dictionary(learn[0])
    sizes = Sizes(good, bad)
    x = np.array([sizes.feature(t) for k in (0, 1) for t in rest[k]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    return good, bad, *fit_curve(x, y)


def train(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model from the labelled rows where ``where`` (a column of the id) holds."""
    known = narrow(labels.where(where), id=id_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    hashed = known.select("id", "label", F.xxhash64(F.lit(11), F.col("id").cast("string")).alias("h"))
    ids = first_rows(hashed, SAMPLE_ROWS, None, ("h", "id")).select("id", "label")
    # at most 2 * SAMPLE_ROWS ids
    labelled = narrow(docs, id=id_col, text=text_col).join(F.broadcast(ids), "id")
    sample = training_sample(labelled, "id", "text", "label", None, SAMPLE_ROWS, SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        m = fit([r[2].encode("utf-8") for r in rows], [int(r[3]) for r in rows])
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in m], names=["good", "bad", "slope", "shift"])

    got = sample.coalesce(1).mapInArrow(run, "good binary, bad binary, slope double, shift double").collect()
    return (bytes(got[0][0]), bytes(got[0][1]), got[0][2], got[0][3]) if got else None


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score (0 to 1, higher: better) and the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        sizes, slope, shift = (Sizes(*shared.value[:2]), *shared.value[2:]) if shared.value else (None, 0.0, 0.0)

        def run(b: pa.RecordBatch) -> list[pa.Array]:
            raw, at = text_buffer(b.column(1))
            view = raw.tobytes()
            x = np.array([sizes.feature(view[s:e]) if sizes else 0.0 for s, e in zip(at[:-1].tolist(), at[1:].tolist())])
            return [pa.array(1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50))))]

        return run

    return named_again(map_text(text_rows(docs, id_col, text_col, keep), make, "score double"), id_col, keep, "score")


def op2_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    scored = score_quality(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
