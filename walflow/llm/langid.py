"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams (``NGRAMS``) after lower-casing, with
everything that is not a letter folded into word borders; each is hashed to one
of ``BUCKETS`` embedding rows, and the average row goes through a linear softmax.
Both layers are trained by stochastic gradient descent in numpy on a bounded,
class-balanced sample of labelled rows (``TRAIN_ROWS``); every document is
predicted from its whole text.

Rejection is calibrated on a fifth of the sample that training does not see: a
temperature makes its probabilities fit, and a text is rejected if it has no
letter or its best probability is under the least threshold (at least
``LEAST_SCORE``) above which held-back answers are right ``PRECISION`` of the time.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and
rejected; rows without lang are predicted but never learned from; with no
labelled row everything is ``und``; ties go to the first lang in sort order; there
is no bound on the number of langs, and the driver and the model grow with it (32 KB
a lang in the model, 32 KB a sampled row).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walflow.llm.common import batches, encoded, fresh, read, small_batches

TRAIN_ROWS = 2000
BUCKETS = 8192
NGRAMS = (2, 3, 4)
DIM, EPOCHS, BATCH, RATE = 16, 20, 32, 20.0
LEAST_SCORE, PRECISION = 0.4, 0.99
_LETTER = re.compile(r"[^\W\d_]")
#: The same in Spark's regular expressions, up to the Unicode version.
_LIKELY_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """How often each bucket occurs in the text."""
    data = np.concatenate([[32], _FOLD[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)], [32]]).astype(np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data = data[keep].astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.float32)
    for n in NGRAMS:
        m = len(data) - n + 1
        if m > 0:
            h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=BUCKETS)
    return out


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1.0, float(counts.sum())) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(lang or und, calibrated score, accepted)."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, False
        p = softmax(self.logits(features(text))[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], seed: int = 7) -> Model:
    """Trains on rows of bucket counts."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    x = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    order = rng.permutation(len(y))
    held, train = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 10 else (order, order)
    alone = ~np.isin(y[held], y[train])  # a lang is learned before it is held back
    held, train = held[~alone], np.concatenate([train, held[alone]])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            rows = train[a : a + BATCH]
            xb = x[rows]
            h = xb @ emb
            d = softmax(h @ out + bias)
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            back = d @ out.T
            out -= min(rate, 1.0) * (h.T @ d)
            bias -= 0.1 * d.sum(axis=0)
            emb -= rate * (xb.T @ back)
    table = emb @ out
    z = x[held] @ table + bias
    nll = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.2, 5, 33), key=nll)) if len(held) else 1.0
    p = softmax(z / temperature)
    right = p.argmax(axis=1) == y[held]
    threshold = LEAST_SCORE
    for t in [LEAST_SCORE, *sorted(p.max(axis=1))]:
        over = p.max(axis=1) >= t
        if t >= LEAST_SCORE and over.any() and right[over].mean() >= PRECISION:
            threshold = float(t)
            break
    return Model(langs, table, bias, temperature, threshold)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled rows of docs (doc_id, text, lang) that are not held out, the same number per lang; one each if there are more langs than `rows`."""
    known = small_batches(docs).where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(_LIKELY_LETTER)).select("doc_id", "text", "lang")
    sizes = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    each = max(1, rows // len(sizes))
    # More than enough of each lang by place, so that its `each` smallest are among them.
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    wanted = docs.sparkSession.createDataFrame([(lang, int(1_000_000 * min(1, (2 * each + 30) / n)) + 1) for lang, n in sizes.items()], "lang string, wanted long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in encoded(batch.column(2))]
        keep = [i for i, t in enumerate(texts) if has_letter(t)]
        sparse = []
        for i in keep:
            f = features(texts[i])
            at = np.flatnonzero(f)
            sparse.append(np.stack([at, f[at]]).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sparse, pa.binary())], ["place", "lang", "sparse"])

    picked = known.join(F.broadcast(wanted), "lang").where(place < F.col("wanted")).select(place.alias("place"), "lang", "text")
    found = picked.mapInArrow(batches(run), "place long, lang string, sparse binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "sparse"))
    sample = found.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("place", "lang", "sparse").collect()
    counts = np.zeros((len(sample), BUCKETS), dtype=np.float32)
    for i, r in enumerate(sample):
        at, n = np.frombuffer(r.sparse, dtype=np.int32).reshape(2, -1)
        counts[i, at] = n
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    return fit(counts, [r.lang for r in sample])


#: What `predict` adds.
ADDED = ("held_out", "lang_pred", "score", "accepted")


def known_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language the model accepts, with all their columns whatever these are called."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.large_binary()).to_pylist()
        return batch.filter(pa.array([model.predict(None if t is None else t.decode("utf-8", "replace"))[2] for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(batches(run), docs.schema)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row, with held_out, lang_pred, score and accepted (which replace columns of these names)."""
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ADDED]
    (own,) = fresh(docs.columns, "text")
    rows = docs.select(*keep, held_out().alias("held_out"), F.col("text").alias(own))
    fields = [f for f in rows.schema.fields if f.name != own]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + ["lang_pred", "score", "accepted"])

    schema = rows.select([f.name for f in fields]).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return rows.mapInArrow(batches(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
