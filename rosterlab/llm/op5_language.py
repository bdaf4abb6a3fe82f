"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader under an elastic net, followed by temperature calibration."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab.llm import common as C

#: Hashed n-gram features (a power of two), and n-gram lengths.
FEATURES, GRAMS = 1 << 14, (1, 2, 3)
#: Bound of the sample that the model is fitted on: about this many training rows of each language.
ROWS_PER_LANGUAGE = 800
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: the point itself if a letter, else a space."""
    if not _TABLE:
        points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        letter = np.fromiter((chr(p).isalpha() for p in range(len(points))), bool, len(points))
        _TABLE.append(np.where(letter, points, 32).astype(np.uint32))
    return _TABLE[0]


def gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of each text: hashed features in it, their counts, and whether it has a letter.

    Texts are lower-cased, every run of other characters than letters is one space, and a space stands at either end.
    """
    low = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    points = _letters()[points]
    ends = np.cumsum(size)
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[ends[:-1]] = True  # each text begins with its own space
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    points = points[keep].astype(np.uint64)
    lettered = np.concatenate([[0], np.cumsum(points != 32)])
    hashed = []
    state = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # gram ending at a place: the state of the one before, times a constant, plus the new letter
        moved = np.concatenate([[np.uint64(0)], state[:-1]]) if len(state) else state
        state = (moved + points + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if n in GRAMS:
            hashed.append((n, (state >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)))
    for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True):
        total = np.bincount(np.concatenate([h[a + n - 1 : b] for n, h in hashed]), minlength=FEATURES)
        at = np.flatnonzero(total)
        yield at, total[at], bool(lettered[b] > lettered[a])


def _vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts: one small row set per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for block in C.blocks(batches, text):
            for at, _, _ in gram_counts([t or "" for t in block.column(text).to_pylist()]):
                seen[at] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(seen, n))], ["f", "n"])

    rows = df.select(text).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES, np.int64)
    total = 0
    for r in rows:
        if r["f"] < 0:
            total = r["n"]
        else:
            out[r["f"]] = r["n"]
    return out, total


class Model:
    """Weights of each language, feature weights and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights, bias, idf, temperature

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at, count, lettered in gram_counts(texts):
            if not lettered or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = (_vector(at, count, self.idf) @ self.weights[at] + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())  # of equal scores the first language by name
            names.append(self.languages[best])
            scores.append(float(p[best]))
        return names, scores


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x class) and bias by follow-the-regularised-leader (proximal, per coordinate) with elastic net.

    Rows are visited in a seeded random order in every epoch.  l1 sets weights to exactly zero, l2 shrinks the rest.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        step = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)

    order = np.random.default_rng(7)
    vectors = [(np.append(at, FEATURES), np.append(_vector(at, count, idf), 1.0)) for at, count in rows]
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            at, x = vectors[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the logits explain the labels best (least negative log likelihood)."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 61))
    return float(min(grid, key=loss))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from the rows of df with a language, n-gram frequencies too; rows without a language or text teach nothing.

    The fitted sample is bounded by `rows_per_language` on average: rows are taken by a hash of the key below a share that
    each language's count sets.  A fifth of it is kept apart for the temperature.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    seen, total = document_frequencies(rows, text)
    idf = np.log((1 + total) / (1 + seen)) + 1
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0), idf, 1.0)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))])
    draw = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit(13), key).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches, "t"):
            at, count = [], []
            for a, c, _ in gram_counts(block.column("t").to_pylist()):
                at.append(a.astype("<u2").tobytes())
                count.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([block.column("l"), block.column("h"), pa.array(at, pa.binary()), pa.array(count, pa.binary())], ["l", "h", "at", "c"])

    found = sorted(sample.mapInArrow(run, "l string, h long, at binary, c binary").collect(), key=lambda r: (r["h"], r["l"]))
    vectors = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["c"], "<u4").astype(np.float64)) for r in found]
    labels = np.array([languages.index(r["l"]) for r in found])
    apart = np.arange(len(found)) % 5 == 4
    weights, bias = train_ftrl([v for v, a in zip(vectors, apart, strict=True) if not a], labels[~apart], len(languages), idf)
    logits = np.array([_vector(*v, idf) @ weights[v[0]] + bias for v, a in zip(vectors, apart, strict=True) if a]).reshape(-1, len(languages))
    return Model(languages, weights.astype(np.float32), bias, idf, calibrate(logits, labels[apart]))


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language of every whole text and its calibrated probability.

    Null texts and texts without a letter are `und` with score 0; other columns stay (existing outputs are replaced).
    The model is features x languages numbers, whatever the data.
    """
    df = df.drop(out, score)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, scores = shared.value.predict([t or "" for t in block.column(text).to_pylist()])
        yield pa.RecordBatch.from_arrays([*block.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*block.schema.names, out, score])

    return df.mapInArrow(C.in_arrow(step, text), C.widened(df, **{out: "string", score: "double"}))


def held_out(key: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.withColumn("lang", F.when(~F.coalesce(held_out(), F.lit(False)), F.col("lang"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
