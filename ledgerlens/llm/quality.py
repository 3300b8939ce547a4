"""Quality by compression: one dictionary from good texts, one from bad ones.

Each text is cut into chunks, each compressed with zstandard under both dictionaries. The
difference of the two compressed sizes, divided by their sum, is the only evidence; a logistic
curve in it, fitted on labelled rows that built no dictionary, gives a score from 0 to 1.

Training takes a bounded sample of labelled rows: the ``sample`` documents of each class whose ids
have the smallest hashes, whole texts; of their chunks the ``TRAIN_BYTES`` with the smallest hashes train a class's dictionary. Null and empty texts get the score of zero evidence. Without
rows of both classes every score is the good rows' share (0.5 without any). Repeated rows get equal
results; an empty table gives an empty result. A doc_id that is no number counts as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import doc_number, id_and_text, materialize, numbered

CHUNK = 1_024
SAMPLE = 2_000
#: Bytes of chunks of each class that come to the driver, at most.
TRAIN_BYTES = 16_000_000
DICT_BYTES = 64 * 1024
LEVEL = 3
SCORED = "doc_id long, score double, predicted int, difference double"


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, float]
    prior: float = 0.5

    def scorer(self):
        if not self.good:
            return lambda text: (self.prior, 0.0)
        tools = compressors(self.good, self.bad)

        def score(text: str) -> tuple[float, float]:
            difference = size_difference(tools, text)
            return _logistic(self.curve[0] + self.curve[1] * difference), difference

        return score


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]


def size_difference(tools: list, text: str) -> float:
    """Size under the bad dictionary less that under the good one, divided by their sum, over the whole text."""
    data = memoryview(text.encode("utf-8", "replace"))
    if not data:
        return 0.0
    good, bad = (sum(len(t.compress(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK)) for t in tools)
    return (bad - good) / (bad + good)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-6) -> tuple[float, float]:
    """(intercept, slope) of a logistic regression by Newton steps."""
    x = np.stack([np.ones_like(x), 10 * x], axis=1)
    w, total = np.zeros(2), weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * total * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * total * w)
    return float(w[0]), 10 * float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES) -> Model:
    """Train on documents whose ``labels.quality`` is 0 or 1; ``usable`` (over label_id) says which labels may be seen."""
    marks = labels.select(doc_number().alias("label_id"), F.col("quality").try_cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & usable)
    marks = marks.groupBy("label_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    if len(sizes) < 2:
        return Model(b"", b"", (0.0, 0.0), prior)
    drawn = [marks.filter(F.col("quality") == q).orderBy(F.xxhash64("label_id"), "label_id").limit(sample) for q in (0, 1)]
    # 2 * sample rows of two numbers
    rows = id_and_text(docs).join(F.broadcast(drawn[0].unionAll(drawn[1])), F.col("doc_id") == F.col("label_id"))
    rows = materialize(rows.groupBy("label_id", "quality").agg(F.min("text").alias("text")), "labelled")  # one text for each label, however many rows share its id
    half = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(2))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, t in zip(b.column("quality").to_pylist(), b.column("text")):
                data = t.as_py().encode("utf-8", "replace")
                out += [(q, data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["quality", "data"])

    found = rows.filter(half == 0).select("quality", "text").mapInArrow(pieces, "quality int, data binary")
    taken = {q: found.filter(F.col("quality") == q).orderBy(F.xxhash64("data"), "data").limit(train_bytes // CHUNK).collect() for q in (0, 1)}
    chunks = {q: sorted(bytes(r["data"]) for r in taken[q]) for q in (0, 1)}
    if not all(chunks.values()):
        return Model(b"", b"", (0.0, 0.0), prior)
    good, bad = (_train(chunks[q]) for q in (1, 0))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([size_difference(tools, t.as_py()) for t in b.column("text")], pa.float64())], ["quality", "d"])

    points = rows.filter(half == 1).select("quality", "text").mapInArrow(evidence, "quality int, d double").collect()
    points.sort(key=lambda p: (p["quality"], p["d"]))
    y = np.array([p["quality"] for p in points], float)
    if len(set(y)) < 2:
        return Model(good, bad, (math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 10.0), prior)
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())  # the sample is even, the labels are not
    return Model(good, bad, _fit_curve(np.array([p["d"] for p in points]), y, weight), prior)


def _train(chunks: list[bytes]) -> bytes:
    """A dictionary of the chunks: trained where there are enough, else their own bytes."""
    if len(chunks) >= 16 and sum(map(len, chunks)) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, chunks)) // 2), chunks, k=64, d=8).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return b"\n".join(chunks)[:DICT_BYTES]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, difference) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            s = [scorer(t.as_py()) for t in b.column("text")]
            p = np.array([x for x, _ in s], float)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([x for _, x in s], pa.float64())],
                ["doc_id", "score", "predicted", "difference"],
            )

    return id_and_text(docs).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more. Decided row by row."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            yield b.filter(pa.array([scorer(t.as_py() or "")[0] >= threshold for t in b.column(at)], pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
