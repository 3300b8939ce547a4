"""Language identification in two steps: the family first, then languages within it.

Features are hashed byte n-grams of the lower-cased letters of the whole text. A linear
classifier (one against the rest) picks the language family; inside a family of several
languages, linear support vector machines, one for each pair of languages, vote.

Training takes a bounded sample of labelled rows: about ``sample`` different texts shared equally by the
languages, of each those with the smallest hashes, and ``LEAST`` of each language at least, so every
language is learned. Their feature vectors alone reach the driver: one of 32 KB for each text. Texts that
are null or hold no letter are ``und`` with score 0, as is everything where no row is labelled.
Repeated rows get equal results; an empty table gives an empty result. A doc_id that is no number counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, materialize

#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance"}
SIZE = 8_192
SAMPLE = 1_200
LEAST = 8
_STEP = 1 << 20
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
PREDICTED = "doc_id long, lang_pred string, score double, family string"


def features(text: str) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram shares (2 to 4 bytes); None for a text without letters."""
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    if not data or (not any(c < 128 for c in data.replace(b" ", b"")) and not any(c.isalpha() for c in text)):
        return None
    data = b" " + data + b" "
    counts = np.zeros(SIZE, np.int64)
    for at in range(0, len(data), _STEP):
        x = np.frombuffer(data[at : at + _STEP + 3], np.uint8).astype(np.uint32)
        key = x
        for n in range(1, 4):
            key = (key[:-1] << np.uint32(8)) | x[n:]
            counts += np.bincount((key * np.uint32(2654435761) ^ np.uint32(n * 40503)) >> np.uint32(19), minlength=SIZE)
    weights = np.sqrt(counts).astype(np.float32)
    return weights / max(np.linalg.norm(weights), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights, bias last, of a linear support vector machine (squared hinge, accelerated descent); y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    balance = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    rate = 1 / (1 + 4 * c * float((balance * (x * x).sum(1)).sum()))
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * c * ((balance * y * slack) @ x))
        w, v = new, new + (i / (i + 3)) * (new - w)
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    split: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, str]) -> Model:
        own = np.array([families.get(a, a) for a in langs])
        langs_ = np.array(langs)
        names = sorted(set(own))
        members = {f: sorted(set(langs_[own == f])) for f in names}
        split = np.stack([svm(x, np.where(own == f, 1, -1).astype(x.dtype)) for f in names]) if len(names) > 1 else None
        pairs = {}
        for f in names:
            for i, a in enumerate(members[f]):
                for b in members[f][i + 1 :]:
                    rows = (langs_ == a) | (langs_ == b)
                    pairs[a, b] = svm(x[rows], np.where(langs_[rows] == a, 1, -1).astype(x.dtype))
        return cls(names, members, split, pairs)

    def predict(self, x: np.ndarray) -> tuple[str, float, str]:
        """(language, score, family). The score is the family's share times the language's mean share against its siblings."""
        x = np.append(x, np.float32(1))
        share, family = 1.0, self.families[0]
        if self.split is not None:
            e = np.exp(4 * (m := np.clip(self.split @ x, -8, 8)) - 4 * m.max())
            family, share = self.families[int(e.argmax())], float(e.max() / e.sum())
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], share, family
        votes, odds = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a in langs:
            for b in langs:
                if (a, b) in self.pairs:
                    p = float(1 / (1 + np.exp(-4 * np.clip(self.pairs[a, b] @ x, -8, 8))))
                    votes[a if p >= 0.5 else b] += 1
                    odds[a] += p
                    odds[b] += 1 - p
        best = max(langs, key=lambda a: (votes[a], odds[a], a))
        return best, share * odds[best] / (len(langs) - 1), family


def fit(labelled: DataFrame, families: dict[str, str] | None = None, sample: int = SAMPLE) -> Model:
    """Train on (text, lang) rows; lang is not null. Rows are drawn by a hash of their text, each language equally."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    different = F.approx_count_distinct("text", 0.02).alias("n")  # copies count once, else a large group of them would be the sample
    sizes = materialize(rows.groupBy("lang").agg(different), "languages")
    each = max(LEAST, sample // max(1, sizes.count()))
    # texts whose hash is small enough, three times as many as wanted on average, then the smallest of these
    drawn = F.shiftrightunsigned(F.xxhash64("text"), 1).cast("double") / float(1 << 63)
    # a row for each language, of which the model will hold vectors of 32 KB
    rows = rows.join(F.broadcast(sizes), "lang").filter(drawn <= 3.0 * each / F.greatest(F.col("n"), F.lit(1)))
    rows = rows.select("lang", "text").dropDuplicates()
    smallest = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = rows.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(l, v.tobytes()) for l, t in zip(b.column("lang").to_pylist(), b.column("text")) if (v := features(t.as_py())) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in found]), pa.array([v for _, v in found], pa.binary())], ["lang", "v"])

    vectors = rows.select("lang", "text").mapInArrow(run, "lang string, v binary").collect()
    vectors.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    if not vectors:
        return Model()
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in vectors])
    return Model.fit(x, [r["lang"] for r in vectors], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, family) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                v = features(t.as_py()) if model.families else None
                out.append(("und", 0.0, "und") if v is None else model.predict(v))
            langs, scores, families = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(families, pa.string())],
                ["doc_id", "lang_pred", "score", "family"],
            )

    return id_and_text(docs).mapInArrow(run, PREDICTED)
