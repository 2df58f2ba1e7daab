"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates, scored as sparse dot products.

Words are runs of letters and digits and runs of other signs. A text gives its lower-cased words, their pairs, and pairs and triples of word forms (upper, title,
lower, digits, or the run of signs itself) and pairs of one word, each hashed; a feature's value is its share of the words. Training takes a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.llm.common import Memo

BITS = 18
SAMPLE = 3000  # labelled rows fitted on
THRESHOLD = 0.3
SCALE = 8.0
_WORDS = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall


def _code(word: str) -> int:
    """Hash of the lower-cased word in the high half, hash of its form in the low half."""
    if word[0].isalnum():
        form = "9" if word.isdigit() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    else:
        form = word[:8]
    return (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) >> 1) << 32 | zlib.crc32(form.encode("utf-8", "surrogatepass"))


_CODES = Memo(_code)


def features(text: str | None) -> tuple[np.ndarray, int]:
    """(hashed n-grams with repeats, number of words). No word: empty."""
    words = _WORDS(text) if text else []
    n = len(words)
    code = np.fromiter(map(_CODES.__getitem__, words), np.uint64, n)
    word, form = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = [word * a, (word[:-1] * a + word[1:] * b) ^ c, form * b + c, (form[:-1] * b + form[1:] * c) ^ a, (form[:-2] * c + form[1:-1] * a + form[2:] * b) ^ b]
    grams.append(np.full(int((word[:-1] == word[1:]).sum()), a))  # a word said twice running
    return (np.concatenate([(g ^ (g >> np.uint64(29))) * b >> np.uint64(64 - BITS) for g in grams])).astype(np.int64), n


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        f, n = features(text)
        z = self.bias + (SCALE * float(self.weights[f].sum()) / n if n else 0.0)
        return 1 / (1 + float(np.exp(-max(-35.0, min(35.0, z)))))


class Ftrl:
    """Follow the regularised leader, per coordinate. The bias is a coordinate of its own without penalty."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE, epochs: int = 3, seed: int = 17) -> QualityModel:
    """Train on about ``rows`` labelled rows, drawn by a hash of the id. A document with several labels counts as the lowest; null labels and ids are left out.

    The drawn labels are at most a few times ``rows`` rows, so they are sent to the scan of ``docs``; no text is shuffled. No label: a model that scores one half.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    total = known.count()
    share = min(1.0, rows / max(1, total))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("__id").agg(F.min("__y").alias("__y")).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = [], []
            for t in b.column(2).to_pylist():
                f, n = features(t)
                u, c = np.unique(f, return_counts=True)
                at.append(u.astype("<u4").tobytes())
                x.append((SCALE * c / max(1, n)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["i", "y", "at", "x"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(drawn), "__id").select("__id", "__y", "__t")
    got = texts.mapInArrow(run, "i string, y double, at binary, x binary").toArrow().sort_by("i")
    leader, rng = Ftrl(1 << BITS), np.random.default_rng(seed)
    y, at, x = got["y"].to_numpy(), [np.frombuffer(v.as_buffer(), "<u4") for v in got["at"]], [np.frombuffer(v.as_buffer(), "<f4") for v in got["x"]]
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            leader.update(at[k].astype(np.int64), x[k].astype(float), y[k])
    w = leader.weights(np.arange(len(leader.z)))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with score and predicted (1 where the score reaches the threshold) added; columns of those names are replaced.

    A text without words (null, empty, blanks) gets the score of the bias alone.
    """
    held = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in held)
    at = held.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column(at)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*held, "score", "predicted"])

    return docs.select(*held).mapInArrow(run, f"{kinds}, score double, predicted int")
