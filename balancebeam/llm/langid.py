"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent, with calibrated rejection.

The subwords of a text are its runs of three and four bytes, lower-cased. A text is the mean of its subwords' embeddings. The model is trained on the driver from a
bounded sample of labelled rows, drawn by hash and alike for every language; only the sparse counts of a sampled text leave the executors. A part of the sample that
is not trained on sets the temperature of the softmax and the bound under which a prediction is rejected.

The softmax compares learned languages with each other, so it is as sure of a text in another one. A prediction is rejected by how familiar the text's subwords are: their mean log frequency in
the predicted language, its distance from that language's median in deviations that a text of this length has among the calibration rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UND = "und"
BUCKETS = 1 << 13
DIMS = 16
SAMPLE = 3000  # labelled rows fitted on, over all languages
REJECT = 0.001  # share of calibration rows at which the bound of familiarity lies
MARGIN = 1.0  # deviations under it that are still accepted
UNSEEN = 0.001  # share of a language's frequencies given to all subwords alike
FLAT = 1e-4  # least variance of a mean log frequency
_LETTER = regex.compile(r"\p{L}")


def subword_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed runs of three and four bytes of the lower-cased text between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    out = np.zeros(buckets, np.int64)
    for h in (three, three[:-1] + b[3:] * np.uint32(0x27D4EB2F)):
        h = h ^ (h >> np.uint32(15))
        out += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    frequencies: np.ndarray  # log frequency of each bucket, per language
    centre: np.ndarray  # median familiarity per language
    spread: np.ndarray  # its variance per language: a constant and a part that falls with the number of subwords
    bound: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts @ self.embeddings / max(1, counts.sum())) @ self.weights + self.bias

    def familiarity(self, counts: np.ndarray, k: int) -> float:
        """Deviations by which the subwords' mean log frequency in language k lies above its median."""
        n = max(1, counts.sum())
        return float((counts @ self.frequencies[k] / n - self.centre[k]) / np.sqrt(self.spread[k, 0] + self.spread[k, 1] / n))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected). No letter, or no language learned: und, 0, rejected."""
        if not text or not self.languages or not _LETTER.search(text):
            return UND, 0.0, True
        counts = subword_counts(text, len(self.embeddings))
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), self.familiarity(counts, k) < self.bound


def sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str], list[np.ndarray], list[np.ndarray]]:
    """About ``rows`` labelled texts, as many of each language where there are so many, chosen by a hash of id and language: their languages and sparse counts."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    have = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not have:
        return [], [], [], []
    share = rows / len(have)
    draw = F.create_map(*[x for l, n in have.items() for x in (F.lit(l), F.lit(min(1.0, share / n)))])
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(7), "i", "l"), F.lit(1 << 20)) < draw[F.col("l")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [subword_counts(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            cols = [b.column(0).cast(pa.string()), b.column(1), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([c[x].astype("<f4").tobytes() for c, x in zip(counts, at)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "l", "at", "n"])

    got = drawn.mapInArrow(run, "i string, l string, at binary, n binary").toArrow().sort_by([("i", "ascending"), ("l", "ascending")])
    return sorted(have), got["l"].to_pylist(), [np.frombuffer(x.as_buffer(), "<u2") for x in got["at"]], [np.frombuffer(x.as_buffer(), "<f4") for x in got["n"]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 13) -> LanguageModel:
    """Train on the labelled rows of ``docs``: one in five of the sample calibrates. No labelled row: a model that answers und."""
    languages, labels, at, counts = sample(docs, rows, id_col, text_col, lang_col)
    rng, n_lang = np.random.default_rng(seed), max(1, len(languages))
    e, w, bias = rng.normal(0, 1 / np.sqrt(DIMS), (BUCKETS, DIMS)), np.zeros((DIMS, n_lang)), np.zeros(n_lang)
    model = LanguageModel(languages, e, w, bias, 1.0, np.zeros((n_lang, BUCKETS)), np.zeros(n_lang), np.ones((n_lang, 2)), -np.inf)
    if not labels:
        return model
    y = np.searchsorted(languages, labels)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)

    def dense(rows_: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows_), BUCKETS))
        for r, k in enumerate(rows_):
            x[r, at[k]] = counts[k] / counts[k].sum()
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for s in range(0, len(order), batch):
            rows_ = order[s : s + batch]
            x = dense(rows_)
            h = x @ e
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows_)), y[rows_]] -= 1
            p /= len(rows_)
            dh = p @ w.T
            w -= step * 20 * (h.T @ p)
            bias -= step * p.sum(0)
            used = np.flatnonzero(x.any(0))
            e[used] -= step * 200 * (x[:, used].T @ dh)
    check = np.flatnonzero(held) if held.any() else train
    z = np.concatenate([dense(check[s : s + 256]) @ e @ w + bias for s in range(0, len(check), 256)])
    model.temperature = _temperature(z, y[check])
    _calibrate(model, [(at[k], counts[k], y[k]) for k in train], [(at[k], counts[k], g) for k, g in zip(check, z.argmax(1)) if g == y[k]])
    return model


def _calibrate(model: LanguageModel, train: list[tuple], right: list[tuple]) -> None:
    """Set frequencies, their usual values and the bound. Rows are (buckets, counts, language); ``right`` are the calibration rows that were predicted right."""
    seen = np.zeros_like(model.frequencies)
    for at, n, k in train:
        seen[k, at] += n / n.sum()
    total = np.maximum(seen.sum(1, keepdims=True), 1e-9)
    model.frequencies = np.log((1 - UNSEEN) * seen / total + UNSEEN / BUCKETS)
    rows = [(k, n @ model.frequencies[k, at] / n.sum(), n.sum()) for at, n, k in right if n.sum()]  # a text without subwords has no familiarity
    kinds, mean, size = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0),) * 3
    far = np.zeros(len(rows))
    for k in range(len(model.languages)):
        of = kinds == k
        if not of.any():  # nothing to judge this language by: none is rejected
            model.spread[k, 0] = np.inf
            continue
        model.centre[k] = np.median(mean[of])
        parts = np.stack([np.ones(of.sum()), 1 / size[of]], 1)
        found = np.linalg.lstsq(parts, (mean[of] - model.centre[k]) ** 2, rcond=None)[0]
        model.spread[k] = max(found[0], FLAT), max(found[1], FLAT)
        far[of] = (mean[of] - model.centre[k]) / np.sqrt(parts @ model.spread[k])
    model.bound = float(np.quantile(far, REJECT)) - MARGIN if rows else -np.inf


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on the calibration rows."""
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred, score and rejected added (columns of those names are replaced). Only the text is an input of the prediction."""
    held = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in held)
    at = held.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t.as_py()) for t in b.column(at)]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*held, "lang_pred", "score", "rejected"])

    return docs.select(*held).mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
