"""Compression classifier of quality.

Zstandard dictionaries of `DICTIONARIES` sizes are built from good and from bad labelled texts. A text is compressed in blocks with each; the difference of a
pair's compressed sizes, divided by the text's size, is its feature. A short text has little to compress, so `PRIOR_BYTES` bytes with the difference that training texts have
on average are added to each text. Logistic regression on the differences, and on nothing else, gives a calibrated score.

Learning takes a bounded sample: at most `PER_CLASS` rows of each class, those of the smallest hashes of their ids, and of each text the window of
`PIECE` characters that a hash of the id chooses among all of its windows. Half of it builds the dictionaries, the other half calibrates, weighted by the
classes' shares in all training labels. Where a class has fewer than `TRAINER` blocks, or they come to less than eight dictionaries' bytes, the trainer of
dictionaries has too little to work on, and the dictionary is an even share of each block; this concerns fitting only. Rows whose crc32(id) modulo `FOLDS` is 0 are
held out of both. Scoring reads whole texts and nothing but the text.

Defined cases: a null text counts as empty, an empty one gets the score of the average difference; an id with contradicting labels, a null
label or a null id is not learnt from; with one class only in the training labels, or fewer than two texts of a class, the score is the share of good labels; without
any it is 0.5; repeated rows get the same score; rows with a null id are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlake.llm.common import bounded, fold, per_row

FOLDS = 5
PER_CLASS = 1200
PIECE = 20_000
CUT = 0.3
#: Bytes of the dictionaries, and of the blocks that are compressed by themselves.
DICTIONARIES = (16 << 10, 32 << 10, 64 << 10)
BLOCK = 256
LEVEL = 3
PRIOR_BYTES = 64
TRAINER = 64


def _blocks(text: str | None) -> Iterator[memoryview]:
    data = memoryview((text or "").encode())
    for at in range(0, len(data), BLOCK):
        yield data[at : at + BLOCK]


def window(text: Column, key: Column, size: int, salt: int) -> Column:
    """The window of `size` characters of a text that a hash of the key chooses among all of them, of which the last ends where the text ends; a shorter text is its own window."""
    windows = F.greatest(F.ceil(F.length(text) / size), F.lit(1))
    begin = F.least(F.pmod(F.xxhash64(F.lit(salt), key), windows) * size, F.greatest(F.length(text) - size, F.lit(0)))
    return F.substring(text, (begin + 1).cast("int"), F.lit(size))


def build_dictionary(texts: list[str], size: int) -> bytes:
    """The trainer's dictionary, or an even share of each block where there are too few."""
    samples = [bytes(b) for t in texts for b in _blocks(t)]
    if len(samples) >= TRAINER and sum(map(len, samples)) >= 8 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    share = max(64, size // max(1, len(samples)))
    return b"".join(s[:share] for s in samples)[:size]


class Compressors:
    """Compressed sizes under pairs of dictionaries, of good and of bad texts."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [(self._with(good), self._with(bad)) for good, bad in pairs]

    @staticmethod
    def _with(data: bytes) -> zstandard.ZstdCompressor:
        kept = zstandard.ZstdCompressionDict(data or b"\0" * 8)
        kept.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False)

    def differences(self, text: str | None) -> tuple[np.ndarray, int]:
        """By how many bytes the bad dictionary of each pair makes the text larger than the good one, and the text's bytes."""
        size, found = 0, np.zeros(len(self.pairs))
        for block in _blocks(text):
            size += len(block)
            for i, (good, bad) in enumerate(self.pairs):
                found[i] += len(bad.compress(block)) - len(good.compress(block))
        return found, size


class Logistic:
    """Weighted logistic regression on scaled features, by Newton's method; the intercept comes first in beta."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4):
        self.mean = x.mean(axis=0)
        self.scale = np.where((spread := x.std(axis=0)) > 1e-12, spread, 1.0)
        a, self.beta = self._with_one(x), np.zeros(x.shape[1] + 1)
        penalty = ridge * weight.sum() * np.r_[1e-6, np.ones(x.shape[1])]
        for _ in range(60):
            p = self._sigmoid(a @ self.beta)
            hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - penalty * self.beta)
            self.beta += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(x), 1)), (x - self.mean) / self.scale), axis=1)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def __call__(self, x) -> float:
        return float(self._sigmoid(self._with_one(np.atleast_2d(x)) @ self.beta)[0])


class Model:
    """`share` is the share of good labels and the score of every text without `regression`; `prior` holds the average differences by byte."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], share: float, prior: np.ndarray, regression: Logistic | None):
        self.pairs, self.share, self.prior, self.regression = pairs, share, prior, regression
        self.compressors: Compressors | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def features(self, differences: np.ndarray, size: int) -> np.ndarray:
        return (differences + PRIOR_BYTES * self.prior) / (size + PRIOR_BYTES)

    def score(self, text: str | None) -> float:
        if self.regression is None:
            return self.share
        if self.compressors is None:
            self.compressors = Compressors(self.pairs)
        return self.regression(self.features(*self.compressors.differences(text)))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Bounded windows of texts of each class, in the order of their ids' hashes, and the classes' sizes."""
    known = (
        labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
        .where(fold(F.col("k"), FOLDS) != 0).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order: dict[int, tuple[int, int]] = {}  # id to class and place, 2 * per_class of them at most
    for y, n in sorted(sizes.items()):
        chosen = known.where(F.col("y") == y).withColumn("h", F.xxhash64(F.lit(7), "k"))
        if n > 2 * per_class:  # a first cut, so that the top-k has little to order
            chosen = chosen.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * 2 * per_class / n))
        order |= {r["k"]: (y, i) for i, r in enumerate(chosen.orderBy("h", "k").limit(per_class).collect())}
    texts: dict[int, list[str]] = {0: [], 1: []}
    if order:
        key_, text_ = F.col(key).cast("long"), F.col(text)
        rows = docs.select(key_.alias("k"), window(text_, key_, PIECE, 13).alias("t")).where(F.col("k").isin(list(order)) & (F.length("t") > 0))
        found = rows.groupBy("k").agg(F.min("t").alias("t")).collect()
        for r in sorted(found, key=lambda r: order[r["k"]]):
            texts[order[r["k"]][0]].append(r["t"])
    return texts, sizes


def fit(texts: dict[int, list[str]], sizes: dict[int, int]) -> Model:
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if min(map(len, texts.values())) < 2:
        return Model([], share, np.zeros(0), None)
    pairs = [tuple(build_dictionary(texts[y][::2], size) for y in (1, 0)) for size in DICTIONARIES]
    compressors = Compressors(pairs)
    x = [compressors.differences(t) for y in (0, 1) for t in texts[y][1::2]]
    y = np.array([y for y in (0, 1) for _ in texts[y][1::2]], dtype=float)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    weight /= weight.sum()
    model = Model(pairs, share, weight @ np.array([d / size for d, size in x]), None)
    model.regression = Logistic(np.array([model.features(*f) for f in x]), y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    return fit(*sample(docs, labels, key, text, label, per_class))


def score_quality(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def row(k, t, held):
        score = held.score(t)
        return k, score, int(score >= cut)

    scored = per_row(df, [key, text], row, f"{key} long, score double, predicted int", lambda: {"held": held.value})
    return scored.select(key, F.coalesce(fold(F.col(key), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows that score at least `cut`, with all their columns."""
    held, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        for batch in bounded(batches):
            good = [held.value.score(t) >= cut for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
