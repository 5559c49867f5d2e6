"""What the two classifiers share: a bounded sample of labelled rows, Adam, and scoring."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes, write_table

#: Labelled rows that a model is fitted on at most, the ones with the least hash of their identifier.
SAMPLE_ROWS = 6000
#: Bytes of text that a model is fitted on at most.
SAMPLE_BYTES = 48 << 20


def remainder(key: F.Column, divisor: int) -> F.Column:
    """crc32 of the identifier as text, modulo divisor."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[F.Column], F.Column], rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text",
    size: int = SAMPLE_BYTES,
) -> list[tuple[int, bytes, int]]:
    """(identifier, UTF-8 text, label) of at most `rows` rows and `size` bytes among those that learn() allows, in order of the
    identifier. Rows without an identifier or a label are left out; of several labels for one identifier the largest counts, of
    several texts the one that sorts first. Identifiers come in order of their hash; a text that no longer fits is passed over."""
    some = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & learn(F.col(key)))
    some = some.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = text_bytes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    # `rows` rows bound the broadcast and the table; repeats of an identifier end in the aggregation
    found = texts.join(F.broadcast(some), "key").groupBy("key").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"), F.max("label").alias("label"))
    found = write_table(found, "sample")
    left, kept = size, []
    for r in found.select("key", F.octet_length("text").alias("n")).orderBy(F.xxhash64("key"), "key").collect():
        if r["n"] <= left:
            left -= r["n"]
            kept.append(r["key"])
    if len(kept) < found.count():
        found = found.join(F.broadcast(found.sparkSession.createDataFrame([(k,) for k in kept], found.select("key").schema)), "key")
    return sorted((r["key"], bytes(r["text"]), r["label"]) for r in found.collect())


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (self.rate * fix * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut with the greatest F1 of the rarer class's side, midway to the next logit; ties: the middle one."""
    order = np.argsort(logit)
    z, y = logit[order], label[order]
    flip = y.mean() > 0.5
    y = 1 - y if flip else y
    hits = y.sum() - np.concatenate([[0], np.cumsum(y)]) if not flip else np.concatenate([[0], np.cumsum(y)])
    taken = len(y) - np.arange(len(y) + 1) if not flip else np.arange(len(y) + 1)
    f1 = 2 * hits / np.maximum(1, taken + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = int(best[len(best) // 2])
    if 0 < i < len(z):
        return float((z[i - 1] + z[i]) / 2)
    return float(z[0] - 1 if i == 0 else z[-1] + 1)


def is_calibration(key: int) -> bool:
    """A fifth of the rows of the sample, set aside for thresholds and early stopping; not by the remainders that hold rows out."""
    return zlib.crc32(f"calibrate {key}".encode()) % 5 == 0


def score(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every document; make() gives a function from texts to scores. A null text counts as empty."""
    df = text_bytes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def begin():
        run = make()

        def step(batch: dict[str, list]) -> dict[str, list]:
            texts = [t or b"" for t in batch["text"]]
            return {"key": batch["key"], "score": bounded(run, texts)}

        return step

    return map_rows(df, begin, f"key {dict(df.dtypes)['key']}, score double").withColumnRenamed("key", key)


def bounded(run: Callable[[list[bytes]], np.ndarray], texts: list[bytes], size: int = 1 << 20) -> list[float]:
    """run over groups of texts of about `size` bytes, so that its arrays stay small; a single longer text is one group."""
    out, group, held = [], [], 0
    for t in texts:
        group.append(t)
        held += len(t) + 64
        if held >= size:
            out += run(group).tolist()
            group, held = [], 0
    return out + (run(group).tolist() if group else [])
