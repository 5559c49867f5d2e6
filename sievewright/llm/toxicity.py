"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's embedding is made of rows of three tables: two found by hashes of the word, so that two words rarely share both,
and one by a hash of its beginning, so that inflected forms share it. Filters of
widths 1, 2 and 3 run over the words, rectified and max-pooled over the whole text; a linear layer gives a logit. The
threshold is calibrated for each language on rows set aside, the language being guessed from the text's function words,
and moved to a score of 0.5. Neither labels nor lang, source or doc_id are inputs of a score.

Edge cases: a text without words is scored from padding alone; without labels of both kinds every score is the smoothed
share of toxic rows; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, unused, without, word_hashes, words
from .learning import SAMPLE_ROWS, Adam, best_threshold, bounded, is_calibration, labelled_sample, score, sigmoid

BUCKETS = 1 << 15
DIM = 4
TABLES = ("a", "b", "s")
STEM = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS, BATCH = 5, 32
SEED = 7
#: Positive rows that a language needs for a threshold of its own.
LEAST_POSITIVE = 8

#: Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with they be at this have from or had by not but what all were we when".split(),
    "fr": "le la les des du et un une dans que qui pour pas sur au avec il ce est par plus ne se sont mais aux".split(),
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "es": "el los las y que del en un una por con no para se su al lo como más pero sus le ya o este sí porque".split(),
}


def language(ws: list[bytes]) -> str:
    """The language whose function words are most frequent; en for none."""
    counts = {lang: sum(map(VOTES[lang].__contains__, ws)) for lang in VOTES}
    return max(counts, key=lambda k: counts[k])


VOTES = {lang: {w.encode() for w in ws} for lang, ws in FUNCTION_WORDS.items()}


@dataclass
class Model:
    params: dict[str, np.ndarray]
    thresholds: dict[str, float]
    scale: float = 1.0
    prior: float | None = None

    def tables(self) -> list[np.ndarray]:
        """What each bucket adds to each filter at each place: (BUCKETS + 1) rows, the last one padding."""
        p = self.params
        out = []
        for i, name in enumerate(TABLES):
            cols = [p[name] @ p[f"w{w}"][j, i * DIM : (i + 1) * DIM] for w in WIDTHS for j in range(w)]
            out.append(np.vstack([np.hstack(cols), np.zeros((1, len(cols) * FILTERS), np.float32)]).astype(np.float32))
        return out

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Max-pooled, rectified filters of texts whose words begin at `starts`; each text has max(WIDTHS) words at least."""
        x = tables[0][ids[0]]
        for t, i in zip(tables[1:], ids[1:], strict=True):
            x += t[i]
        n, out, at = len(x), [], 0
        ends = np.concatenate([starts[1:], [n]])
        for w in WIDTHS:
            y = x[:, at : at + FILTERS].copy()
            for j in range(1, w):
                y[: n - j] += x[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
                y[ends - j] = -np.inf  # the run would reach into the next text
            out.append(np.maximum(np.maximum.reduceat(y, starts, axis=0) + self.params[f"b{w}"], 0))
            at += w * FILTERS
        return np.hstack(out)

    def logits(self, texts: list[list[bytes]], tables: list[np.ndarray]) -> np.ndarray:
        return self.output(*indexed(texts), tables)

    def output(self, ids: np.ndarray, starts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        # sums in one order whatever the batch: a matrix product's order depends on its size
        return (self.pooled(ids, starts, tables) * self.params["v"]).sum(1) + self.params["c"]

    def scorer(self):
        tables = None if self.prior is not None else self.tables()

        def run(texts: list[bytes]) -> np.ndarray:
            if tables is None:
                return np.full(len(texts), self.prior)
            ws = [words(t) for t in texts]
            cut = np.array([self.thresholds.get(language(w), self.thresholds[""]) for w in ws])
            return sigmoid(self.scale * (self.logits(ws, tables) - cut)).astype(np.float64)

        return run


def indexed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every word, a row for each table, and where each text begins; short texts are padded."""
    flat = [w for ws in texts for w in ws]
    h, stem = word_hashes(flat), word_hashes([w[:STEM] for w in flat])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.maximum(size, max(WIDTHS))
    starts = np.cumsum(full) - full
    ids = np.full((len(TABLES), int(full.sum())), BUCKETS, np.int32)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(flat))
    low = np.uint64(BUCKETS - 1)
    for row, values in zip(ids, (h & low, (h >> np.uint64(32)) & low, stem & low), strict=True):
        row[at] = values.astype(np.int32)
    return ids, starts


def index_rows(rows: list[tuple[int, bytes, int]], group: int = 64) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """indexed() of many texts, and their languages: words live for a group of texts only, so that what stays is 4 bytes a
    word and table."""
    parts, starts, langs, at = [], [], [], 0
    for i in range(0, len(rows), group):
        ws = [words(t) for _, t, _ in rows[i : i + group]]
        ids, begin = indexed(ws)
        parts.append(ids)
        starts.append(begin + at)
        at += ids.shape[1]
        langs += map(language, ws)
    return np.concatenate(parts, axis=1), np.concatenate(starts), langs


def log_odds(buckets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a bucket's texts, shrunk where they are few: where training starts from."""
    counts = np.zeros((2, BUCKETS))
    for ids, y in zip(buckets, label, strict=True):
        counts[y, ids[ids < BUCKETS]] += 1
    share = label.mean()
    expected = counts.sum(0) * share
    return (np.log((counts[1] + 2 * share) / (expected + 2 * share)) / 2).clip(-2, 2).astype(np.float32)


def train(rows: list[tuple[int, bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    label = np.array([y for _, _, y in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return Model({}, {}, prior=float((label.sum() + 0.1) / (len(label) + 1)))
    held = np.array([is_calibration(k) for k, _, _ in rows])
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held[:] = False
    rng = np.random.default_rng(seed)
    ids, starts, langs = index_rows(rows)
    ends = np.concatenate([starts[1:], [ids.shape[1]]])
    learn = np.flatnonzero(~held)
    p = {n: rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) for n in TABLES}
    for row, n in zip(ids, TABLES, strict=True):
        p[n][:, 0] = log_odds([np.unique(row[starts[i] : ends[i]]) for i in learn], label[learn])
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, 0.2, (w, len(TABLES) * DIM, FILTERS)).astype(np.float32)
        p[f"w{w}"][:, ::DIM, : FILTERS // 2] += 1 / w
        p[f"b{w}"] = np.full(FILTERS, -0.2, np.float32)
    p["v"] = np.where(np.arange(FILTERS * len(WIDTHS)) % FILTERS < FILTERS // 2, 0.3, 0.05).astype(np.float32)
    p["c"] = np.array(-2.0, np.float32)
    dense, model = {k: v for k, v in p.items() if k not in TABLES}, Model(p, {"": 0.0})
    adam = Adam(dense, 0.01)
    best, kept = np.inf, None
    check = np.flatnonzero(held) if held.any() else learn
    for _ in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), BATCH):
            batch_step(p, adam, order[i : i + BATCH], ids, starts, ends, label)
        z = each_logit(model, check, ids, starts, ends)
        loss = float(np.mean(np.logaddexp(0, z) - label[check] * z))
        if loss < best:
            best, kept = loss, {k: v.copy() for k, v in p.items()}
    model.params = kept
    z = each_logit(model, check, ids, starts, ends)
    langs = np.array(langs)[check]
    thresholds = {"": best_threshold(z, label[check])}
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        if label[check][own].sum() >= LEAST_POSITIVE and (label[check][own] == 0).any():
            thresholds[lang] = best_threshold(z[own], label[check][own])
    model.thresholds = thresholds
    return model


def each_logit(model: Model, docs: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    tables, zero = model.tables(), np.zeros(1, np.int64)
    return np.concatenate([model.output(ids[:, starts[d] : ends[d]], zero, tables) for d in docs])


def batch_step(p: dict, adam: Adam, docs: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, label: np.ndarray) -> None:
    """One step of Adam on filters and output and of plain descent on the embeddings that were pooled."""
    size = ends[docs] - starts[docs]
    own = np.cumsum(size) - size
    at = np.repeat(starts[docs] - own, size) + np.arange(int(size.sum()))
    ids = ids[:, at]
    x = np.hstack([rows_of(p[t], row) for t, row in zip(TABLES, ids, strict=True)])
    n, stop = len(x), np.concatenate([own[1:], [len(x)]])
    pooled, places = [], []
    for w in WIDTHS:
        y = sum((np.vstack([x[j:], np.zeros((j, x.shape[1]), np.float32)]) @ p[f"w{w}"][j] for j in range(w)), np.zeros((n, FILTERS), np.float32))
        for j in range(1, w):
            y[stop - j] = -np.inf
        top = np.maximum.reduceat(y, own, axis=0)
        where = np.empty((len(docs), FILTERS), np.int64)
        for d in range(len(docs)):
            where[d] = own[d] + y[own[d] : stop[d]].argmax(0)
        pooled.append(np.maximum(top + p[f"b{w}"], 0))
        places.append(where)
    h = np.hstack(pooled)
    g = (sigmoid(h @ p["v"] + p["c"]) - label[docs]).astype(np.float32) / len(docs)
    grads = {"v": h.T @ g + 1e-4 * p["v"], "c": np.array(g.sum(), np.float32)}
    gx = np.zeros_like(x)
    for i, w in enumerate(WIDTHS):
        gh = np.outer(g, p["v"][i * FILTERS : (i + 1) * FILTERS]) * (pooled[i] > 0)
        grads[f"b{w}"] = gh.sum(0)
        gw = np.zeros_like(p[f"w{w}"])
        for j in range(w):
            rows = x[places[i] + j]  # documents, filters, dims
            gw[j] = np.einsum("dfk,df->kf", rows, gh)
            np.add.at(gx, places[i] + j, gh[:, :, None] * p[f"w{w}"][j].T[None])
        grads[f"w{w}"] = gw + 1e-4 * p[f"w{w}"]
    adam.step(grads)
    used = np.flatnonzero(gx.any(1))
    for i, (name, row) in enumerate(zip(TABLES, ids, strict=True)):
        some = used[row[used] < BUCKETS]
        np.subtract.at(p[name], row[some], 0.5 * gx[some, i * DIM : (i + 1) * DIM])


def rows_of(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = table[np.minimum(ids, BUCKETS - 1)]
    out[ids == BUCKETS] = 0
    return out


def held_out(key: F.Column) -> F.Column:
    """Rows whose labels must not be learned from."""
    from .learning import remainder

    return remainder(key, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows that are not held out."""
    return train(labelled_sample(docs, labels, "toxic", lambda k: ~held_out(k), rows))


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row, from its whole text, however long. Null and empty texts have the score of a text without words;
    equal texts have equal scores; rows that repeat an identifier are scored each. An empty table gives no rows. Columns beside
    the identifier and the text are not read, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score(docs, lambda: held.value.scorer(), key, text)


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a further column of scores; a column of that name gives way to it."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, name)
    raw = unused("raw", docs.columns)
    df = docs.withColumn(raw, F.col(text).cast("binary"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)

    def make():
        run = held.value.scorer()

        def step(batch: dict[str, list]) -> dict[str, list]:
            return {**batch, name: bounded(run, [t or b"" for t in batch[raw]])}

        return step

    return map_rows(df, make, f"{schema}, `{name}` double")
