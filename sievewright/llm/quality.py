"""Quality: a byte-level convolutional network, trained in numpy.

Bytes are embedded, learned filters of width 5 run over the whole document, and each filter is rectified and max-pooled in
overlapping chunks of 256 bytes, a new one every 192. A hidden layer turns the pooled filters of a chunk into chunk
features, which are pooled over all chunks by their maximum and their mean and combined into one probability.
The cut between the classes is calibrated on rows set aside and moved to a score of 0.5. Neither labels nor lang, source
or doc_id are inputs of a score.

Edge cases: an empty text is one chunk of padding; without labels of both kinds every score is the smoothed share of good
rows; repeated rows get equal scores, whatever rows are scored with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import Adam, best_threshold, is_calibration, labelled_sample, remainder, score, sigmoid

WIDTH, DIM, FILTERS, HIDDEN = 5, 8, 32, 16
#: Zeros between texts: as many places as a filter reaches ahead.
PAD = WIDTH - 1
#: Chunks are runs of segments: CHUNK segments of SEGMENT bytes, a chunk every STRIDE segments.
SEGMENT, CHUNK, STRIDE = 64, 4, 3
EPOCHS, BATCH, SEED = 8, 32, 11
#: Labelled rows the network is fitted on at most.
SAMPLE_ROWS = 4000


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text with PAD zeros before it and padded with zeros to whole segments, and PAD zeros at the end, so that
    no filter reaches from one text into another; the first segment of each chunk, its last one, and the first chunk of each
    text. Every segment is in a chunk, so that chunks cover the whole document."""
    size = np.array([-(-(len(t) + PAD) // SEGMENT) for t in texts], np.int64)
    data = b"".join(bytes(PAD) + t + bytes(int(n) * SEGMENT - len(t) - PAD) for t, n in zip(texts, size, strict=True)) + bytes(PAD)
    chunks = np.maximum(1, -(-(size - CHUNK) // STRIDE) + 1)
    first_chunk = np.cumsum(chunks) - chunks
    place = np.arange(int(chunks.sum())) - np.repeat(first_chunk, chunks)
    base = np.cumsum(size) - size
    begin = np.repeat(base, chunks) + place * STRIDE
    end = np.minimum(begin + CHUNK, np.repeat(base + size, chunks))
    return np.frombuffer(data, np.uint8), begin, end, first_chunk


@dataclass
class Model:
    params: dict[str, np.ndarray]
    cut: float = 0.0
    prior: float | None = None

    def taps(self) -> np.ndarray:
        """What each byte adds to each filter at each place; byte 0, the padding, adds nothing."""
        out = np.einsum("bd,jdf->jbf", self.params["e"], self.params["w"]).astype(np.float32)
        out[:, 0] = 0
        return out

    def activations(self, data: np.ndarray, taps: np.ndarray) -> np.ndarray:
        """The filters at every place of data but the last PAD ones."""
        n = len(data) - PAD
        y = taps[0][data[:n]]
        for j in range(1, WIDTH):
            y += taps[j][data[j : n + j]]
        return y

    def chunk_max(self, segments: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = np.maximum(end - 1, begin)
        return np.maximum.reduce([segments[np.minimum(begin + j, last)] for j in range(CHUNK)])

    def logits(self, texts: list[bytes], taps: np.ndarray) -> np.ndarray:
        p = self.params
        data, begin, end, first = layout(texts)
        # groups of segments keep the activations small for very long texts
        step = 1 << 12
        parts = []
        for i in range(0, len(data) - PAD, step * SEGMENT):
            y = self.activations(data[i : i + step * SEGMENT + PAD], taps)
            parts.append(y.reshape(-1, SEGMENT, FILTERS).max(1))
        pooled = np.maximum(self.chunk_max(np.concatenate(parts), begin, end) + p["b"], 0)
        # sums in one order whatever the batch: a matrix product's order depends on its size
        hidden = np.tile(p["hb"], (len(pooled), 1))
        for f in range(FILTERS):
            hidden += pooled[:, f : f + 1] * p["h"][f]
        hidden = np.maximum(hidden, 0)
        n = np.diff(np.concatenate([first, [len(begin)]]))
        mean = np.add.reduceat(hidden, first, axis=0) / n[:, None]
        return (np.hstack([np.maximum.reduceat(hidden, first, axis=0), mean]) * p["v"]).sum(1) + p["c"]

    def scorer(self):
        taps = None if self.prior is not None else self.taps()

        def run(texts: list[bytes]) -> np.ndarray:
            if taps is None:
                return np.full(len(texts), self.prior)
            return sigmoid(self.logits(texts, taps) - self.cut).astype(np.float64)

        return run


def batch_step(model: Model, adam: Adam, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> None:
    p, taps = model.params, model.taps()
    data, begin, end, first = layout(texts)
    y = model.activations(data, taps).reshape(-1, SEGMENT, FILTERS)
    where = y.argmax(1) + (np.arange(len(y)) * SEGMENT)[:, None]
    segments = y.max(1)
    last = np.maximum(end - 1, begin)
    members = np.minimum(begin[:, None] + np.arange(CHUNK), last[:, None])  # chunks, CHUNK
    pick = segments[members].argmax(1)  # chunks, FILTERS
    seg = np.take_along_axis(members, pick, 1)
    raw = np.take_along_axis(segments, seg, 0) + p["b"]
    at = np.take_along_axis(where, seg, 0)
    pooled = np.maximum(raw, 0)
    pre = pooled @ p["h"] + p["hb"]
    hidden = np.maximum(pre, 0)
    n = np.diff(np.concatenate([first, [len(begin)]]))
    doc = np.repeat(np.arange(len(texts)), n)
    top = np.maximum.reduceat(hidden, first, axis=0)
    feats = np.hstack([top, np.add.reduceat(hidden, first, axis=0) / n[:, None]])
    g = ((sigmoid(feats @ p["v"] + p["c"]) - label) * weight).astype(np.float32) / len(texts)
    grads = {"v": feats.T @ g + 1e-4 * p["v"], "c": np.array(g.sum(), np.float32)}
    gf = np.outer(g, p["v"])
    share = (hidden == top[doc]) & (hidden > 0)
    ties = np.maximum(1, np.add.reduceat(share, first, axis=0, dtype=np.int64))
    gh = gf[doc][:, :HIDDEN] * share / ties[doc] + gf[doc][:, HIDDEN:] / n[doc][:, None]
    gh = (gh * (pre > 0)).astype(np.float32)
    grads["h"], grads["hb"] = pooled.T @ gh + 1e-4 * p["h"], gh.sum(0)
    gp = (gh @ p["h"].T) * (raw > 0)
    grads["b"] = gp.sum(0)
    c, f = np.nonzero(gp)
    value = gp[c, f].astype(np.float32)
    gw, ge = np.zeros_like(p["w"]), np.zeros_like(p["e"])
    flat = at[c, f][:, None] + np.arange(WIDTH)
    b = data[flat]
    for j in range(WIDTH):
        rows = p["e"][b[:, j]] * (b[:, j] > 0)[:, None] * value[:, None]
        order = np.zeros((FILTERS, DIM), np.float32)
        np.add.at(order, f, rows)
        gw[j] = order.T
        np.add.at(ge, b[:, j], p["w"][j].T[f] * value[:, None])
    ge[0] = 0
    grads["w"], grads["e"] = gw + 1e-5 * p["w"], ge
    adam.step(grads)


def train(rows: list[tuple[int, bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    label = np.array([y for _, _, y in rows], np.float32)
    if len(set(label.tolist())) < 2:
        return Model({}, prior=float((label.sum() + 0.9) / (len(label) + 1)))
    held = np.array([is_calibration(k) for k, _, _ in rows])
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held[:] = False
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.5, (256, DIM)),
        "w": rng.normal(0, 0.35, (WIDTH, DIM, FILTERS)),
        "b": np.zeros(FILTERS),
        "h": rng.normal(0, 0.25, (FILTERS, HIDDEN)),
        "hb": np.full(HIDDEN, 0.1),
        "v": rng.normal(0, 0.3, 2 * HIDDEN),
        "c": np.array(0.0),
    }
    model = Model({k: v.astype(np.float32) for k, v in p.items()})
    adam = Adam(model.params, 0.005)
    texts = [t for _, t, _ in rows]
    learn = np.flatnonzero(~held)
    check = np.flatnonzero(held) if held.any() else learn
    rare = label[learn].mean() < 0.5
    share = float(np.clip(label[learn].mean() if rare else 1 - label[learn].mean(), 0.02, 0.5))
    weight = np.where((label == 1) == rare, 0.5 / share, 0.5 / (1 - share))
    best, kept = np.inf, None
    epochs = max(epochs, -(-600 * BATCH // len(learn)) if len(learn) < 2000 else 0)
    for epoch in range(epochs):
        order = rng.permutation(learn)
        # texts of like length in a batch
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            batch_step(model, adam, [texts[k] for k in some], label[some], weight[some])
        adam.rate = 0.005 * (1 - epoch / epochs)
        z = evaluate(model, [texts[i] for i in check])
        loss = float(np.mean(weight[check] * (np.logaddexp(0, z) - label[check] * z)))
        if loss < best:
            best, kept = loss, {k: v.copy() for k, v in model.params.items()}
    model.params = kept
    model.cut = best_threshold(evaluate(model, [texts[i] for i in check]), label[check])
    return model


def evaluate(model: Model, texts: list[bytes]) -> np.ndarray:
    taps = model.taps()
    return np.concatenate([model.logits(texts[i : i + 64], taps) for i in range(0, len(texts), 64)])


def held_out(key: F.Column) -> F.Column:
    """Rows whose labels must not be learned from."""
    return remainder(key, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `rows` labelled rows that are not held out."""
    return train(labelled_sample(docs, labels, "quality", lambda k: ~held_out(k), rows))


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row, from its whole text, however long. Null and empty texts have the score of a text without words;
    equal texts have equal scores; rows that repeat an identifier are scored each. An empty table gives no rows. Columns beside
    the identifier and the text are not read, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score(docs, lambda: held.value.scorer(), key, text)
