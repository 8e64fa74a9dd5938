"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run
over the embedded bytes of each chunk and are max-pooled; the chunks' vectors are combined (largest
and mean of each filter) and a small layer turns them into one probability.

The network is fitted on the driver by Adam, on ``per_class`` labelled documents of each class at
most: those with the smallest hash of their id, one text for each id. Of a text of more than
``fit_chars`` characters it learns from sixteen passages spread evenly over the whole, of so many
characters together; so what the driver takes is bounded. The true share of the classes is put back
into the last bias. Scoring is one pass without a shuffle, over every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_CLASS = 1000
FIT_CHARS = 1 << 16
_PASSAGES = 16
EPOCHS = 6
LEAST_STEPS = 400  # of training, however few documents are labelled
THRESHOLD = 0.3
CHUNK, OVERLAP = 1024, 128
WIDTH, STRIDE = 8, 2
EMBED, FILTERS, HIDDEN = 6, 32, 16
PAD = 256
_CHUNKS_AT_ONCE = 256


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks of ids, padded at the end; one all-padding chunk for an empty text."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    ids = np.full((n - 1) * step + CHUNK, PAD, dtype=np.int16)
    ids[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(ids, CHUNK)[::step]


@dataclass
class ByteNet:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 0) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zeros = lambda n: np.zeros(n, dtype=np.float32)
        embed = rng.standard_normal((PAD + 1, EMBED)).astype(np.float32)
        embed[PAD] = 0
        return cls(embed, draw(WIDTH * EMBED, FILTERS), zeros(FILTERS), draw(2 * FILTERS, HIDDEN), zeros(HIDDEN), draw(HIDDEN, 1)[:, 0], zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, and where."""
        x = self.embed[ids]
        windows = np.lib.stride_tricks.sliding_window_view(x.reshape(len(ids), -1), WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        answers = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(ids), -1, FILTERS)
        at = answers.argmax(axis=1)
        return np.maximum(np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + self.bias, 0), at

    def peaks(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids]
        windows = np.lib.stride_tricks.sliding_window_view(x.reshape(len(ids), -1), WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        answers = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(ids), -1, FILTERS)
        return np.maximum(answers.max(axis=1) + self.bias, 0)

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(features @ self.hidden + self.hidden_bias)
        return h, h @ self.out + self.out_bias[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; memory holds a bounded number of chunks at once."""
        out = np.empty(len(texts))
        waiting, held = [], 0

        def flush() -> None:
            ids = np.concatenate([c for _, c in waiting])
            peaks = np.concatenate([self.peaks(ids[i : i + _CHUNKS_AT_ONCE]) for i in range(0, len(ids), _CHUNKS_AT_ONCE)])
            starts = np.cumsum([0, *(len(c) for _, c in waiting)])[:-1]
            sizes = np.array([[len(c)] for _, c in waiting], dtype=np.float32)
            features = np.concatenate([np.maximum.reduceat(peaks, starts), np.add.reduceat(peaks, starts) / sizes], axis=1)
            out[[k for k, _ in waiting]] = 1 / (1 + np.exp(-np.clip(self.head(features)[1].astype(np.float64), -30, 30)))

        for k, raw in enumerate(texts):
            waiting.append((k, own := chunks_of(raw)))
            held += len(own)
            if held >= _CHUNKS_AT_ONCE:
                flush()
                waiting, held = [], 0
        if waiting:
            flush()
        return out

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        ids = np.concatenate(docs)
        peaks, at = self.pooled(ids)
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum([0, *sizes])[:-1]
        owner = np.repeat(np.arange(len(docs)), sizes)
        top = np.maximum.reduceat(peaks, starts)
        features = np.concatenate([top, np.add.reduceat(peaks, starts) / sizes[:, None]], axis=1).astype(np.float32)
        h, logit = self.head(features)
        d_logit = (weight * (1 / (1 + np.exp(-logit)) - labels) / len(docs)).astype(np.float32)
        d_h = d_logit[:, None] * self.out * (1 - h * h)
        d_features = d_h @ self.hidden.T
        winners = peaks == top[owner]
        d_peaks = d_features[owner, :FILTERS] * winners / np.add.reduceat(winners, starts, dtype=np.float32)[owner] + (d_features[:, FILTERS:] / sizes[:, None])[owner]
        d_peaks = (d_peaks * (peaks > 0)).astype(np.float32)
        # only the place of a filter's largest answer passes a gradient on
        where = at[:, :, None] * STRIDE + np.arange(WIDTH)
        seen = ids[np.arange(len(ids))[:, None, None], where]
        patches = self.embed[seen].reshape(len(ids), FILTERS, -1)
        d_filters = np.einsum("cfk,cf->kf", patches, d_peaks)
        d_bytes = (d_peaks[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(seen.ravel(), weights=d_bytes[:, e], minlength=PAD + 1) for e in range(EMBED)], axis=1)
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_peaks.sum(axis=0), features.T @ d_h, d_h.sum(axis=0), h.T @ d_logit, d_logit.sum(keepdims=True)]


def fit(texts: list[bytes], labels: list[int], share: float, epochs: int = EPOCHS, batch: int = 32, rate: float = 3e-3, seed: int = 0) -> ByteNet:
    """A network for documents of which ``share`` have label 1. Without both labels it answers with that share."""
    net, rng = ByteNet.fresh(seed), np.random.default_rng(seed + 1)
    y = np.array(labels, dtype=np.float32)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = np.log(share / (1 - share))
        return net
    docs = [chunks_of(t) for t in texts]
    first, second, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(docs)))
    total = epochs * -(-len(docs) // batch)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # both classes count alike
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), batch):
            own = order[i : i + batch]
            step += 1
            speed = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for w, g, m, v in zip(net.weights(), net.gradients([docs[k] for k in own], y[own], weight[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.out_bias += np.float32(np.log(share / (1 - share)))
    return net


def held_out(id_col: str):
    """Rows kept from training: CRC-32 of the id as text is a multiple of five."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, epochs: int, fit_chars: int) -> ByteNet:
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    marked = marked.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = max(1, fit_chars // _PASSAGES)
    step = (F.length("text") - size) / (_PASSAGES - 1)
    passages = F.concat(*(F.substring("text", F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(_PASSAGES)))
    texts = texts.join(picked, "doc_id").select("doc_id", "label", F.when(F.length("text") > fit_chars, passages).otherwise(F.col("text")).alias("text"))
    rows = sorted(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect(), key=lambda r: r.doc_id)  # 2 * per_class at most
    n = sum(counts.values())
    return fit([r.text.encode() for r in rows], [r.label for r in rows], counts.get(1, 0) / n if n else 0.5, epochs)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, epochs: int = EPOCHS, threshold: float = THRESHOLD, fit_chars: int = FIT_CHARS
) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    A null or empty text is scored as padding alone. Labels other than 0 and 1 and rows without
    an id teach nothing; an id with both labels counts as 1. Without labels of both kinds every
    score is the share of label 1 (0.5 without any). A null id is not held out. Repeated rows get
    equal scores; an id teaches once, by the smallest of its texts. Texts of any length are scored
    whole, some chunks at a time. An empty table gives no rows. Only the bytes of the text enter a score.
    """
    net = fit_on(docs, labels, id_col, text_col, label_col, per_class, epochs, fit_chars)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = net.score([(t.as_py() or "").encode() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
