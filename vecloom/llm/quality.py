"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded from character
and word statistics and hashed words; a gated attention, learned from document labels alone,
weighs the passages, and a logistic layer scores the weighted sum of their representations.

The model is fitted on the driver from all passages of at most `sample` labelled documents
(those with the least hash of their id); scoring takes every passage of every document. Only the
text enters a score, and a text's score doesn't depend on the batch or partition it comes in.

Edge cases: null and empty texts, and texts without words, are one passage of zeros; without
labels of both classes every score is the share of label 1 (0.5 if there are no labels);
repeated rows score alike; of several labels of one id the largest counts, and rows that share an
id are each learned with it; null ids count as held out and are never learned from; a very long
text is many passages, of which the driver holds those of the sample (about as many bytes as the
text); tables without rows give none; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.hashing import chunks, word_hashes

PASSAGE_WORDS = 64
HASHED = 64
SAMPLE = 4000
HIDDEN, GATES = 16, 8
FOLDS = 5
#: Rows of a matrix product: fixed, so that no sum depends on how many passages come together.
PRODUCT_ROWS = 256
#: Bytes of each kind whose share of a passage is a feature.
KINDS = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:", b"!?", b"#$%&*", b"|/\\_=+<>{}[]~^", b"\"'()-", b"\n", bytes(range(128, 192)), bytes(range(192, 256))]
N_FEATURES = len(KINDS) + 7 + HASHED
_KIND_TABLES = [np.isin(np.arange(256), list(k)).astype(np.uint8) for k in KINDS]


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each passage (every row has one at least) and its features."""
    rows = len(starts) - 1
    row, h, first, end = word_hashes(data, starts)
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, int)
    base = np.cumsum(count) - count
    index = np.arange(len(row)) - base[row]
    new = np.flatnonzero(index % PASSAGE_WORDS == 0)
    empty = np.flatnonzero(count == 0)
    n = len(new)
    x = np.zeros((n + len(empty), N_FEATURES), np.float32)
    if n:
        lo = first[new]
        hi = end[np.append(new[1:] - 1, len(end) - 1)]
        size, words = (hi - lo).astype(np.float32), np.diff(np.append(new, len(row))).astype(np.float32)
        cuts = np.stack([lo, hi], axis=1).ravel()
        padded = np.append(data, np.uint8(0))  # the last passage may end with the data
        for k, kind in enumerate(_KIND_TABLES):
            flags = kind[padded]
            sums = np.add.reduceat(flags, cuts, dtype=np.int32)[::2]
            x[:, k][:n] = sums / size
        at, length = np.cumsum(np.isin(np.arange(len(row)), new)) - 1, (end - first).astype(np.float32)
        mean = np.bincount(at, length, n) / words
        same = np.zeros(len(row), np.float32)
        same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        order = np.lexsort((h, at))
        distinct = np.ones(len(row), np.float32)
        distinct[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])
        capital = _KIND_TABLES[0][data[first]].astype(np.float32)
        k = len(KINDS)
        x[:n, k] = mean / 10
        x[:n, k + 1] = np.sqrt(np.maximum(np.bincount(at, length**2, n) / words - mean**2, 0)) / 10
        x[:n, k + 2] = np.bincount(at, same, n) / words
        x[:n, k + 3] = np.bincount(at[order], distinct, n) / words
        x[:n, k + 4] = np.bincount(at, capital, n) / words
        x[:n, k + 5] = np.log1p(words) / 4
        x[:n, k + 6] = words / size
        bag = np.bincount(at * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        x[:n, k + 7 :] = bag / words[:, None]
    of = np.concatenate([row[new] if n else np.zeros(0, int), empty])
    order = np.argsort(of, kind="stable")
    return of[order], x[order]


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in blocks of one size, the last one filled up."""
    out = np.empty((len(x), w.shape[1]))
    for a in range(0, len(x), PRODUCT_ROWS):
        part = x[a : a + PRODUCT_ROWS]
        if len(part) < PRODUCT_ROWS:
            part = np.concatenate([part, np.zeros((PRODUCT_ROWS - len(part), x.shape[1]))])
        out[a : a + PRODUCT_ROWS] = (part @ w)[: len(x) - a]
    return out


class AttentionModel:
    """Gated attention over passages; fitted with Adam on the log loss."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def normal(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def forward(self, z: np.ndarray, cuts: np.ndarray, times=product) -> tuple[np.ndarray, dict]:
        """Scores of the bags of normal() rows that begin at cuts, and the intermediate values."""
        p = self.p
        h = np.tanh(times(z, p["W"]) + p["b"])
        v, u = np.tanh(times(h, p["V"])), 1 / (1 + np.exp(-times(h, p["U"])))
        a = times(v * u, p["w"][:, None])[:, 0]
        bag = np.zeros(len(z), int)
        bag[cuts[1:]] = 1
        bag = np.cumsum(bag)
        e = np.exp(a - np.maximum.reduceat(a, cuts)[bag])
        alpha = e / np.add.reduceat(e, cuts)[bag]
        r = np.add.reduceat(alpha[:, None] * h, cuts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(times(r, p["c"][:, None])[:, 0] + p["d"][0], -30, 30)))
        return s, {"h": h, "v": v, "u": u, "alpha": alpha, "r": r, "bag": bag}

    def gradients(self, z: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by every parameter."""
        p = self.p
        s, m = self.forward(z, cuts, np.matmul)
        err = (s - y) / len(y)
        d_r = err[:, None] * p["c"]
        d_alpha = np.sum(d_r[m["bag"]] * m["h"], axis=1)
        d_a = m["alpha"] * (d_alpha - np.add.reduceat(m["alpha"] * d_alpha, cuts)[m["bag"]])
        d_v = d_a[:, None] * p["w"] * m["u"] * (1 - m["v"] ** 2)
        d_u = d_a[:, None] * p["w"] * m["v"] * m["u"] * (1 - m["u"])
        d_h = (m["alpha"][:, None] * d_r[m["bag"]] + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - m["h"] ** 2)
        return {"W": z.T @ d_h, "b": d_h.sum(axis=0), "V": m["h"].T @ d_v, "U": m["h"].T @ d_u, "w": (m["v"] * m["u"]).T @ d_a, "c": m["r"].T @ err, "d": np.array([err.sum()])}

    def fit(self, x: np.ndarray, cuts: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
        z, p = self.normal(x), self.p
        first, second = {k: 0.0 for k in p}, {k: 0.0 for k in p}
        for t in range(1, epochs + 1):
            for k, g in self.gradients(z, cuts, y).items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.full(len(cuts), self.constant) if self.constant is not None else self.forward(self.normal(x), cuts)[0]


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """Fit on labelled documents outside fold 0; at most `sample` of them come to the driver, as features."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col)) != 0))
    # A label without a document takes no place of the sample away.
    known = known.join(docs.select(id_col), id_col, "left_semi").groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in chunks(batch.column("text")):
                of, x = passages(data, starts)
                cuts = np.searchsorted(of, np.arange(end - first + 1))
                own = [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), batch.column("label").slice(first, end - first), pa.array(own, pa.binary())], names=["doc_id", "label", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "doc_id long, label int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    cuts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(int) if bags else np.zeros(0, int)
    return AttentionModel().fit(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), cuts, np.array([r["label"] for r in rows], float))


def quality_scores(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, text_back: bool = False) -> DataFrame:
    """The id (or the columns in keep) and score, for each row; one pass without a shuffle.

    With text_back, keep may hold the text column, which then goes through Python once.
    """
    kept = [c for c in (keep or [id_col]) if text_back or c != text_col]
    inputs = [c for c in kept if c != text_col]
    names = [f"c{k}" for k in range(len(kept))]  # so that no column of docs clashes with the score
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(len(inputs)), []
            for first, end, data, starts in chunks(pa.compute.fill_null(texts, "")):
                of, x = passages(data, starts)
                out.append(model.scores(x, np.searchsorted(of, np.arange(end - first))))
            if out:
                columns = dict(zip(inputs, batch.columns))
                yield pa.RecordBatch.from_arrays([*(columns.get(c, texts) for c in kept), pa.array(np.concatenate(out))], names=[*names, "score"])

    rows = docs.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(inputs)], F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, ", ".join(f"{n} {types[c]}" for n, c in zip(names, kept)) + ", score double")
    return scored.toDF(*kept, "score")
