"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters, lower-cased, with every run of other characters than letters as
one kind of blank, are hashed to ``2**BITS`` bins. Document frequencies are counted over
all documents that may be learned from. Weights are trained by follow-the-regularised-leader with
elastic-net penalties on a sample of at most ``fit_rows`` of them, even by language, and
a temperature is then fitted on the part of the sample held back. Whole texts are used
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import kernels as K
from chronofold.llm.runtime import cut, one_of

BITS = 13
ORDERS = (1, 2, 3)
ROWS = 256
_tables: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """Lower-cased code point of each letter below 0x10000; a blank for all else."""
    if not _tables:
        out = np.full(0x10000, 32, dtype=np.uint32)
        for i in range(0x10000):
            if (c := chr(i)).isalpha():
                out[i] = ord(low) if len(low := c.lower()) == 1 else i
        _tables["fold"] = out
    return _tables["fold"]


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, offsets) of the texts of a chunk."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    seen = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=seen[1:])
    low = _fold()[np.minimum(points, 0xFFFF)]
    if len(far := np.flatnonzero(points > 0xFFFF)):
        low[far] = [p if chr(p).isalpha() else 32 for p in points[far].tolist()]
    return low, seen[offsets]


def counts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, rows x bins counts, letters of each row), at most ROWS rows a time."""
    low, off = _letters(raw, offsets)
    for a in range(0, len(off) - 1, ROWS):
        b = min(a + ROWS, len(off) - 1)
        x, o = low[off[a] : off[b]].astype(np.uint64), off[a : b + 1] - off[a]
        lengths = np.diff(o)
        row = np.repeat(np.arange(b - a), lengths)
        total = np.zeros((b - a) << BITS, dtype=np.int64)
        blank = x == 32
        keep = ~(blank & np.concatenate([[False], blank[:-1] & (row[1:] == row[:-1])])) if len(x) else blank
        x, row = x[keep], row[keep]
        for n in ORDERS:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = h * K.BASE + x[j : len(x) - n + 1 + j]
            same = row[: len(x) - n + 1] == row[n - 1 :]
            place = (row[: len(x) - n + 1] << BITS) + (K.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
            total += np.bincount(place[same], minlength=len(total))
        yield a, b, total.reshape(b - a, 1 << BITS), np.bincount(row[x != 32], minlength=b - a)


def _features(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(total.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents in which each bin occurs, and documents. Tasks send one sum a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for rows, raw, offsets in K.chunks(batch, text_col):
                n += rows.num_rows
                for _, _, total, _ in counts(raw, offsets):
                    df += (total > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.concatenate([[n], df]))], ["bin", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias(text_col)).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for bin_, n in rows:
        out[bin_ + 1] = n
    return out[1:], int(out[0])


class FTRL:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, bins: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.z, self.n = np.zeros((bins, classes)), np.zeros((bins, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, fit_rows: int = 4000, epochs: int = 3, seed: int = 5, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> dict | None:
    """Model from the rows of ``docs`` whose label is not null, or None if there are none.

    The driver holds the sample's n-gram counts: at most ``fit_rows`` times ``2**BITS`` pairs of small numbers.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).where("label is not null")
    by_label = rows.groupBy("label").agg(F.count("*").alias("n"))
    share = cut(by_label.withColumn("keep", F.lit(float(fit_rows)) / F.col("n")), "lang-share")
    classes = sorted(r["label"] for r in share.select("label").collect())
    if not classes:
        return None
    df, n = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    order = F.xxhash64(F.lit(seed), "id", "text")
    u = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    sample = rows.join(share.select("label", (F.col("keep") / len(classes)).alias("keep")), "label").where(u < F.col("keep")).select("text", "label", order.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in K.chunks(batch, "text"):
                for a, b, total, letters in counts(raw, offsets):
                    bins = [np.flatnonzero(t) for t in total]
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int16) for x in bins], pa.list_(pa.int16())), pa.array([t[x].astype(np.int32) for t, x in zip(total, bins, strict=True)], pa.list_(pa.int32())), pa.array(letters), part.column(1).slice(a, b - a), part.column(2).slice(a, b - a)], ["bins", "counts", "letters", "label", "h"])

    got = sample.mapInArrow(run, "bins array<smallint>, counts array<int>, letters long, label string, h long").where("letters > 0").toArrow()
    place = {c: i for i, c in enumerate(classes)}
    data = sorted(((r["h"], place[r["label"]], np.asarray(r["bins"], dtype=np.int64), np.asarray(r["counts"], dtype=np.float32)) for r in got.to_pylist()), key=lambda r: (r[0], r[1]))
    examples = []
    for _, label, at, c in data:
        x = np.log1p(c) * idf[at]
        examples.append((at, x / max(np.sqrt((x * x).sum()), 1e-9), label))
    held = examples[::5] if len(examples) >= 10 else examples
    train = [e for i, e in enumerate(examples) if i % 5] if len(examples) >= 10 else examples
    model = FTRL(1 << BITS, len(classes))
    for _ in range(epochs):
        for e in train:
            model.learn(*e)
    w = model.weights()
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(classes))
    gold = np.array([y for _, _, y in held], dtype=np.int64)
    return {"classes": classes, "idf": idf, "weights": w.astype(np.float32), "temperature": temperature(logits, gold), "sample": len(examples)}


def temperature(logits: np.ndarray, gold: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(gold):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(gold)), gold], 1e-12)).mean()
    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (calibrated probability of the prediction).

    A null text, a text without letters and every text where nothing could be learned get ``und`` and 0.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*(m["classes"] if m else []), "und"], dtype=object)
        for batch in batches:
            for part, raw, offsets in K.chunks(batch, "_text"):
                best = np.full(part.num_rows, len(names) - 1)
                score = np.zeros(part.num_rows)
                for a, b, total, letters in counts(raw, offsets) if m else ():
                    p = softmax((_features(total, m["idf"]) @ m["weights"]).astype(np.float64) / m["temperature"])
                    some = letters > 0
                    best[a:b] = np.where(some, p.argmax(axis=1), len(names) - 1)
                    score[a:b] = np.where(some, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(names[best], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:width])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, fit_rows: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned where crc32(doc_id) mod 4 is not 2, applied to every row.

    Rows with a null doc_id are neither held out nor learned from. Nothing else than the text enters a prediction.
    """
    held_out = F.coalesce(one_of(F.col("doc_id"), 4, 2), F.lit(False))
    learn = docs.where(~one_of(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
    out = predict(docs, fit(learn, fit_rows))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
