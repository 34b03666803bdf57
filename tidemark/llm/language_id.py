"""Language identification by a byte convolutional network trained and applied in numpy.

Bytes are one-hot, so a filter of width w is a sum of w table rows. Filters of several widths are rectified and
max-pooled over a window of WINDOW bytes, and a softmax gives the language. The model is trained on the driver, with
Adam, on at most about MAX_ROWS labelled documents, chosen by a hash of doc_id, and WINDOWS_A_ROW windows of each.
Whole texts are predicted: all consecutive windows are scored in batches, the last one padded, and their
probabilities are averaged by length. In prediction, taps are merged to tables over byte pairs.

A null text, one without a letter, and every text when nothing is labelled are `und` with score 0. Languages that tie are told by name, the
first. Repeated rows each get a row. Very long texts are scored in all their windows, 256 at a time. An empty table gives an empty result. Other columns are carried in the struct `doc`. Neither lang nor source nor doc_id is an input of a prediction.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import column, slices

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
#: Labelled documents that the model is trained on, about.
MAX_ROWS = 4000
WINDOWS_A_ROW = 2
EPOCHS = 4
BATCH = 64


class Network:
    def __init__(self, classes: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.taps = [r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.taps, *self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features of windows (n, WINDOW) and the places of the maxima."""
        feats, places = [], []
        for taps, bias in zip(self.taps, self.bias, strict=True):
            w = len(taps)
            z = taps[0][x[:, : WINDOW - w + 1]]
            for k in range(1, w):
                z += taps[k][x[:, k : WINDOW - w + 1 + k]]
            places.append(z.argmax(1))
            feats.append(np.maximum(np.take_along_axis(z, places[-1][:, None], 1)[:, 0] + bias, 0))
        return np.concatenate(feats, 1), places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f, places = self.pooled(x)
        p = softmax(f @ self.out + self.out_bias)
        d = p
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        df = (d @ self.out.T) * (f > 0)
        taps, biases = [], []
        rows = np.arange(len(x))[:, None]
        for i, t in enumerate(self.taps):
            mine = df[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(t)
            for k in range(len(t)):
                np.add.at(g[k], (x[rows, places[i] + k], np.arange(FILTERS)[None, :]), mine)
            taps.append(g)
            biases.append(mine.sum(0))
        return [*taps, *biases, f.T @ d, d.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                for p, g, a, b in zip(self.params(), self.gradients(x[rows], y[rows]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def fast(self) -> "Fast":
        return Fast(self)


class Fast:
    """The network with taps merged to byte-pair tables."""

    def __init__(self, net: Network):
        self.net = net
        self.plan = []
        for taps in net.taps:
            parts, k = [], 0
            while k < len(taps):
                if k + 1 < len(taps):
                    parts.append((k, True, (taps[k][:, None] + taps[k + 1][None]).reshape(65536, FILTERS)))
                    k += 2
                else:
                    parts.append((k, False, taps[k]))
                    k += 1
            self.plan.append((len(taps), parts))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        feats = []
        for (w, parts), bias in zip(self.plan, self.net.bias, strict=True):
            n, z = WINDOW - w + 1, None
            for k, two, table in parts:
                t = table.take((pair if two else x)[:, k : k + n], axis=0)
                z = t if z is None else np.add(z, t, out=z)
            feats.append(np.maximum(z.max(1) + bias, 0))
        return softmax(np.concatenate(feats, 1) @ self.net.out + self.net.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the consecutive windows of all texts, and each text's number of windows."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    start = np.repeat(offsets[:-1], many) + WINDOW * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return np.stack([start, np.minimum(start + WINDOW, np.repeat(offsets[1:], many))], 1), many


def cut(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    at = spans[:, :1] + np.arange(WINDOW)
    x = data[np.minimum(at, len(data) - 1)]
    x[at >= spans[:, 1:]] = 0
    return x


def train(docs: DataFrame, remainder: int = 2, modulus: int = 4) -> Network | None:
    """Learns from labelled documents whose crc32(doc_id) leaves another remainder."""
    fit = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != remainder).where("lang IS NOT NULL AND text IS NOT NULL")
    n = fit.count()
    if not n:
        return None
    share = min(1.0, MAX_ROWS / n)
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    picks = fit.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    shown = [F.substring("text", place(k), F.lit(WINDOW)).alias(f"w{k}") for k in range(WINDOWS_A_ROW)]
    # Twice the share that is needed; where many rows have one id, the first by hash.
    rows = picks.select("doc_id", "lang", *shown).orderBy(F.xxhash64("doc_id", "lang", "w0", "w1")).limit(2 * MAX_ROWS).collect()
    rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    classes = sorted({r.lang for r in rows})
    if not classes:
        return None
    x, y = [], []
    for r in rows:
        for text in set(r[2:]):
            b = text.encode()[:WINDOW]
            if any(c.isalpha() for c in text):
                x.append(np.frombuffer(b.ljust(WINDOW, b"\0"), np.uint8))
                y.append(classes.index(r.lang))
    if not x:
        return None
    net = Network(classes)
    net.train(np.stack(x), np.array(y))
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc, text, lang_pred, score): doc holds the other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net.fast() if net else None)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        model = shared.value
        for batch in slices(batches, limit=1 << 20):
            data, offsets = column(batch, "text")
            spans, many = windows(data, offsets)
            text = np.repeat(np.arange(len(batch)), many)
            k = len(model.net.classes) if model else 1
            total, weight = np.zeros((len(batch), k)), np.zeros(len(batch))
            for at in range(0, len(spans) if model else 0, 256):
                part = spans[at : at + 256]
                size = (part[:, 1] - part[:, 0]).astype(np.float64)
                np.add.at(total, text[at : at + 256], model.probabilities(cut(data, part)) * size[:, None])
                np.add.at(weight, text[at : at + 256], size)
            p = total / np.maximum(weight, 1)[:, None]
            best = p.argmax(1)
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            known = letters & (weight > 0)
            langs = [model.net.classes[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1))],
                                             names=["doc", "text", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def language_id(docs: DataFrame, remainder: int = 2, modulus: int = 4) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder
    found = identify(docs.select("doc_id", "text"), train(docs, remainder, modulus))
    return found.select("doc.doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
