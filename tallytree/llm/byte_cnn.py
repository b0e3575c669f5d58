"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into windows of fixed length. Filters of several widths slide over a window, the
largest response of each filter passes a rectifier and a linear layer with softmax names the language. A filter
tap is a table with one row per byte, so a convolution is a sum of table rows. The windows of a
text vote with their log probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytree.llm.pairwise_quality import held_out
from tallytree.llm.rawtext import batches

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 12
#: About FIT_ROWS documents, chosen by hash, take part in the training, and about FIT_LANG at least of every language that has as many.
FIT_ROWS, FIT_LANG = 4000, 200
#: Windows of one document that take part at most.
FIT_WINDOWS = 16
STEPS, BATCH, RATE = 400, 128, 0.02
UNKNOWN = "und"

#: Capital ASCII letters read as small ones; everything else is itself. 0 fills the last window.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, window bytes): every text from its first byte to its last, the end filled up; an empty text has none."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // window)
    data = np.frombuffer(b"".join(t.ljust(c * window, b"\0") for t, c in zip(texts, counts.tolist())), dtype=np.uint8)
    return np.repeat(np.arange(len(texts)), counts), _FOLD[data].reshape(-1, window)


class Network:
    def __init__(self, classes: int, seed: int = 3):
        random = np.random.default_rng(seed)
        self.taps = [random.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.shift = np.zeros(classes, dtype=np.float32)

    def _responses(self, windows: np.ndarray) -> list[np.ndarray]:
        n, length = windows.shape
        out = []
        for taps in self.taps:
            w = len(taps)
            total = np.take(taps[0], windows[:, : length - w + 1], axis=0)
            for k in range(1, w):
                total += np.take(taps[k], windows[:, k : length - w + 1 + k], axis=0)
            out.append(total)
        return out

    def _pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([r.max(axis=1) for r in self._responses(windows)], axis=1) + self.bias

    def log_probabilities(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        parts = [np.maximum(self._pooled(windows[i : i + step]), 0) @ self.out + self.shift for i in range(0, len(windows), step)]
        logits = np.concatenate(parts) if parts else np.zeros((0, len(self.shift)), np.float32)
        logits = logits.astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam on the cross entropy; the gradient of a filter flows to the place of its largest response."""
        random = np.random.default_rng(seed)
        weights = [*self.taps, self.bias, self.out, self.shift]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for t in range(1, steps + 1):
            pick = random.integers(0, len(windows), BATCH)
            x, y = windows[pick], labels[pick]
            responses = self._responses(x)
            peaks = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, p[:, None, :], axis=1)[:, 0] for r, p in zip(responses, peaks)], axis=1) + self.bias
            hidden = np.maximum(pooled, 0)
            logits = hidden @ self.out + self.shift
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(BATCH), y] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (pooled > 0)
            grads = []
            for j, (taps, peak) in enumerate(zip(self.taps, peaks)):
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                grad = np.zeros_like(taps)
                for k in range(len(taps)):
                    seen = np.take_along_axis(x, peak + k, axis=1)
                    np.add.at(grad[k], (seen, np.arange(FILTERS)[None, :]), part)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ p + 1e-4 * self.out, p.sum(axis=0)]
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def some_windows(text: bytes, many: int = FIT_WINDOWS, window: int = WINDOW) -> list[bytes]:
    """The windows of a text, or ``many`` of them chosen by its checksum."""
    count = -(-len(text) // window)
    picked = range(count) if count <= many else sorted(np.random.default_rng(zlib.crc32(text)).choice(count, many, replace=False).tolist())
    return [text[k * window : (k + 1) * window] for k in picked]


def training_windows(usable: DataFrame, fit_rows: int = FIT_ROWS, fit_lang: int = FIT_LANG) -> list[tuple[str, bytes]]:
    """(language, window) of the documents (row_id, lang, text) that the training reads, in order, equal ones once.

    A document takes part if its hash falls below the share of its language: what gives ``fit_rows`` documents of all
    languages or ``fit_lang`` of this one, whichever is more. Tasks cut the texts, so the driver gets at most 4 KB of a
    document, and about ``fit_rows`` + ``fit_lang`` x languages documents.
    """
    sizes = sorted((r[0], r[1]) for r in usable.groupBy("lang").count().collect())
    if not sizes:
        return []
    total = sum(n for _, n in sizes)
    shares = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, max(fit_rows / total, fit_lang / n))])
    chance = F.pmod(F.xxhash64("row_id", "text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = usable.filter(chance < F.element_at(shares, F.col("lang"))).filter(F.col("text").rlike("\\p{L}"))

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text"):
            found = [(lang, w) for lang, t in zip(part.column(0).to_pylist(), texts) for w in some_windows(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())], ["lang", "window"])

    windows = picked.select("lang", "text").mapInArrow(cut, "lang string, window binary").distinct()
    return sorted((r[0], bytes(r[1])) for r in windows.collect())


def fitted(windows: list[tuple[str, bytes]]) -> tuple[Network, list[str]]:
    """A network trained on labelled windows, and its languages."""
    names = sorted({lang for lang, _ in windows})
    index = {x: i for i, x in enumerate(names)}
    network = Network(len(names))
    network.train(windows_of([w for _, w in windows])[1], np.array([index[lang] for lang, _ in windows]))
    return network, names


def identified(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fit_rows: int = FIT_ROWS,
    fit_lang: int = FIT_LANG,
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Rows with crc32(id as text) mod 5 = 0 are held out of the training, which reads at most 16 windows of about ``fit_rows`` of the
    others, and of about ``fit_lang`` of each language, chosen by hash, with a language and a letter. Every window of every whole
    text is classified. A null text and one without a letter is ``und`` with score 0, as is any text if nothing could be
    learned. The score is the probability of the prediction, from the mean log probabilities of the windows. Repeated rows get
    equal results and count once in the training. Other columns are not touched.
    """
    source = docs.select(
        F.col(id_column).alias("row_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    usable = docs.select(F.col(id_column).alias("row_id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).filter(
        F.col("row_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("row_id")))
    train = training_windows(usable, fit_rows, fit_lang)
    network, names = fitted(train) if train else (None, [])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text", 1 << 19):
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if network is not None:
                row, windows = windows_of(texts)
                votes = np.zeros((len(texts), len(names)))
                np.add.at(votes, row, network.log_probabilities(windows))
                votes /= np.maximum(np.bincount(row, minlength=len(texts)), 1)[:, None]
                odds = np.exp(votes - votes.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                best = odds.argmax(axis=1)
                for i, t in enumerate(texts):
                    if any(c.isalpha() for c in t.decode()):
                        langs[i], scores[i] = names[best[i]], float(odds[i, best[i]])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["row_id", "held_out", "lang_pred", "score"])

    kind = source.schema["row_id"].dataType.simpleString()
    out = source.mapInArrow(work, f"row_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("row_id", id_column)
