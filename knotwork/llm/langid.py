"""Language identification with a byte convolutional network.

Filters of several widths run over a window of bytes, each filter keeps its maximum over the window,
and a softmax over the pooled features gives the languages. The network is trained in numpy on
windows of labelled text and applied to all fixed-length windows of a text; a text's probability is
the mean over its windows, weighted by their bytes.

Training reads a bounded sample: ``Training.texts`` labelled rows, those with the smallest hash of
id and text, one window of each at a place chosen by hash. Prediction reads every byte of every
text and nothing but the text.

Cases: a null text, an empty text or one without a letter gets ``und`` and score 0. A null language
is no label. With no labelled row at all every text is ``und``. Repeated rows get equal answers.
Ties between languages go to the alphabetically first. Clashing column names are not carried by
``predict`` and are kept untouched by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
#: Byte classes: 0 padding, 1 space, 2 digit, 3 mark, 4-29 letters whatever their case, 30-157 bytes from 128.
CLASSES = 158
_CLASS = np.full(256, 3, np.int64)
_CLASS[:33] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = np.arange(4, 30)
_CLASS[128:] = np.arange(30, 158)


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit; ``texts`` bounds the rows that reach the driver."""

    texts: int = 6000
    window: int = 256
    embedding: int = 12
    filters: int = 24
    epochs: int = 4
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


@dataclass
class Network:
    """``tables[w]``: contribution of each byte class at each place of a filter of width w."""

    langs: list[str]
    window: int
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[tuple[int, np.ndarray]]:
        """Tables for two neighbouring classes at once: (shift, rows) in the order that ``pooled`` adds them."""
        found = []
        for t in self.tables:
            for k in range(0, len(t) - 1, 2):
                found.append((k, (t[k][:, None] + t[k + 1][None]).reshape(CLASSES * CLASSES, -1)))
            if len(t) % 2:
                found.append((len(t) - 1, np.repeat(t[-1], CLASSES, axis=0)))
        return found

    def probabilities(self, windows: np.ndarray, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Softmax for windows of byte classes, shape (windows, ``window``)."""
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS))))
        both = (padded[:, :-1] * CLASSES + padded[:, 1:]).astype(np.int32)
        pooled, at = [], iter(pairs)
        for width in WIDTHS:
            total = None
            for _ in range((width + 1) // 2):
                shift, rows = next(at)
                part = rows.take(both[:, shift : shift + self.window], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], how: Training = Training()) -> Network | None:
    """Fit by Adam on cross entropy; max pooling passes each gradient to one place of the window."""
    if not texts:
        return None
    langs = sorted(set(labels))
    target = np.searchsorted(langs, labels)
    rng = np.random.default_rng(how.seed)
    length, deep = how.window, how.filters
    x = np.zeros((len(texts), length + max(WIDTHS)), np.int64)
    for r, text in enumerate(texts):
        raw = np.frombuffer(text.encode()[: length * 4], np.uint8)
        begin = int(rng.integers(0, max(1, len(raw) - length + 1)))
        x[r, : min(length, len(raw))] = _CLASS[raw[begin : begin + length]]
    p = {"emb": rng.normal(0, 0.3, (CLASSES, how.embedding)), "bias": np.zeros(deep * len(WIDTHS)), "out": rng.normal(0, 0.2, (deep * len(WIDTHS), len(langs))), "out_bias": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"conv{w}"] = rng.normal(0, (w * how.embedding) ** -0.5, (w, how.embedding, deep))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(how.epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), how.batch):
            rows = order[lo : lo + how.batch]
            seen, y, n = x[rows], target[rows], len(rows)
            vec = p["emb"][seen]
            tops, places = [], []
            for w in WIDTHS:
                conv = sum(vec[:, k : k + length] @ p[f"conv{w}"][k] for k in range(w))
                top = conv.argmax(axis=1)
                places.append(top)
                tops.append(np.take_along_axis(conv, top[:, None], axis=1)[:, 0])
            pre = np.concatenate(tops, axis=1) + p["bias"]
            hidden = np.maximum(pre, 0)
            logits = hidden @ p["out"] + p["out_bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            delta = e / e.sum(axis=1, keepdims=True)
            delta[np.arange(n), y] -= 1
            delta /= n
            g = {"out": hidden.T @ delta, "out_bias": delta.sum(0), "emb": np.zeros_like(p["emb"])}
            back = (delta @ p["out"].T) * (pre > 0)
            g["bias"] = back.sum(0)
            for j, w in enumerate(WIDTHS):
                part = back[:, j * deep : (j + 1) * deep]
                g[f"conv{w}"] = np.empty_like(p[f"conv{w}"])
                for k in range(w):
                    where = np.take_along_axis(seen, places[j] + k, axis=1)
                    chosen = p["emb"][where]
                    g[f"conv{w}"][k] = np.einsum("nfe,nf->ef", chosen, part)
                    np.add.at(g["emb"], where, part[:, :, None] * p[f"conv{w}"][k].T[None])
            step += 1
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                p[k] -= how.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    tables = [np.stack([p["emb"] @ p[f"conv{w}"][k] for k in range(w)]).astype(np.float32) for w in WIDTHS]
    return Network(langs, length, tables, p["bias"], p["out"], p["out_bias"])


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: Training = Training()) -> Network | None:
    """Train on the ``how.texts`` labelled rows of the smallest hash among those that are ``usable``.

    A threshold on the hash, from the number of labelled rows, leaves about twice the rows that are
    needed before they are ordered, so what reaches the driver does not grow with the partitions.
    """
    size = 4 * how.window
    place = F.lit(1) + F.pmod(F.xxhash64(id_col, F.lit(11)), F.greatest(F.length(text_col) - size, F.lit(1))).cast("int")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(lang_col) != UNKNOWN))
    known = known if usable is None else known.where(usable)
    drawn = known.select(F.xxhash64(id_col, text_col, F.lit(how.seed)).alias("order"), F.col(text_col).substr(place, F.lit(size)).alias("piece"), F.col(lang_col).alias("label"))
    many = known.count()
    if many > 4 * how.texts:
        drawn = drawn.where(F.col("order") < F.lit(int(-(2**63) + 2**64 * (2 * how.texts / many))))
    rows = drawn.orderBy("order", "label", "piece").limit(how.texts).collect()  # bounded sample
    rows = [r for r in rows if any(c.isalpha() for c in r["piece"])]
    return train([r["piece"] for r in rows], [r["label"] for r in rows], how)


def _scores(net: Network, pairs: list[tuple[int, np.ndarray]], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and probability of each text of a slice."""
    lengths = np.diff(offsets)
    per = -(-lengths // net.window)
    total = np.zeros((len(lengths), len(net.langs)))
    of = np.repeat(np.arange(len(lengths)), per)
    begin = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * net.window
    size = np.minimum(net.window, offsets[1:][of] - begin)
    classes = np.append(_CLASS[data], 0)
    for lo in range(0, len(of), 512):
        b, s = begin[lo : lo + 512, None], size[lo : lo + 512, None]
        at = np.arange(net.window)[None]
        windows = np.where(at < s, classes[np.minimum(b + at, len(data))], 0)
        np.add.at(total, of[lo : lo + 512], net.probabilities(windows, pairs) * s)
    total /= np.maximum(lengths, 1)[:, None]
    best = total.argmax(axis=1)
    return best, np.minimum(total[np.arange(len(best)), best], 1.0)


def _judge(net: Network | None, column: pa.Array, data: np.ndarray, offsets: np.ndarray, pairs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([*(net.langs if net else []), UNKNOWN], object)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if net is None:
        return np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
    best, score = _scores(net, pairs, data, offsets)
    return names[np.where(letters, best, len(names) - 1)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` of every text."""
    pairs = net.pairs() if net else []
    shared = docs.sparkSession.sparkContext.broadcast((net, pairs))  # of fixed size, about 10 MB

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        model, tables = shared.value
        lang, score = _judge(model, rows.column(1), data, offsets, tables)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, lang_pred string, score double", work)


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose language is known with at least the probability ``least``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.pairs() if net else []))

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        model, tables = shared.value
        lang, score = _judge(model, rows.column(rows.schema.get_field_index(text_col)), data, offsets, tables)
        return rows.filter(pa.array((lang != UNKNOWN) & (score >= least)))

    return arrow_map(docs, text_col, docs.schema, work)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no training may read."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
