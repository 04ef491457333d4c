"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded, convolved by filters of several widths, rectified, max-pooled over a window and mapped to a softmax.
A text is read whole, in windows of fixed length that overlap by the widest filter; window log-probabilities are averaged
by window size into one distribution.

Training uses a bounded, documented sample of labelled rows (``per_language`` different texts of every language, taken by
hash of the text, never by position), whole texts of which are cut into windows. For inference the embedding is folded into the filters, so
that a filter's response is a sum of table rows looked up by byte pairs; no multiplication by the embedding is left.

Defined results: a null text or one without letters is ``und`` with score 0; labels that are null are not learned from; with
no labelled row at all everything is ``und``; repeated rows are each reported; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glyphlake.llm.common import map_texts

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
DIM = 12
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")  # also holds numerals such as fractions
_STRIDE = WINDOW - max(WIDTHS) + 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _MAY_BE_LETTER.finditer(text))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes (zero-padded) that cover the whole text, and the bytes that each adds."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, -(-(len(x) - max(WIDTHS) + 1) // _STRIDE))
    padded = np.zeros((n - 1) * _STRIDE + WINDOW, dtype=np.uint8)
    padded[: len(x)] = x
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STRIDE]
    sizes = np.full(n, _STRIDE, dtype=np.float64)
    sizes[-1] = max(1, len(x) - (n - 1) * _STRIDE)
    return rows, sizes


class ByteCNN:
    """Parameters: embedding E (256, DIM), filters K[w] (w, DIM, FILTERS), biases B[w], output W, c."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.5, (256, DIM)), "W": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "c": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"K{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))
            self.p[f"B{w}"] = np.zeros(FILTERS)
        self.p["E"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        p, n = self.p, len(x)
        emb = p["E"][x]
        pooled, where, cols = [], {}, {}
        for w in WIDTHS:
            cols[w] = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM)
            z = cols[w] @ p[f"K{w}"].reshape(w * DIM, FILTERS) + p[f"B{w}"]
            where[w] = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, where[w][:, None, :], axis=1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = h @ p["W"] + p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-9).mean())
        q[np.arange(n), y] -= 1
        q /= n
        g = {"W": h.T @ q, "c": q.sum(axis=0), "E": np.zeros_like(p["E"])}
        dh = (q @ p["W"].T) * (h > 0)
        rows = np.repeat(np.arange(n), FILTERS)
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            at = where[w].ravel()
            picked = cols[w][rows, at].reshape(n, FILTERS, w * DIM)
            g[f"K{w}"] = np.einsum("nfk,nf->kf", picked, d).reshape(w, DIM, FILTERS)
            g[f"B{w}"] = d.sum(axis=0)
            back = np.einsum("nf,kdf->nfkd", d, p[f"K{w}"]).reshape(n * FILTERS, w, DIM)
            for k in range(w):
                np.add.at(g["E"], x[rows, at + k], back[:, k])
        g["E"][0] = 0
        return g, loss

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 2e-3, seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                g, _loss = self.gradients(x[part], y[part])
                t += 1
                for name, v in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * v
                    s[name] = 0.999 * s[name] + 0.001 * v * v
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[int, int, np.ndarray]]:
        """Filters as tables over single bytes or byte pairs: (width, position, table)."""
        out = []
        for w in WIDTHS:
            single = np.einsum("bd,kdf->kbf", self.p["E"], self.p[f"K{w}"]).astype(np.float32)
            single[0] += self.p[f"B{w}"]
            for k in range(0, w - 1, 2):
                out.append((w, k, (single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, FILTERS)))
            if w % 2:
                out.append((w, w - 1, single[w - 1]))
        return out


class Predictor:
    """A trained network with its lookup tables; small enough to go with the task."""

    def __init__(self, model: ByteCNN):
        self.labels, self.model, self._tables = model.labels, model, None
        self.usual = 1.0  # what all but one in a hundred labelled texts reach when they are read rightly

    def __getstate__(self) -> dict:
        return {"labels": self.labels, "model": self.model, "usual": self.usual, "_tables": None}

    def floor(self, share: float) -> float:
        """A score this ``share`` of the way from chance to what labelled texts usually reach, whatever the number of labels."""
        chance = 1 / max(1, len(self.labels))
        return chance + share * max(0.0, self.usual - chance)

    def log_probs(self, rows: np.ndarray, block: int = 16) -> np.ndarray:
        if self._tables is None:
            self._tables = self.model.tables()
        out = []
        for k in range(0, len(rows), block):
            x = rows[k : k + block]
            pair = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
            z = {}
            for w, at, table in self._tables:
                n = WINDOW - w + 1
                part = table.take((pair if len(table) > 256 else x)[:, at : at + n], axis=0, mode="clip")
                z[w] = part if w not in z else np.add(z[w], part, out=z[w])
            h = np.maximum(np.concatenate([z[w].max(axis=1) for w in WIDTHS], axis=1), 0)
            logits = h @ self.model.p["W"] + self.model.p["c"]
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return "und", 0.0
        rows, sizes = windows(text)
        mean = np.average(self.log_probs(rows).astype(np.float64), axis=0, weights=sizes)
        probs = np.exp(mean - mean.max())
        probs /= probs.sum()
        best = int(probs.argmax())
        return self.labels[best], float(probs[best])


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(labelled: DataFrame, per_language: int, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The ``per_language`` different texts of each language that come first by hash. Every language has its share.

    Texts are told apart by their hash, so a text counts once however many copies it has. Hashes below a bound for each
    language, set so that about twice as many pass as are wanted, are ranked; only those rows are shuffled.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not counts:
        return []
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * per_language / max(1, r["n"])))])
    point = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(point < F.try_element_at(bounds, F.col("lang"))).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return sorted((r["lang"], r["text"]) for r in picked.withColumn("k", place).where(F.col("k") <= per_language).collect())


def train(labelled: DataFrame, per_language: int = 300, per_text: int = 6, text_col: str = "text", lang_col: str = "lang") -> Predictor:
    sample = training_sample(labelled, per_language, text_col, lang_col)
    labels = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(11)
    xs, ys, first = [], [], []
    for lang, text in sample:
        if not has_letter(text):
            continue
        rows, _ = windows(text)
        chosen = rows if len(rows) <= per_text else rows[rng.choice(len(rows), per_text, replace=False)]
        first.append(len(xs))
        xs += list(chosen)
        ys += [labels.index(lang)] * len(chosen)
        short = chosen[0].copy()  # short texts look like this
        short[int(rng.integers(12, 80)) :] = 0
        xs.append(short)
        ys.append(labels.index(lang))
    model = ByteCNN(labels)
    predictor = Predictor(model.fit(np.array(xs), np.array(ys)) if xs else model)
    if xs:
        probs = np.exp(predictor.log_probs(np.array([xs[k] for k in first])))
        right = probs.argmax(axis=1) == np.array([ys[k] for k in first])
        predictor.usual = float(np.quantile(probs.max(axis=1)[right], 0.01)) if right.any() else 1.0
    return predictor


def identify(docs: DataFrame, predictor: Predictor, keep: list[str], text_col: str = "text", text_as: str | None = None) -> DataFrame:
    """The columns ``keep`` and lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(predictor)  # fixed size: the network's parameters

    def run(text: str | None) -> tuple:
        return shared.value.predict(text)

    return map_texts(docs, text_col, {c: c for c in keep}, "lang_pred string, score double", run, text_as)
