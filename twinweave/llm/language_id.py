"""Language ID by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.pieces import give_back
from twinweave.runtime import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: documents per language, windows per document.
PER_LANG = 1_500
WINDOWS = 3
EPOCHS = 8
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 is padding and controls; ASCII letters fold; high bytes keep their own."""
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 1
    table[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
    table[0x30:0x3A] = 3
    for i in range(26):
        table[0x41 + i] = table[0x61 + i] = 4 + i
    table[0x80:] = np.arange(30, 158)
    return table


CLASSES = 158


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """The text's bytes as classes in fixed-length windows; the last is padded."""
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = byte_classes_cached[np.frombuffer(data, np.uint8)]
    return out.reshape(n, window)


byte_classes_cached = byte_classes()


class ByteNet:
    """Filters of several widths over bytes, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.taps = {w: [rng.normal(0, 0.3, (CLASSES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)
        self.tables: dict | None = None

    def pooled(self, x: np.ndarray, where: bool = False):
        """Pooled features of windows x; with where, also each maximum's position."""
        out, at = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            act = self.taps[w][0][x[:, :n]]
            for j in range(1, w):
                act = act + self.taps[w][j][x[:, j : j + n]]
            if where:
                at.append(act.argmax(1))
            out.append(np.maximum(act.max(1) + self.bias[w], 0))
        return (np.concatenate(out, 1), at) if where else np.concatenate(out, 1)

    def compile(self) -> None:
        """Sums of two taps by pair of classes, so that a width needs half as many look-ups."""
        self.tables = {}
        for w in WIDTHS:
            taps = self.taps[w]
            self.tables[w] = [(j, (taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)] + ([(w - 1, taps[w - 1])] if w % 2 else [])

    def logits(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Class scores of windows, some at a time so that activations stay in cache."""
        if self.tables is None:
            self.compile()
        out = np.empty((len(x), len(self.labels)), np.float32)
        for a in range(0, len(x), block):
            own = x[a : a + block]
            pair = own[:, :-1].astype(np.int32) * CLASSES + own[:, 1:]
            features = []
            for w in WIDTHS:
                n = own.shape[1] - w + 1
                act = None
                for j, t in self.tables[w]:
                    got = np.take(t, pair[:, j : j + n] if len(t) > CLASSES else own[:, j : j + n], axis=0)
                    act = got if act is None else np.add(act, got, out=act)
                features.append(np.maximum(act.max(1) + self.bias[w], 0))
            out[a : a + block] = np.concatenate(features, 1) @ self.dense + self.offset
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, seed: int = 7) -> ByteNet:
        """Adagrad on cross entropy; through the pooling only the maxima's taps get a gradient."""
        rng, memory = np.random.default_rng(seed), {}

        def step(name, value, grad):
            m = memory.setdefault(name, np.full(value.shape, 1e-3, np.float32))
            m += grad * grad
            value -= rate * grad / np.sqrt(m)

        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                own, label = x[order[a : a + batch]], y[order[a : a + batch]]
                h, at = self.pooled(own, where=True)
                z = h @ self.dense + self.offset
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(label)), label] -= 1
                p /= len(label)
                back = (p @ self.dense.T) * (h > 0)
                step("dense", self.dense, h.T @ p)
                step("offset", self.offset, p.sum(0))
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    step(f"bias{w}", self.bias[w], g.sum(0))
                    for j in range(w):
                        grad = np.zeros((CLASSES, FILTERS), np.float32)
                        np.add.at(grad, (np.take_along_axis(own, at[i] + j, axis=1), np.arange(FILTERS)[None, :]), g)
                        step(f"tap{w}.{j}", self.taps[w][j], grad)
        self.tables = None
        return self

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Label and probability of whole texts: the mean of all their windows' scores, by their bytes."""
        names, scores = [], []
        run: list[np.ndarray] = []
        shares: list[tuple[int, int]] = []

        def flush():
            z = self.logits(np.concatenate(run))
            i = 0
            for n, size in shares:
                weight = np.full(n, WINDOW, float)
                weight[-1] = size - (n - 1) * WINDOW or 1
                mean = (z[i : i + n] * weight[:, None]).sum(0) / weight.sum()
                p = np.exp(mean - mean.max())
                p /= p.sum()
                names.append(self.labels[int(p.argmax())])
                scores.append(float(p.max()))
                i += n

        held = 0
        for t in texts:
            w = windows_of(t)
            run.append(w)
            shares.append((len(w), len(t)))
            held += len(w)
            if held > 4096:
                flush()
                run, shares, held = [], [], 0
        if run:
            flush()
        return names, scores


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _cuts(windows: int):
    """So many windows of each sampled text, evenly spread from its start to its end."""

    def run(batches):
        for batch in batches:
            ids, langs, out, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for i, (lang, text) in enumerate(zip(langs, batch.column(2).cast(pa.binary()).to_pylist(), strict=True)):
                last = max(0, len(text) - WINDOW)
                for s in sorted({last * j // max(1, windows - 1) for j in range(windows)}):
                    rows.append((ids[i], lang, s))
                    out.append(text[s : s + WINDOW])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "lang", "at", "bytes"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, windows: int = WINDOWS) -> ByteNet | None:
    """A network from labelled texts outside the held-out fold; None if there are none.

    The sample is the documented bound, by two parameters: about ``per_lang``
    documents of each language, picked by a hash of the id, and of each ``windows``
    windows of WINDOW bytes, evenly spread over the whole text. Prediction reads all
    windows of all texts.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < share[F.col("lang")]).mapInArrow(_cuts(windows), "doc_id long, lang string, at long, bytes binary").toPandas()
    sample = sample.sort_values(["lang", "doc_id", "at", "bytes"], kind="stable")
    labels = sorted(set(sample.lang)) if len(sample) else sorted(counts)
    if not len(sample):
        return None
    x = np.concatenate([windows_of(bytes(b)) for b in sample.bytes])
    y = sample.lang.map({lang: i for i, lang in enumerate(labels)}).to_numpy()
    weight = len(y) / np.bincount(y, minlength=len(labels))
    rng = np.random.default_rng(3)  # languages weigh alike
    picked = rng.choice(len(y), size=len(y), p=weight[y] / weight[y].sum())
    return ByteNet(labels).fit(x[picked], y[picked])


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, and the columns in ``keep``.

    A null text, one without a letter, or any text where there is no network gets
    ``und`` and score 0; of languages that score alike the first in code point order
    is taken. Rows are independent: repeated rows get equal answers, an
    empty table gives no rows, and no shuffle is needed.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)  # FILTERS and CLASSES bound its size: under 1 MB

    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None] if model.value else []
            for i, name, score in zip(known, *model.value.predict([texts[i] for i in known]), strict=True) if known else ():
                names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])
        give_back()

    text = F.col(text_col).cast("string")
    given = docs.select(F.when(text.rlike(r"\p{L}"), text).alias("given_text"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    found = given.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return found.select("doc_id", "held_out", "lang_pred", "score", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])
