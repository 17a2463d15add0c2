"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary rows, one on the
words of toxic rows that hold runs of letters which ordinary rows rarely have. Every window
of a text, a few words of running text, is compressed with the ordinary dictionary alone
and with the toxic one beside it; what the toxic one saves beyond a calibrated margin is
the window's evidence. A logistic curve over a document's evidence, its evidence a window
and its length gives the score.

Margin and curve are fitted by cross-fitting: the labelled rows are cut in folds, and the
windows of each fold are measured with dictionaries trained on the other folds, so that
every labelled row teaches both and none is measured by a dictionary that saw it. Training
happens on the driver with a bounded number of labelled rows, whole texts; scoring reads
every text whole, in the tasks, without a shuffle.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, cols, fresh, python_map

#: Labelled rows of each class that are used at most, chosen by hash.
SAMPLE_ROWS = 2000
#: Words of a window, folds of the fit.
WINDOW, FOLDS = 8, 5
#: Bytes of the dictionaries and how zstandard trains them: segment and run length.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, TRAINED_RUN = 16 << 10, 8 << 10, 16, 6
#: A run of letters of a word stands out if this share of the toxic texts has it, and if
#: it is so many times as frequent among them as among the ordinary ones.
RUN, SHARE, RATIO = 5, 0.05, 4.0
#: Samples that the trainer gets at least; fewer are repeated, which changes no share.
MIN_SAMPLES = 64
#: Bytes before every window and at both ends of a dictionary, so that each window has a
#: match and makes a compressed block; a block's last eight bytes begin no match.
HEAD, TAIL = bytes(range(14, 30)), bytes(range(1, 9))
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-case words with the space on either side."""
    return [f" {w} " for w in _WORD.findall(text.lower())]


def runs(word: str) -> list[str]:
    return [word[i : i + RUN] for i in range(max(1, len(word) - RUN + 1))]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples; empty without samples."""
    if not samples:
        return b""
    samples = samples * -(-MIN_SAMPLES // len(samples))
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=TRAINED_RUN, level=9).as_bytes()
    except zstandard.ZstdError:  # nothing in them recurs
        return b""


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # As plain content: only matches with the text count, not a dictionary's letter statistics.
    d = zstandard.ZstdCompressionDict(HEAD + content + HEAD + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(9, min_match=4, strategy=zstandard.STRATEGY_LAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Meter:
    """Bytes that each window of a text saves with the toxic dictionary beside the ordinary.
    A window is WINDOW words, with HEAD and TAIL around it; each is compressed both ways."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.plain, self.both = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress

    def __call__(self, text: str) -> np.ndarray:
        w = _WORD.findall(text.lower())
        saved = np.zeros(-(-len(w) // WINDOW), np.int64)
        for k in range(len(saved)):
            b = HEAD + f" {' '.join(w[k * WINDOW : (k + 1) * WINDOW])} ".encode("utf-8", "surrogatepass") + TAIL
            saved[k] = len(self.plain(b)) - len(self.both(b))
        return saved


def features(saved: np.ndarray, margin: int) -> list[float]:
    """Evidence, evidence a window, length; and one for the offset."""
    total = float(np.maximum(saved - margin, 0).sum())
    return [math.log1p(total), math.log1p(10 * total / max(1, len(saved))), math.log1p(len(saved)), 1.0]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    margin: int
    curve: list[float]

    def scorer(self):
        meter = Meter(self.toxic, self.ordinary)

        def score(text: str) -> float:
            z = sum(a * b for a, b in zip(self.curve, features(meter(text), self.margin)))
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Curve and mean loss of a slightly shrunk, weighted logistic fit (Newton's method)."""
    w = np.zeros(x.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (weight * (p - y)) + 0.05 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -50, 50))), 1e-9, 1 - 1e-9)
    return w.tolist(), float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


class _Runs:
    """In how many different texts of each class and fold a run of letters is."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.ids: dict[str, int] = {}
        held = [(y, i % FOLDS, {self.ids.setdefault(r, len(self.ids)) for w in set(words(t)) for r in runs(w)}) for i, (t, y) in enumerate(dict(zip(texts, labels)).items())]
        self.seen, self.texts = np.zeros((2, FOLDS, len(self.ids)), np.int32), np.zeros((2, FOLDS))
        for y, f, own in held:
            self.seen[y, f, np.fromiter(own, np.int64, len(own))] += 1
            self.texts[y, f] += 1
        self.names = list(self.ids)

    def standing_out(self, without: int | None) -> set[str]:
        use = [f for f in range(FOLDS) if f != without]
        (ordinary, toxic), (n0, n1) = self.seen[:, use].sum(axis=1), self.texts[:, use].sum(axis=1)
        out = (toxic >= max(3.0, SHARE * n1)) & (toxic / max(1, n1) > RATIO * (ordinary + 0.5) / max(1, n0))
        return {self.names[i] for i in np.flatnonzero(out)}


def fit(texts: list[str], labels: list[int], totals: tuple[int, int] | None = None) -> Model:
    """A model of labelled texts. `totals` are the sizes of the classes that they were sampled
    from: each row weighs as many as it stands for, whatever the share of the sample."""
    n = len(texts)
    seen = _Runs(texts, labels)
    # Folds by the first place of a text, so that its copies share one.
    first: dict[str, int] = {}
    fold = np.array([first.setdefault(t, len(first)) % FOLDS for t in texts], np.int64)
    marks = [seen.standing_out(f) for f in range(FOLDS)] + [seen.standing_out(None)]
    every = set().union(*marks)
    hot = {i: [w for w in words(t) if any(r in every for r in runs(w))] for i, (t, y) in enumerate(zip(texts, labels)) if y}
    plain = {i: ["".join(w[a : a + 16]).encode("utf-8", "surrogatepass") for w in [words(t)] for a in range(0, len(w), 16)] for i, (t, y) in enumerate(zip(texts, labels)) if not y}

    def dictionaries(without: int | None) -> tuple[bytes, bytes]:
        out = marks[FOLDS if without is None else without]
        own = [i for i in range(n) if without is None or fold[i] != without]
        toxic = [s.encode("utf-8", "surrogatepass") for i in own if labels[i] and (s := "".join(w for w in hot[i] if any(r in out for r in runs(w))))]
        return trained(toxic, TOXIC_BYTES), trained([p for i in own if not labels[i] for p in plain[i]], ORDINARY_BYTES)

    saved: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for f in sorted(set(fold.tolist())):
        meter = Meter(*dictionaries(f))
        for i in np.flatnonzero(fold == f):
            saved[i] = meter(texts[i])
    model = Model(*dictionaries(None), 0, [0.0, 0.0, 0.0, -2.0])
    y = np.array(labels, float)
    counts = [max(1, int((y == c).sum())) for c in (0, 1)]
    share = [t / c for t, c in zip(totals, counts)] if totals else [1.0, 1.0]
    weight, best = np.where(y == 1, share[1], share[0]), math.inf
    for margin in range(12 if n else 0):
        curve, loss = _logistic(np.array([features(s, margin) for s in saved]), y, weight)
        if loss < best - 1e-9:
            best, model.margin, model.curve = loss, margin, curve
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `sample_rows` labelled rows of each class, chosen by a hash of
    their id, whole texts. Rows without id, text or label are not used; with one class only,
    or none, scores are near that class's share."""
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).alias("i"), col(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("i", F.lit("toxicity"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(order, "i").limit(sample_rows)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).where("t is not null")
    # At most 2 x sample_rows ids: small enough to broadcast at any size of the tables.
    rows = texts.join(F.broadcast(picked), "i").select(order.alias("o"), "i", "t", "y")
    got = sorted(rows.collect(), key=lambda r: (r["o"], r["i"], r["t"]))
    return fit([r["t"] for r in got], [r["y"] for r in got], (totals.get(0, 0), totals.get(1, 0)))


def score(docs: DataFrame, model: Model, name: str, *, text_col: str = "text") -> DataFrame:
    """docs with one more column, `name` (0 to 1). Null texts are empty; an empty text has
    no evidence and gets the score of that. Rows may repeat; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        f = pickle.loads(sent.value).scorer()
        return lambda b: {name: [f(t or "") for t in b[text_col]]}

    return python_map(docs, make, f"`{name}` double", docs.columns, [text_col])


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; rows with remainder 1 are held out."""
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(3))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per document: whether its row is held out from training, score, predicted.

    Null and empty texts get the score of a text without evidence. Rows may repeat, ids may
    be null (not held out). Other columns are ignored; an empty table gives none.
    """
    model = train(docs, labels.where(remainder(id_col) != 1), id_col=id_col, text_col=text_col)
    out = score(docs.select(col(id_col).alias("i"), col(text_col).alias("t")), model, "score", text_col="t")
    return out.select(F.col("i").alias(id_col), F.coalesce(remainder("i") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents scored below the threshold, in their own columns, whatever their names;
    labels teach, they don't decide. Nulls, empty texts and repeated rows as in the report."""
    model = train(docs, labels.where(remainder(id_col) != 1), id_col=id_col, text_col=text_col)
    name = fresh(docs, "score")[0]
    return score(docs, model, name, text_col=text_col).where(col(name) < threshold).select(*cols(docs))
