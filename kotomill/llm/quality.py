"""Quality by co-training: a text view and a page-metadata view teach each other, then score all documents.

The text view sees hashed words and word shapes and proportions of characters and repeated words; the metadata view sees the page's
columns (source, language, length) and its layout (how many lines, of which lengths, repeated or blank) but no word of it.
Each view is a logistic regression, calibrated on held-out labels. In each round, either view labels the unlabelled pool documents of whose
class it is most sure (calibrated probability of at least SURE, at most EXCHANGE of each class a round) for the other
view, if at least PROOF held-out documents of such a probability bear it out in a share of SURE: a view that cannot tell, teaches nothing.
At the end both calibrated views are combined by a logistic regression on the held-out labels.

Fitting uses a bounded sample: of at most 2 * MOST_LABELLED labelled documents and a pool of MOST_POOL further ones, the
MOST_LABELLED + MOST_POOL with the smallest hashes of their ids; scoring covers every document in full. (Co-training draws its
pseudo-labels from a small pool by design.) A document is rejected if its probability of
good quality lies under the cut: one half, or lower if more than LOSS of the held-out good documents lay
under that.

Defined edge cases: null and empty texts have zero text features and are scored like any other; labels
that are null are ignored and an id labelled more than once counts with its mean, ties as good; without
labels of both classes nothing is rejected and the score is the share of good labels (1 without any);
repeated rows give repeated results; an empty table gives an empty result; extra columns pass through
``keep`` untouched; of the rows that share an id the one with the smallest hash is fitted.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log1p
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, passing, released, small_batches, small_side, table
from .learn import fit_logistic, linear, platt, sigmoid

MOST_LABELLED, MOST_POOL = 8000, 4000
ROUNDS, EXCHANGE, SURE = 4, 250, 0.97
#: Held-out documents of which a view must be so sure, and right, before it labels for the other.
PROOF = 20
LOSS = 0.002
SEED = 3
WORD_DIMS, SHAPE_DIMS, PLACE_DIMS = 512, 512, 128

#: Features travel to the driver in 16 bits.
PACKED = np.float16

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")
_slots: dict[str, tuple[int, int]] = {}


def _slot(word: str) -> tuple[int, int]:
    found = _slots.get(word)
    if found is None:
        shape = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))[:12]
        found = crc32(word.encode()) % WORD_DIMS, WORD_DIMS + crc32(shape.encode()) % SHAPE_DIMS
        if len(_slots) < 50_000 and len(word) < 40:
            _slots[word] = found
    return found


def text_view(text: str) -> np.ndarray:
    """Hashed words and word shapes, and the text's proportions of characters and repeated words; nothing of its lines."""
    words = text.split()
    bag = Counter(words)
    out = np.zeros(WORD_DIMS + SHAPE_DIMS, np.float32)
    for word, n in bag.items():
        w, s = _slot(word)
        out[w] += n
        out[s] += n
    out = np.log1p(out)
    for part in (out[:WORD_DIMS], out[WORD_DIMS:]):
        part /= max(1e-6, float(np.sqrt((part * part).sum())))
    size, total = max(1, len(text)), max(1, len(words))
    raw = text.encode("latin-1", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    stops = counts[44] + counts[46]
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - stops
    numbers = [size / total / 10, upper / size * 5, lower / size, digit / size * 5, symbols / size * 5, stops / size * 10, counts[124] / size * 10, counts[33] / size * 10]
    numbers += [len(bag) / total, max(bag.values(), default=0) / total, sum(n for n in bag.values() if n > 9) / total]
    return np.concatenate([out, np.array(numbers, np.float32)])


def meta_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The page's columns and layout: source, language, length, and how many lines of which lengths it has; no words or characters."""
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines], np.float64)
    length = max(0, n_chars if n_chars is not None else len(text))
    short, blank, long = (sizes < 40).mean(), (sizes == 0).mean(), (sizes > 400).mean()
    again = 1 - len(set(lines)) / len(lines)
    numbers = [log1p(length) / 10, log1p(len(lines)) / 5, log1p(sizes.mean()) / 8, log1p(sizes.std()) / 8, log1p(sizes.max()) / 8, short, blank, long, again, min(2.0, log1p(abs(length - len(text))) / 5)]
    place = np.zeros(PLACE_DIMS, np.float32)
    for k, value in enumerate((f"source {source}", f"lang {lang}", f"size {int(log1p(length))}", f"lines {int(log1p(len(lines)) * 2)}", f"short {int(short * 5)}")):
        place[crc32(value.encode()) % PLACE_DIMS] += 0.3 if k < 2 else 1.0
    return np.concatenate([np.array(numbers, np.float32), place])


TEXT_DIMS, META_DIMS = WORD_DIMS + SHAPE_DIMS + 11, 10 + PLACE_DIMS


@dataclass(frozen=True)
class Model:
    """The fitted views: weights and calibration of each, their combination and the cut."""

    weights: tuple[np.ndarray, np.ndarray]
    scale: tuple[tuple[float, float], tuple[float, float]]
    both: np.ndarray
    cut: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, combined."""
        z = [linear(x, w) for x, w in zip((text, meta), self.weights, strict=True)]
        z = [a * v + b for v, (a, b) in zip(z, self.scale, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(z[0] * self.both[0] + z[1] * self.both[1] + self.both[2])


def constant(share: float) -> Model:
    z = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    w = tuple(np.append(np.zeros(n, np.float32), np.float32(z)) for n in (TEXT_DIMS, META_DIMS))
    return Model(w, ((1.0, 0.0), (1.0, 0.0)), np.array([0.5, 0.5, 0.0]), 0.0)


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray) -> Model:
    """label: 1, 0, or -1 for the pool; every fourth labelled row of each class is held out for calibration."""
    y = label.copy()
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::4]] = True
    if min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) == 0:
        return constant(float((y == 1).sum() / max(1, (y >= 0).sum())))
    views = (text, meta)
    known = [np.where(held, -1, y), np.where(held, -1, y)]  # what each view is taught
    pool = y == -1
    for round_ in range(ROUNDS + 1):
        fits, scales, sure = [], [], []
        for x, k in zip(views, known, strict=True):
            at = k >= 0
            share = {c: max(1, int((k == c).sum())) for c in (0, 1)}
            weight = np.where(k[at] == 1, 0.5 / share[1], 0.5 / share[0])
            w = fit_logistic(x[at], k[at].astype(np.float32), weight)
            z = linear(x, w)
            a, b = platt(z[held], y[held])
            fits.append(w)
            scales.append((a, b))
            sure.append(sigmoid(a * z + b))
        if round_ == ROUNDS:
            break
        for own, other in ((0, 1), (1, 0)):
            p = sure[own]
            for c, q in ((1, p), (0, 1 - p)):
                proof = y[held & (q >= SURE)] == c  # a view teaches what the held-out labels bear out
                if len(proof) < PROOF or proof.mean() < SURE:
                    continue
                open_ = np.flatnonzero(pool & (known[other] < 0) & (q >= SURE))
                known[other][open_[np.argsort(-q[open_], kind="stable")[:EXCHANGE]]] = c
    z = np.stack([a * linear(x[held], w) + b for x, w, (a, b) in zip(views, fits, scales, strict=True)], 1).astype(np.float64)
    both = fit_logistic(np.clip(z, -20, 20) / 10, y[held].astype(np.float64), l2=1e-4, steps=1000) / np.array([10, 10, 1])
    model = Model(tuple(fits), tuple(scales), both, 0.5)
    good = model.score(text[held & (y == 1)], meta[held & (y == 1)])[2]
    return Model(tuple(fits), tuple(scales), both, float(min(0.5, np.quantile(good, LOSS))))


def _views(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    clean = lambda x: None if x is None or x != x else x
    rows = [tuple(map(clean, r)) for r in zip(text, lang, source, n_chars, strict=True)]
    return np.stack([text_view(t or "") for t, *_ in rows]), np.stack([meta_view(t or "", *r) for t, *r in rows])


def _packed(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    out: list[tuple[bytes, bytes]] = []
    for at in range(0, len(text), 256):
        out += [(t.tobytes(), m.tobytes()) for t, m in zip(*(x.astype(PACKED) for x in _views(*(c.iloc[at : at + 256] for c in (text, lang, source, n_chars)))), strict=True)]
    released()
    return pd.DataFrame(out, columns=["t", "m"])


COLUMNS = ("text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """The model of a bounded sample of the documents."""
    small_batches(docs.sparkSession)
    with passing():
        order = F.xxhash64(F.lit(SEED), "k")
        mean = Cut(labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y")), "label-means")
        present = docs.select(F.col(key).alias("k")).join(small_side(mean), "k").select("k", "y").distinct()  # labels without a document do not count
        labelled = Cut(present.orderBy(order, "k").limit(MOST_LABELLED * 2), "labelled")
        pool = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).orderBy(order, "k").limit(MOST_POOL)
        chosen = Cut(labelled.df.unionByName(pool.join(small_side(labelled).select("k"), "k", "left_anti").distinct().withColumn("y", F.lit(-1))), "chosen")
        rows = docs.select(F.col(key).alias("k"), *COLUMNS).join(small_side(chosen), "k")
        rows = rows.groupBy("k", "y").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("r")).select("k", "y", "r.*")
        packed = F.pandas_udf(_packed, "struct<t:binary,m:binary>")
        found = rows.select("k", "y", packed(*COLUMNS).alias("f")).select("k", "y", order.alias("h"), "f.t", "f.m").orderBy("h", "k").limit(MOST_LABELLED + MOST_POOL).toArrow()
    if not found.num_rows:
        return constant(1.0)
    text, meta = (_unpacked(found[c]) for c in ("t", "m"))
    return cotrain(text, meta, found["y"].to_numpy())


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of packed features, each chunk read in place."""
    held = [c for c in column.chunks if len(c)]
    width = len(column[0].as_py())
    return np.concatenate([np.frombuffer(c.buffers()[2], np.uint8, len(c) * width, c.offset * width).view(PACKED).reshape(len(c), -1) for c in held])


def scores(model: Model) -> Column:
    """A struct (p_text, p_meta, score) of the columns text, lang, source and n_chars."""

    @F.pandas_udf("struct<p_text:double,p_meta:double,score:double>")
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(text), 512):
            part = [x.iloc[at : at + 512] for x in (text, lang, source, n_chars)]
            out.append(np.stack(model.score(*_views(*part)), 1))
        released()
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3)), columns=["p_text", "p_meta", "score"], dtype="float64")

    return run(*COLUMNS)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, columns unchanged."""
    model = fit(docs, labels)
    return docs.where(scores(model)["score"] >= model.cut)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", scores(model).alias("s")).select("doc_id", "s.p_text", "s.p_meta", "s.score", (F.col("s.score") >= model.cut).alias("keep"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
