"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are counts of hashed n-grams of its words and of its words' shapes (runs of capitals, small letters
and digits become one letter each; other characters stay, repeats as one), with marks for a word that repeats its
predecessor. They are divided by the number of words, so that a score is a sparse dot product of weights and shares.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their ids over all labels; their
features are made in parallel and gathered in one task, which learns sample by sample. All rows are scored, with the
broadcast weights (2 ** BITS floats).

Defined results: a null or blank text has no features and scores the intercept; without usable labels every score is
0.5; several labels of one id count as their minimum, null labels not at all; of several texts of a labelled id one is
learned; repeated rows and further columns stay, but for columns named like the added ones, which these replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

BITS = 18
TRAIN_ROWS = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-3, 1e-3
#: Logits are this many times the mean weight of the n-grams of a family.
SCALE = 20.0
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
CACHE_WORDS = 80_000

_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASS = {**{c: "A" for c in range(65, 91)}, **{c: "a" for c in range(97, 123)}, **{c: "0" for c in range(48, 58)}}


def shape(word: str) -> str:
    """Aa for Word, a# for word###, A!! as A!, a.0 for x.12: character classes, each run once."""
    classes = word.translate(_CLASS) if word.isascii() else "".join(_CLASS.get(ord(c)) or ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c) for c in word)
    return "".join(c for i, c in enumerate(classes) if not i or c != classes[i - 1])[:12]


class _Hashes(dict):
    """(hash of the lowered word, hash of the shape) of a word, both of 32 bits in one number."""

    def __missing__(self, word: str) -> int:
        made = crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | crc32(shape(word).encode("utf-8", "surrogatepass"))
        if len(word) > 100:
            return made
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made
        return made


_hashes = _Hashes()


def _slots(keys: np.ndarray, salt: int) -> np.ndarray:
    mixed = (keys + np.uint64(salt)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)) & _MASK


def ngrams(text: str | None) -> list[np.ndarray]:
    """Slots of the n-grams of each family, with repeats: words, word pairs, shapes, shape pairs, repeat marks."""
    words = (text or "").split()
    if not words:
        return []
    both = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(words), np.uint64)
    again[1:] = word[1:] == word[:-1]
    out = [_slots(word, 1), _slots(form, 3), _slots(again, 5)]
    if len(words) > 1:
        out += [_slots(word[:-1] * np.uint64(31) + word[1:] * _MIX, 2), _slots(form[:-1] * np.uint64(31) + form[1:] * _MIX, 4)]
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values: SCALE times the share within the family, summed where slots meet."""
    families = ngrams(text)
    if not families:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, where = np.unique(np.concatenate(families), return_inverse=True)
    shares = np.concatenate([np.full(len(f), SCALE / len(f)) for f in families])
    return slots.astype(np.int32), np.bincount(where, shares).astype(np.float32)


def learn(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates; the last one is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for slots, shares, y in samples:
            at, x = np.append(slots, size - 1), np.append(shares, np.float64(1.0))
            w = weights(at)
            g = (_logistic(w @ x) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = (
        usable.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(rows)
    )
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").cast(pa.string()), b.column("_label"), pa.array([s.tobytes() for s, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["id", "label", "slots", "shares"],
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = []
        for b in batches:
            rows_ += [(crc32(i.encode()), i, s, v, y) for i, s, v, y in zip(*(b.column(c).to_pylist() for c in ("id", "slots", "shares", "label")), strict=True)]
        rows_.sort()
        w = learn([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for _, _, s, v, y in rows_])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    # Of rows that repeat an id the smallest counts, so that the bound on labels is one on samples too.
    made = sample.mapInArrow(tidy(featured, _hashes), "id string, label int, slots binary, shares binary")
    made = made.groupBy("id").agg(F.min(F.struct("label", "slots", "shares")).alias("s")).select("id", "s.*")
    found = made.repartition(1).mapInArrow(tidy(fitted), "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability (double) that a text is of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for texts in batches:
            out = []
            for t in texts:
                logit = float(w[-1])
                for family in ngrams(t.as_py()):
                    logit += SCALE * float(w[family].mean(dtype=np.float64))
                out.append(_logistic(logit))
            yield pa.array(out, pa.float64())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(scores, _hashes)(batches)

    return df.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds held_out, score and predicted (1 where the score is THRESHOLD or more) to every row."""
    scored = score(docs, train(docs, labels, doc_id=doc_id, text=text), text)
    return scored.withColumns({
        "held_out": F.coalesce(held_out(F.col(doc_id)), F.lit(False)),
        "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0),
    })
