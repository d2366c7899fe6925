"""Operator 3: language identification by error-correcting output codes.

Each language has a codeword of +1 and -1 bits.  For each bit a binary classifier over hashed byte n-grams (lengths 1 to
3, square-root counts, unit length) is fitted by regularised least squares.  Decoding adds up the losses of all bits,
each weighted by how well its classifier does when left out, and the nearest codeword wins; where the two nearest lie
close together, the row is flagged ambiguous.

Training takes a bounded sample, `PER_LANGUAGE` texts of each language (chosen by a hash of id and text), fewer where that
would be more than `SAMPLE_ROWS` in all, but one of each language at least; only their n-gram counts reach the driver.

Defined cases: a null, empty or letterless text is `und` with score 0, never ambiguous; repeated rows get equal rows; with no training
row every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import byte_table, mix, slices

FEATURES = 1 << 12
PER_LANGUAGE = 400
SAMPLE_ROWS = 12_000
_LOWER = byte_table(words=False)


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of unit length for each text: square roots of its hashed byte 1-, 2- and 3-gram counts, over the whole text."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    low = _LOWER[data].astype(np.uint32)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * FEATURES
    code = np.zeros(len(low), np.uint32)
    for k in range(1, 4):
        m = len(low) - k + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(256) + low[k - 1 :]
        bucket = ((code + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        inside = text[:m] == text[k - 1 :]  # no n-gram crosses from one text to the next
        place = (text[:m] + bucket)[inside]
        if n == 1:
            out += np.bincount(place, minlength=FEATURES).reshape(out.shape)
        else:
            out += np.bincount(place, minlength=n * FEATURES).reshape(out.shape)
    np.sqrt(out, out)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out / np.maximum(norm, 1e-12)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Exhaustive codes up to six languages; beyond, the random dense code with the largest least distance of 200."""
    if languages <= 2:
        return np.array([[1.0], [-1.0]][:languages])
    if languages <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(columns, np.float64).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(12 * np.log2(languages)))
    tries = (rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(200))
    return max(tries, key=lambda m: (bits - (m @ m.T - 2 * bits * np.eye(languages)).max()) / 2)


class CodeModel:
    """languages, their codewords, the bits' linear classifiers and weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 0.05):
        self.languages, self.code = languages, codewords(len(languages))
        targets = self.code[y]
        # Leave-one-out outputs come from the diagonal of the inverse (dual form) or of the hat matrix (primal, for large samples).
        x = x.astype(np.float64)
        if len(x) <= x.shape[1]:
            inverse = np.linalg.inv(x @ x.T + ridge * np.eye(len(x)))
            dual = inverse @ targets
            self.weights = (x.T @ dual).astype(np.float32)
            left_out = targets - dual / np.diag(inverse)[:, None]
        else:
            inverse = np.linalg.inv(x.T @ x + ridge * np.eye(x.shape[1]))
            weights = inverse @ (x.T @ targets)
            self.weights = weights.astype(np.float32)
            hat = np.einsum("ij,ij->i", x @ inverse, x)[:, None]
            left_out = targets - (targets - x @ weights) / (1 - hat)
        error = np.clip((left_out * targets <= 0).mean(0), 0.5 / len(x), 0.45)
        self.bit_weight = np.log((1 - error) / error)
        self.bit_weight /= self.bit_weight.sum()
        scale = np.abs(left_out).mean() or 1.0
        loss = self._losses(left_out / scale)
        self.scale = scale
        # One temperature, by likelihood of the left-out sample.
        at = np.arange(len(x))
        self.sharpness = max((0.5 * 1.5**i for i in range(20)), key=lambda t: np.log(self._share(loss, t)[at, y] + 1e-12).sum())

    def _losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword (logistic loss of each bit's margin)."""
        return np.stack([np.log1p(np.exp(-np.clip(margins * word, -30, 30))) @ self.bit_weight for word in self.code], 1)

    @staticmethod
    def _share(loss: np.ndarray, t: float) -> np.ndarray:
        e = np.exp(-t * (loss - loss.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, its share of probability, the gap to the second)."""
        share = self._share(self._losses(x @ self.weights / self.scale), self.sharpness)
        best = share.argmax(1)
        ordered = np.sort(share, 1)
        gap = ordered[:, -1] - ordered[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return best, share[np.arange(len(share)), best], gap


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> CodeModel | None:
    """Fit on rows of df where usable holds and lang_col and text are not null; None without such rows."""
    rows = df.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    n = rows.select("_lang").distinct().count()
    if not n:
        return None
    # The sample's draws are found on ids and hashes alone; each task passes on no more of a language than the sample takes.
    drawn = rows.withColumn("_draw", F.struct(F.xxhash64(F.lit("sample"), "_id", F.xxhash64("_text")).alias("a"), F.xxhash64("_text").alias("b")))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw"))
    ranked = drawn.select("_lang", "_draw", place.alias("_place")).where(F.col("_place") <= max(1, min(per_language, SAMPLE_ROWS // n)))
    # Repeated rows have one draw and count once, so the sample stays bounded.
    chosen = drawn.join(F.broadcast(ranked.select("_lang", "_draw").distinct()), ["_lang", "_draw"]).groupBy("_lang", "_draw").agg(F.first("_text").alias("_text")).select("_lang", "_text")
    sample = chosen.mapInArrow(_features, "_lang string, x binary").collect()
    sample.sort()
    languages = sorted({r["_lang"] for r in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in sample])
    return CodeModel(languages, x, np.array([number[r["_lang"]] for r in sample]))


def _features(batches):
    for rows, data, offsets in slices(batches):
        x = ngram_counts(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["_lang", "x"])


def identify(df: DataFrame, model: CodeModel | None, id_col: str = "doc_id", text_col: str = "text", close: float = 0.2) -> DataFrame:
    """One row for each row of df: the id, lang_pred, score, ambiguous (the two nearest shares differ by less than close)."""
    kept = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits numbers: a fixed size
    schema = f"_id {kept.schema['_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"

    def run(batches):
        m = shared.value
        for rows, data, offsets in slices(batches):
            letters = rows.column(2).to_numpy(zero_copy_only=False)
            if m is None:
                names, score, near = np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters), bool)
            else:
                best, score, gap = m.predict(ngram_counts(data, offsets))
                names = np.where(letters, np.array(m.languages, object)[best], "und")
                score, near = np.where(letters, score, 0.0), letters & (gap < close)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(near)], names=["_id", "lang_pred", "score", "ambiguous"])

    return kept.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
