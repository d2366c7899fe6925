"""Operator 1: quality classification by attention-based multiple-instance learning.

A document is a bag of passages (64 consecutive tokens, the whole text).  Every passage is encoded: byte-class bigrams,
hashed tokens, shape and repetition rates go through a learned layer.  Gated attention, learned from document labels
alone, weighs the passages; the weighted sum is the document's representation, which a logistic unit scores.

Training takes a bounded sample, `PER_LABEL` documents of each label (chosen by a hash of the id), weighted back to the
labels' true shares; of a document with more than `TRAIN_PASSAGES` passages that many are drawn from its whole length, by
a hash of their numbers.  Only the sample's passage features reach the driver.  Scoring uses every passage of every document.

Defined cases: a null or empty text is one empty passage and gets a score like any other; labels that are null, neither
0 nor 1, or of unknown documents are ignored, and of several labels of one id the least counts; repeated rows get equal
scores; with fewer than two labels the score is the share of label 1 (0.5 with none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import byte_table, mix, runs, slices, span_hash

PASSAGE, PER_LABEL, TRAIN_PASSAGES = 64, 1200, 64
_LOWER = byte_table(words=False)
_CLASSES = 12


def _byte_classes() -> np.ndarray:
    c = np.full(256, 11, np.uint8)  # other punctuation
    c[128:] = 0
    c[97:123], c[65:91], c[48:58] = 1, 2, 3
    c[:33] = 4
    c[10] = 5
    for k, group in enumerate((b".", b",;:", b"!?", b"#%&*$@^~+=", b"|<>[]{}\\/_"), 6):
        c[list(group)] = k
    return c


_CLASS = _byte_classes()
_HASHED, _SHAPES = 64, 10
_AT_ONCE = 4096
FEATURES = _CLASSES * _CLASSES + _HASHED + _SHAPES


def passages(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text with the end); each text has one passage at least.
    most: of longer texts, that many passages, drawn over the whole text."""
    starts, ends = runs(data > 32, offsets)
    first = np.searchsorted(starts, offsets)
    per_text = np.diff(first)
    n_pass = np.maximum(1, -(-per_text // PASSAGE))
    whole = np.concatenate([[0], np.cumsum(n_pass)])
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    owner = whole[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE
    bounds = whole
    if most and n_pass.max(initial=0) > most:
        drawn = [np.arange(n) if n <= most else np.sort(np.argsort(mix(np.arange(n, dtype=np.uint64)), kind="stable")[:most]) for n in n_pass]
        bounds = np.concatenate([[0], np.cumsum(np.minimum(n_pass, most))])
        number = np.full(int(whole[-1]), -1)
        number[np.concatenate([a + d for a, d in zip(whole, drawn, strict=False)])] = np.arange(int(bounds[-1]))
        owner = number[owner]
        keep = owner >= 0
        starts, ends, owner, text_of = starts[keep], ends[keep], owner[keep], text_of[keep]
    out = np.zeros((int(bounds[-1]), FEATURES), np.float32)
    # bytes: from a token's start to the next token's (or its own end, at a passage's last)
    follows = np.append(owner[1:] == owner[:-1], False)
    reach = np.where(follows, np.append(starts[1:], 0), ends) - starts
    for a in range(0, len(out), _AT_ONCE):  # tables of a bounded number of passages, however long a text is
        x, y = np.searchsorted(owner, (a, a + _AT_ONCE))
        _features(data, starts[x:y], ends[x:y], reach[x:y], owner[x:y] - a, out[a : a + _AT_ONCE])
    return out, bounds


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Fill out, a row for each passage, from the passages' tokens (owner: the row of each)."""
    total = len(out)
    if not len(starts):
        return
    n = np.bincount(owner, minlength=total).astype(np.float32)
    safe = np.maximum(n, 1)
    at = np.repeat(starts - np.append(0, np.cumsum(reach)[:-1]), reach) + np.arange(int(reach.sum()))
    cls = _CLASS[data[at]].astype(np.int64)
    of = np.repeat(owner, reach)
    same = of[1:] == of[:-1]
    pair = (of[:-1] * (_CLASSES * _CLASSES) + cls[:-1] * _CLASSES + cls[1:])[same]
    size = np.maximum(np.bincount(of, minlength=total), 1)[:, None]
    out[:, : _CLASSES * _CLASSES] = np.sqrt(np.bincount(pair, minlength=total * _CLASSES * _CLASSES).reshape(total, -1) / size)
    begin, end = int(starts[0]), int(ends[-1])
    part, starts, ends = data[begin:end], starts - begin, ends - begin
    h = span_hash(_LOWER[part], starts, ends)
    col = _CLASSES * _CLASSES
    out[:, col : col + _HASHED] = np.sqrt(np.bincount(owner * _HASHED + (h >> np.uint64(58)).astype(np.int64), minlength=total * _HASHED).reshape(total, -1) / safe[:, None])
    col += _HASHED
    rate = lambda flag: np.bincount(owner, weights=flag, minlength=total) / safe
    length = (ends - starts).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum((part >= 65) & (part <= 90))])
    lower = np.concatenate([[0], np.cumsum(((part >= 97) & (part <= 122)) | (part >= 128))])
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    again = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    before = np.append([False, False], (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])) if len(h) > 1 else np.zeros(len(h), bool)
    seen = np.bincount(owner * 512 + (h & np.uint64(511)).astype(np.int64), minlength=total * 512).reshape(total, 512)
    mean = rate(length)
    shapes = [n / PASSAGE, np.log1p(mean), np.sqrt(np.maximum(rate(length**2) - mean**2, 0)) / 8, rate((ups > 1) & (lows == 0)), rate((ups > 0) & (lows > 0)), rate(lows + ups == 0), rate(again), rate(before), (seen > 0).sum(1) / safe, seen.max(1) / safe]
    out[:, col:] = np.stack(shapes, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage layer, gated attention and scorer, fitted by Adam on bags of passages."""

    def __init__(self, share: float = 0.5):
        self.share, self.p = share, None

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 25, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x = self._scaled(x)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(x.shape[1], hidden), "a": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "b": np.full(1, np.log(self.share / (1 - self.share)), np.float32)}
        m, v, t = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            step = rate * (1 - epoch / epochs)
            for s in range(0, len(order), batch):
                bags = order[s : s + batch]
                rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in bags])
                cut = np.concatenate([[0], np.cumsum(bounds[bags + 1] - bounds[bags])])
                grads, t = self._gradients(x[rows], cut, y[bags], weight[bags]), t + 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def _forward(self, x: np.ndarray, cut: np.ndarray):
        p, first, sizes = self.p, cut[:-1], np.diff(cut)
        e = np.tanh(x @ p["W"] + p["a"])
        g, s = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        logit = ((g * s) @ p["w"])[:, 0]
        part = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), sizes))
        attention = part / np.repeat(np.add.reduceat(part, first), sizes)
        z = np.add.reduceat(attention[:, None] * e, first)
        return e, g, s, attention, z, _sigmoid((z @ p["c"])[:, 0] + p["b"][0])

    def _gradients(self, x, cut, y, weight):
        p, first, sizes = self.p, cut[:-1], np.diff(cut)
        e, g, s, a, z, out = self._forward(x, cut)
        d = ((out - y) * weight / len(y))[:, None].astype(np.float32)
        dz = np.repeat(d @ p["c"].T, sizes, 0)
        along = (dz * e).sum(1)
        dl = (a * (along - np.repeat(np.add.reduceat(a * along, first), sizes)))[:, None]
        dgs = dl @ p["w"].T
        dg, ds = dgs * s * (1 - g * g), dgs * g * s * (1 - s)
        de = a[:, None] * dz + dg @ p["V"].T + ds @ p["U"].T
        dx = de * (1 - e * e)
        return {"W": x.T @ dx, "a": dx.sum(0), "V": e.T @ dg, "U": e.T @ ds, "w": (g * s).T @ dl, "c": z.T @ d, "b": d.sum(0)}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each document, attention of each passage)."""
        if self.p is None:
            return np.full(len(bounds) - 1, self.share), np.ones(len(x))
        *_, attention, _, out = self._forward(self._scaled(x), bounds)
        return out.astype(np.float64), attention


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> AttentionModel:
    """usable: which ids (column _id) may be learned from.  A label of 1 is what a high score means."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").where(usable)
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return AttentionModel(share)
    draw = F.xxhash64(F.lit("sample"), "_id")
    chosen = [known.where(F.col("_label") == k).orderBy(draw, "_id").limit(per_label) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_label rows at most
    bags = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id").select("_id", "_label", "_text")
    # Repeated documents count once, so the sample stays bounded.
    bags = bags.groupBy("_id").agg(F.first("_label").alias("_label"), F.max("_text").alias("_text"))

    def features(batches):
        for rows, data, offsets in slices(batches):
            x, bounds = passages(data, offsets, TRAIN_PASSAGES)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["_id", "_label", "x"])

    id_type = bags.schema["_id"].dataType.simpleString()
    rows = sorted(bags.mapInArrow(features, f"_id {id_type}, _label int, x binary").collect(), key=lambda r: r["_id"])
    if len({r["_label"] for r in rows}) < 2:
        return AttentionModel(share)
    x = [np.frombuffer(r["x"], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([r["_label"] for r in rows], np.float32)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    return AttentionModel(share).fit(np.concatenate(x), np.concatenate([[0], np.cumsum([len(a) for a in x])]), y, weight)


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column | None = None, least: float = 0.5, **columns: str) -> DataFrame:
    """The rows of docs, with their columns, that a model learned from labels scores at least so high."""
    names = docs.columns
    model = train(docs, labels, F.lit(True) if usable is None else usable, **columns)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])  # private names, since results are added
    scored = score(plain, model, text_col=f"_c{names.index(columns.get('text_col', 'text'))}")
    return scored.where(F.col("score") >= least).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


RESULTS = "score", "n_passages", "focus"


def score(df: DataFrame, model: AttentionModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of df (default: all), with score (0 to 1), n_passages and focus (the number of the passage with most
    attention); columns of df with these names give way to them."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in RESULTS]
    # A text that is kept travels once.
    rest = {c: f"_k{i}" for i, c in enumerate(keep) if c != text_col}
    kept = df.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(x) for c, x in rest.items()])
    names = [*(["_text"] if text_col in keep else []), *rest.values()]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names] + ["score double", "n_passages bigint", "focus bigint"])

    def run(batches):
        for rows, data, offsets in slices(batches):
            x, bounds = passages(data, offsets)
            s, attention = shared.value.score(x, bounds)
            focus = [int(attention[a:b].argmax()) for a, b in zip(bounds, bounds[1:], strict=False)]
            columns = [rows.column(rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64()), pa.array(np.diff(bounds), pa.int64()), pa.array(focus, pa.int64())], names=[*names, *RESULTS])

    return kept.mapInArrow(run, schema).select(*[F.col(rest.get(c, "_text")).alias(c) for c in keep], *RESULTS)
