"""Document quality by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else in training is unlabelled web text.
The share of good rows in it is given (where an unbiased set of labels tells it) or estimated from
the purest scores of a first classifier, and a small network then minimises the non-negative
unbiased risk. Features are shares of character
classes, word shapes and repetition, taken from the whole text.

Defined results: a null text is scored as the empty one; rows without a positive label in
training give score 1 everywhere when there is none to learn from; equal texts score equally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import map_texts, mix64, pieces, release

#: Rows that training may use, at most; the only bounds here, and on training alone.
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
THRESHOLD = 0.7
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Space, letter, capital, digit, other code points, then each ASCII symbol of its own.
CLASSES = 5 + len(SYMBOLS)


def class_table() -> np.ndarray:
    table = np.full(0x110000, 1, np.uint8)
    table[:0x80] = 4
    for c in "\t\n\x0b\x0c\r \x85\xa0  　":
        table[ord(c)] = 0
    for c in range(0x250):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 2 if ch.isupper() else 1
        elif ch.isdigit():
            table[c] = 3
    table[0x2010:0x2E80] = 4
    for i, ch in enumerate(SYMBOLS):
        table[ord(ch)] = 5 + i
    return table


TABLE = class_table()
EXTRAS = 11
WIDTH = CLASSES + EXTRAS


def features(texts: list[str | None]) -> np.ndarray:
    """One row of shares for each text; zeros for one without a character."""
    texts = [t or "" for t in texts]
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = TABLE[points]
    owner = np.repeat(np.arange(n), sizes + 1)
    inside = np.ones(len(owner), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    body, owner_body = kind[1:-1][inside[:-1]] if n else kind[:0], owner[inside]
    counts = np.bincount(owner_body * CLASSES + body, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    made = np.zeros((n, WIDTH))
    made[:, :CLASSES] = np.sqrt(counts / np.maximum(1, sizes)[:, None])

    # Words: runs without space; a hash of each from prefix sums of a polynomial.
    solid = kind != 0
    edge = np.diff(solid.astype(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    doc = owner[start - 1] if len(start) else np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(1, words)
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / some
    length = stop - start
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    n_letters, n_capitals = letters[stop] - letters[start], capitals[stop] - capitals[start]
    base = np.uint64(0x9E3779B97F4A7C15)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
    order = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) * base) * np.arange(len(points), dtype=np.uint64), dtype=np.uint64)])
    plain = mix64(points.astype(np.uint64) * base)
    weight = np.concatenate([np.zeros(1, np.uint64), np.cumsum(plain, dtype=np.uint64)])
    # Sum of values and sum of values times place: equal words agree wherever they stand.
    word = mix64(total[stop] - total[start]) ^ (order[stop] - order[start] - (weight[stop] - weight[start]) * start.astype(np.uint64))
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount((np.unique(np.stack([doc.astype(np.uint64), word]), axis=1)[0]).astype(np.int64), minlength=n) if len(doc) else np.zeros(n)
    last = kind[stop - 1] if len(stop) else kind[:0]
    made[:, CLASSES:] = np.stack(
        [
            np.log1p(sizes) / 10,
            np.log1p(words) / 10,
            np.minimum(mean(length), 40) / 10,
            np.sqrt(mean((n_letters > 1) & (n_capitals == n_letters))),
            np.sqrt(mean((last >= 5) & (n_letters > 0))),
            np.sqrt(mean(n_letters == 0)),
            np.sqrt(mean(again)),
            distinct / some,
            np.sqrt([1 - len(set(lines)) / len(lines) for lines in (t.split("\n") for t in texts)]) if n else np.zeros(0),
            np.sqrt(mean((n_capitals > 0) & (n_capitals < n_letters))),
            np.log1p([t.count("\n") for t in texts]) / 10,
        ],
        axis=1,
    )
    return made


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 300, decay: float = 1e-3, seed: int = 7) -> Network:
    """With a prior: non-negative risk  prior*R+(P) + max(0, R-(U) - prior*R-(P)).  Without: P against U."""
    both = np.concatenate([positive, unlabelled])
    rng = np.random.default_rng(seed)
    net = Network(both.mean(axis=0), both.std(axis=0) + 0.02, rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = np.clip((both - net.mean) / net.scale, -8, 8)
    p, n_p, n_u = np.arange(len(both)) < len(positive), len(positive), len(unlabelled)
    moments = [[np.zeros_like(np.asarray(v, float)) for v in (net.w1, net.b1, net.w2, net.b2)] for _ in range(2)]
    for step in range(1, steps + 1):
        h = np.tanh(z @ net.w1 + net.b1)
        f = h @ net.w2 + net.b2
        up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of the loss of calling a row bad
        if prior is None:
            g = np.where(p, -(1 - up) / n_p, up / n_u)
        else:
            rest = softplus(f[~p]).mean() - prior * softplus(f[p]).mean()
            unlabelled_part = np.where(p, -prior * up / n_p, up / n_u)
            # Below zero the rest is over-fitted: climb back along its own slope.
            g = np.where(p, -prior * (1 - up) / n_p, 0.0) + unlabelled_part if rest >= 0 else -unlabelled_part
        back = np.outer(g, net.w2) * (1 - h * h)
        slopes = [z.T @ back + decay * net.w1, back.sum(axis=0), h.T @ g + decay * net.w2, g.sum()]
        new = []
        for i, (v, s) in enumerate(zip((net.w1, net.b1, net.w2, net.b2), slopes)):
            moments[0][i] = 0.9 * moments[0][i] + 0.1 * s
            moments[1][i] = 0.999 * moments[1][i] + 0.001 * s * s
            new.append(v - 0.02 * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.999**step)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = new
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.05) -> float:
    """Share of good rows among the unlabelled: the smallest ratio of tails above a cut.

    A cut between P and U is learnt on one half and read on the other. Above it, both tails hold
    good rows only in the best case, and then their ratio is the share sought.
    """
    net = fit(positive[::2], unlabelled[::2], None, steps=200)
    p, u = np.sort(net.logits(positive[1::2]))[::-1], np.sort(net.logits(unlabelled[1::2]))[::-1]
    if not len(p) or not len(u):
        return 0.5
    k = np.arange(max(1, int(least_share * len(p))), len(p) + 1)
    tail_p, tail_u = k / len(p), np.searchsorted(-u, -p[k - 1], side="right") / len(u)
    slack = np.sqrt(np.log(10) / 2 / len(u)) + np.sqrt(np.log(10) / 2 / len(p))
    best = int(np.argmin((tail_u + slack) / tail_p))
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.95))


@dataclass
class Model:
    network: Network | None
    prior: float


def drawn(share: float) -> Column:
    """Whether a row is in a sample of about this share, by all 64 bits of a hash: for any number of rows."""
    return F.xxhash64("doc_id", F.lit(1)).cast("double") < share * 2.0**64 - 2.0**63 if share < 1 else F.lit(True)


def train(docs: DataFrame, positives: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """docs: rows to learn from; positives: one column of ids trusted as good.

    Both samples are bounded and chosen by a hash of the id, so what reaches the driver is too.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trusted = positives.toDF("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive)
    n = rows.count()
    chosen = rows.where(drawn(most_unlabelled / max(1, n)))
    # The ids are `most_positive` at most, so they may be broadcast.
    good = rows.join(F.broadcast(trusted), "doc_id")

    def kernel(texts):
        return {"x": list(features(texts))}

    def collected(df: DataFrame) -> np.ndarray:
        made = map_texts(df, kernel, "x array<double>", ["text"], step=1 << 19).toPandas()["x"]
        return np.array(sorted(made.tolist())).reshape(-1, WIDTH)

    p, u = collected(good), collected(chosen)
    if n > most_unlabelled and not len(u):
        raise ValueError(f"none of {n} rows was drawn as unlabelled")
    if len(p) < 2 or len(u) < 2:
        return Model(None, 1.0)
    rng = np.random.default_rng(3)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    prior = estimate_prior(p, u) if prior is None else prior
    return Model(fit(p, u, prior), prior)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    return model.network.scores(features(texts)) if model.network else np.ones(len(texts))


def predict(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and whether it reaches the threshold, for every row."""

    def kernel(ids, texts):
        s = score_texts(model, texts)
        return {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, score double, predicted int", step=1 << 19)


def keep_good(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that reach the threshold."""
    text = df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for part in pieces(batch, text, 1 << 19):
                yield part.filter(pa.array(score_texts(model, part.column(text).to_pylist()) >= threshold))
        release()

    return df.mapInArrow(keep, df.schema)
