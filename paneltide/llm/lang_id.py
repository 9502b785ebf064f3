"""Language identification of whole texts, with spans where the language changes.

A word's script (fixed Unicode ranges) leaves the languages that use this script in the training
rows. Each word gets a log-likelihood per language from hashed character n-grams with word ends,
and a Viterbi pass with a switching penalty labels the words, so that a change of language costs
more than a few doubtful words can pay.

Defined results: a null text or one without a letter is `und` with score 0; letters of a script
that no training row used give the most frequent language with score 0; so do, with their own
label, words far less likely than those of the language's training rows; ties go to the language
first in alphabetical order; repeated rows each give the same result; a table without a single
labelled row gives `und` everywhere.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import discard, map_texts, mix64, pieces, release, written

#: First code points of ranges and the script in each; fixed values of the Unicode standard.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Training rows taken per language, about; the only bound here, and on training alone.
ROWS_PER_LANGUAGE = 4000
SWITCH_PENALTY = 12.0
#: A text is of no learnt language where its letters are so many deviations less likely than in training;
#: with fewer training rows than this a language has no such floor.
DEVIATIONS, LEAST_ROWS = 8.0, 20
UND = "und"


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case letter (0: none; marks count as letters), whether a letter proper, script."""
    fold, proper = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x30000):
        kind = unicodedata.category(ch := chr(c))[0]
        if kind in "LM":
            low = ch.lower()
            fold[c], proper[c] = ord(low) if len(low) == 1 else c, kind == "L"
    fold[0x30000:0x32400], proper[0x30000:0x32400] = np.arange(0x30000, 0x32400), True
    starts = np.array([a for a, _ in SCRIPTS])
    codes = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return fold, proper, np.repeat(codes, np.diff(np.append(starts, 0x110000)))


@dataclass
class Words:
    """Words (runs of letters) of some texts, on one array of code points."""

    letters: np.ndarray  # folded letters, 0 elsewhere; a 0 stands before each text
    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    doc: np.ndarray
    text_start: np.ndarray
    has_letter: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    fold, proper, script = tables()
    joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    text_start = np.cumsum([1] + [len(t or "") + 1 for t in texts])[:-1]
    letters = fold[points]
    edge = np.diff((letters != 0).astype(np.int8))
    start = np.flatnonzero(edge == 1) + 1
    doc = np.searchsorted(text_start, start, side="right") - 1
    counts = np.add.reduceat(proper[points].astype(np.int32), text_start) if len(texts) else np.zeros(0, np.int32)
    return Words(letters, start, np.flatnonzero(edge == -1) + 1 - start, script[points[start]], doc, text_start, counts > 0)


def gram_buckets(letters: np.ndarray):
    """For each order: the bucket of the n-gram that starts at each place, and whether it counts."""
    x = letters.astype(np.uint64)
    here = letters != 0
    for n in ORDERS:
        h = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
        inner = here[1 : len(x) - n + 2].copy() if n > 2 else here[:-1] | here[1:]
        for k in range(2, n - 1):
            inner &= here[k : len(x) - n + 1 + k]
        yield (mix64(h) >> np.uint64(48)).astype(np.int64), inner


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages
    common: int
    usual: np.ndarray | None = None  # languages x (mean log-likelihood of a letter, variance of texts, of letters)

    def word_scores(self, w: Words) -> np.ndarray:
        """Log-likelihood of each word under each language; far down where the script rules it out."""
        if not len(w.start):
            return np.zeros((0, len(self.languages)), np.float32)
        at = np.zeros((len(w.letters), len(self.languages)), np.float32)
        for bucket, counts in gram_buckets(w.letters):
            place = np.flatnonzero(counts)
            at[place] += self.logp[bucket[place]]
        scores = np.add.reduceat(at, w.start - 1, axis=0) / len(ORDERS)
        scores[~self.uses[w.script]] -= 1000.0
        scores[~self.uses[w.script].any(axis=1)] = 0.0
        return scores

    def too_rare(self, language: np.ndarray, mean: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Whether texts with this mean log-likelihood of a letter lie below the floor of their language."""
        if self.usual is None:
            return np.zeros(len(language), bool)
        centre, texts, each = self.usual[language].T
        return mean < centre - DEVIATIONS * np.sqrt(texts + each / np.maximum(1, letters))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts run in step, longest first, so each step is one array operation."""
    n, k = scores.shape
    label = np.zeros(n, np.int16)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    best_before, stay = np.zeros(n, np.int16), np.zeros((n, k), bool)
    value = np.zeros((len(lengths), k), np.float32)
    for t, a in enumerate(active.tolist()):
        at, v = first[:a] + t, value[:a]
        if t:
            top = v.max(axis=1, keepdims=True) - penalty
            best_before[at] = v.argmax(axis=1)
            stay[at] = v >= top
            np.maximum(v, top, out=v)
        v += scores[at]
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        a = int(active[t])
        at, y = first[:a] + t, now[:a]
        label[at] = y
        if t:
            now[:a] = np.where(stay[at, y], y, best_before[at])
    return label


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Counts n-grams per language over about `per_language` whole rows each, chosen by a hash of the text.

    The rows are counted in two halves, and how likely a letter usually is comes from each half
    under the counts of the other. What reaches the driver is bounded by buckets times languages,
    and by three numbers for each chosen row.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(totals)
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool), 0)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / totals[lang]))))
    half = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)).alias("half")
    if k > np.iinfo(np.int16).max:
        raise ValueError(f"labels have 16 bits; {k} languages are too many")
    # Read twice below; the table is read for it once.
    chosen = written(rows.select("lang", "text", half).where(F.xxhash64("text").cast("double") + 2.0**63 <= share[F.col("lang")] * 2.0**64), "training")
    number = {lang: i for i, lang in enumerate(languages)}
    width = BUCKETS + len(NAMES)

    def count(batches):
        made = np.zeros((2 * k, width), np.int64)
        for batch in batches:
            for part in pieces(batch, 1):
                langs, texts = np.array([number[x] for x in part.column(0).to_pylist()]) + k * part.column(2).to_numpy(), part.column(1).to_pylist()
                w = words_of(texts)
                owner = langs[np.maximum(0, np.searchsorted(w.text_start, np.arange(len(w.letters)), side="right") - 1)]
                for bucket, counts in gram_buckets(w.letters):
                    # A gram that begins at the 0 before a text belongs to the text behind it.
                    at = np.flatnonzero(counts)
                    np.add.at(made, (owner[at + 1], bucket[at]), 1)
                np.add.at(made, (langs[w.doc], BUCKETS + w.script.astype(np.int64)), 1)
        for i in range(2 * k):
            at = np.flatnonzero(made[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(made[i, at])], ["language", "cell", "n"])

    counted = chosen.mapInArrow(count, "language long, cell long, n long").groupBy("language", "cell").agg(F.sum("n").alias("n")).toPandas()
    made = np.zeros((2 * k, width))
    made[counted.language, counted.cell] = counted.n
    common = max(range(k), key=lambda i: totals[languages[i]])
    halves = [model_of(languages, x, common) for x in (made[k:], made[:k])]  # for each half, the other's
    held = df.sparkSession.sparkContext.broadcast(halves)

    def measure(batches):
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                own, fold = np.array([number[x] for x in part.column(0).to_pylist()]), part.column(2).to_numpy()
                for h in (0, 1):
                    at = np.flatnonzero(fold == h)
                    if len(at):
                        letters, mean = likelihood(held.value[h], part.column(1).take(pa.array(at)).to_pylist(), own[at])
                        yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(letters, pa.float64()), pa.array(mean, pa.float64())], ["language", "letters", "mean"])

    measured = chosen.mapInArrow(measure, "language long, letters double, mean double").where("letters > 0").toPandas()
    discard(chosen)
    usual = np.array([usual_of(x.letters.to_numpy(), x["mean"].to_numpy()) for x in (measured[measured.language == i] for i in range(k))])
    model = model_of(languages, made[:k] + made[k:], common)
    model.usual = usual
    return model


def model_of(languages: list[str], made: np.ndarray, common: int) -> Model:
    grams, scripts = made[:, :BUCKETS] + 0.05, made[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    uses = (scripts > 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    return Model(languages, np.ascontiguousarray(logp), uses, common)


def likelihood(model: Model, texts: list[str], language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in words labelled with each text's language, and their mean log-likelihood."""
    w, n = words_of(texts), len(texts)
    scores = model.word_scores(w)
    labels = viterbi(scores, np.bincount(w.doc, minlength=n), SWITCH_PENALTY)
    own = np.flatnonzero((labels == language[w.doc]) & model.uses[w.script, labels])
    letters = np.bincount(w.doc[own], w.length[own], n).astype(float)
    return letters, np.bincount(w.doc[own], scores[own, labels[own]], n) / np.maximum(1, letters)


def usual_of(letters: np.ndarray, mean: np.ndarray) -> tuple[float, float, float]:
    """Centre of the means, and the variance of texts and of single letters that their spread by length shows."""
    if len(mean) < LEAST_ROWS:
        return -np.inf, 0.0, 0.0
    centre = float(np.average(mean, weights=letters))
    texts = each = 1.0
    for _ in range(5):
        weight = 1 / (texts + each / letters)
        fit = np.linalg.lstsq(np.stack([weight, weight / letters], axis=1), weight * (mean - centre) ** 2, rcond=None)[0]
        texts, each = np.maximum(fit, (1e-4, 1.0))
    return centre, float(texts), float(each)


def label(model: Model, texts: list[str | None], penalty: float = SWITCH_PENALTY) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans (language:start:end, code points) of each text.

    The score is the share of letters, those of all scripts, in words of the language, times how sure
    these words are; it is 0 where they are less likely than the language's floor.
    """
    w, k, n = words_of(texts), len(model.languages), len(texts)
    if not k:
        return [UND] * n, [0.0] * n, [""] * n
    scores = model.word_scores(w)
    lengths = np.bincount(w.doc, minlength=n)
    labels = viterbi(scores, lengths, penalty)
    known = model.uses[w.script].any(axis=1)
    weight = np.zeros((n, k))
    np.add.at(weight, (w.doc[known], labels[known]), w.length[known])
    total = weight.sum(axis=1)
    pred = weight.argmax(axis=1)
    own = known & (labels == pred[w.doc])
    sums = np.zeros((n, k))
    np.add.at(sums, w.doc[own], scores[own])
    words = np.bincount(w.doc[own], minlength=n)
    mean = sums / np.maximum(1, words)[:, None] * np.minimum(words, 10)[:, None]
    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
    sure = odds[np.arange(n), pred] / odds.sum(axis=1)
    share = weight[np.arange(n), pred] / np.maximum(1, np.bincount(w.doc, w.length, n))
    typical = ~model.too_rare(pred, sums[np.arange(n), pred] / np.maximum(1, weight[np.arange(n), pred]), weight[np.arange(n), pred])
    score = np.where((total > 0) & typical, share * sure, 0.0)
    pred = np.where(total > 0, pred, model.common)
    langs = [model.languages[p] if ok else UND for p, ok in zip(pred.tolist(), w.has_letter.tolist())]
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (w.doc[1:] != w.doc[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(labels))[: len(heads)] - 1
    spans: list[list[str]] = [[] for _ in texts]
    base = w.text_start[w.doc[heads]]
    for d, y, a, b in zip(w.doc[heads].tolist(), labels[heads].tolist(), (w.start[heads] - base).tolist(), (w.start[tails] + w.length[tails] - base).tolist()):
        spans[d].append(f"{model.languages[y]}:{a}:{b}")
    return langs, np.where(w.has_letter, score, 0.0).tolist(), [",".join(s) for s in spans]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans of every row; the model goes to the workers as a broadcast of fixed size."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def kernel(ids, texts):
        langs, scores, spans = label(held.value, texts)
        return {"doc_id": ids, "lang_pred": langs, "score": scores, "spans": spans}

    return map_texts(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), kernel, "doc_id long, lang_pred string, score double, spans string", step=1 << 20)


def keep_identified(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose language is known with at least this score."""
    held = df.sparkSession.sparkContext.broadcast(model)
    text = df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                langs, scores, _ = label(held.value, part.column(text).to_pylist())
                yield part.filter(pa.array([x != UND and s >= least for x, s in zip(langs, scores)], pa.bool_()))
        release()

    return df.mapInArrow(keep, df.schema)
