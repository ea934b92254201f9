"""Toxicity by multiple-instance learning: noisy-or over sentences, trained on document labels.

A document is toxic if one of its sentences is, or by a leak that stands for label noise:
``1 - P(doc) = (1 - leak) * prod(1 - p(sentence))``, with a logistic ``p`` over the distinct
words of a sentence, each with the weights of the word itself and of its beginnings. Only document labels are used; the fitted sentence scores then locate the
offending sentences.

The model is fitted in one task from at most ``SAMPLE_DOCS`` labelled documents of at
most ``SAMPLE_CHARS`` characters each, picked by a hash of the id; the driver gets the
weights, no text. Features are screened by
their association with the label over distinct contexts, i.e. a word with its two
neighbours (signed G², at least ``SCREEN``; what copies and near copies repeat counts
once), then the noisy-or weights of the screened ones and the
leak are fitted together. The bias is fixed so low that only words, never length, make a
document toxic. What is broadcast are those weights (at most ``MAX_FEATURES``). Every whole text is scored, one scan, no shuffle.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 4000
SAMPLE_CHARS = 100_000
#: Lengths of the beginnings of a word that are features beside the word.
BEGINNINGS = (3, 4, 5, 6)
SCREEN = 20.0
#: A feature is this many times as frequent in label 1 as in label 0.
LIFT = 5.0
BIAS = -14.0
MAX_FEATURES = 5000
#: Every screened feature starts strong enough to mark a sentence alone; clean documents take it back.
STEPS, RATE, START, MOST = 600, 0.05, 15.0, 20.0
#: Words whose weights a task keeps at hand (about 130 MB for 500,000, 70 MB for 50,000).
CACHE_WORDS = 50_000

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]  # by feature
    bias: float
    leak: float

    def score(self, text: str | None, weight_of: dict) -> float:
        """Noisy-or of all sentences; an empty or null text has the leak alone."""
        tokens = _TOKEN.findall(text.lower()) if text else []
        log_clean = np.log1p(-self.leak)
        if tokens:
            w = np.fromiter(map(weight_of.__getitem__, tokens), dtype=np.float64, count=len(tokens))
            stop = np.isnan(w)
            sentence = np.cumsum(stop)
            hit = np.flatnonzero((w != 0) & ~stop)
            z = np.zeros(int(sentence[-1]) + 1)
            if len(hit):  # each word counts once in a sentence
                key = {(int(sentence[i]), tokens[i]): w[i] for i in hit}
                for (s, _), v in key.items():
                    z[s] += v
            words = np.bincount(sentence[~stop], minlength=len(z)) > 0
            log_clean -= np.logaddexp(0, z[words] + self.bias).sum()
        return float(-np.expm1(log_clean))

    def cache(self) -> WeightCache:
        return WeightCache(self)

    def sentences(self, text: str | None, least: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that score ``least`` or more."""
        out, weight_of = [], self.cache()
        for m in re.finditer(r"[^.!?\n]+", text or ""):
            words = {t for t in _TOKEN.findall(m[0].lower())}
            if words:
                p = 1 / (1 + np.exp(-(self.bias + sum(weight_of[w] for w in words))))
                if p >= least:
                    out.append((m.start(), m.end(), float(p)))
        return out


class WeightCache(dict):
    """word → sum of its features' weights, filled as words come by and emptied when full; NaN for a sentence's end."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.of = model.weights
        self.update(dict.fromkeys(_STOPS, np.nan))

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(dict.fromkeys(_STOPS, np.nan))
        v = self[word] = sum(self.of.get(f, 0.0) for f in features(word))
        return v


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", sample: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``sample`` labelled rows that aren't held out: toxic, text."""
    picked = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("toxic"))
              .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
              .groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(
        F.length("text") <= SAMPLE_CHARS)
    return (texts.join(F.broadcast(picked), "id").select("id", "text", "toxic")
            .orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample))


def fit(sample: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample (``training_sample``) in one task; repeatable, whatever order rows come in."""
    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fit_rows((t or "", int(y)) for frame in frames for t, y in zip(frame["text"], frame["toxic"]))
        yield pd.DataFrame({"feature": [None, *model.weights], "weight": [model.leak, *model.weights.values()]})

    rows = sample.select("text", "toxic").coalesce(1).mapInPandas(fitted, "feature string, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in rows}  # the leak has no name
    return ToxicityModel(weights, BIAS, weights.pop(None)) if rows else fit_rows([])


def fit_rows(rows: Iterable[tuple[str, int]]) -> ToxicityModel:
    """Fit on (text, label) rows that fit in memory."""
    vocabulary: dict[str, int] = {}
    number = lambda w: -1 if w in _STOPS else vocabulary.setdefault(w, len(vocabulary))
    rows = sorted(rows)
    docs = [(np.array([number(w) for w in _TOKEN.findall(t.lower())], dtype=np.int32), y) for t, y in rows]
    del rows
    label = np.array([y for _, y in docs], dtype=np.float64)
    rate = label.mean() if len(label) else 0.0
    nothing = ToxicityModel({}, BIAS, float(min(max(rate, 1e-4), 0.49)))
    if not 0 < label.sum() < len(label):
        return nothing
    # screening: distinct contexts of a word, by the document's label
    contexts = np.zeros((2, len(vocabulary) + 1))
    for t in (0, 1):
        flat = np.concatenate([np.concatenate([[-1], words, [-1]]) for words, y in docs if y == t]).astype(np.int64) + 1
        near = np.int64((1 << 20) - 1)  # a neighbour counts by 20 bits of its number
        word = flat[1:-1] << 40
        word |= (flat[:-2] & near) << 20
        word |= flat[2:] & near
        del flat
        word = np.unique(word) >> 40
        contexts[t] = np.bincount(word[word > 0] - 1, minlength=len(vocabulary) + 1)
    n0, n1 = np.maximum(contexts.sum(1), 1)
    words = list(vocabulary)
    toxic: dict[str, float] = {}
    for i in np.flatnonzero(contexts[1]).tolist():
        for f in features(words[i]):
            toxic[f] = toxic.get(f, 0.0) + contexts[1, i]
    toxic = {f: a for f, a in toxic.items() if a >= 3}
    clean = dict.fromkeys(toxic, 0.0)
    for i in np.flatnonzero(contexts[0]).tolist():
        for f in features(words[i]):
            if f in clean:
                clean[f] += contexts[0, i]
    names = [f for f, a in toxic.items() if a / n1 > LIFT * clean[f] / n0]
    a, b = np.array([toxic[f] for f in names]), np.array([clean[f] for f in names])
    del toxic, clean
    expect = (a + b) * n1 / (n1 + n0)
    ln = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(y, 1e-9)), 0)
    g2 = 2 * (ln(a, expect) + ln(b, a + b - expect) + ln(n1 - a, n1 - expect) + ln(n0 - b, n0 - (a + b - expect)))
    best = sorted((-g, f) for g, f in zip(g2, names) if g >= SCREEN)[:MAX_FEATURES]
    if not best:
        return nothing
    place = {f: i for i, (_, f) in enumerate(sorted(best, key=lambda x: x[1]))}
    of_word = {i: fs for i, w in enumerate(words) if (fs := [place[f] for f in features(w) if f in place])}
    marked = np.zeros(len(words) + 1, dtype=bool)
    marked[list(of_word)] = True
    # sentences with a screened feature, one entry per word and feature; the others are counted
    doc_of, of_sentence, feature, plain = [], [], [], np.zeros(len(docs))
    n = 0
    for d, (doc, _) in enumerate(docs):
        for s in np.split(doc, np.flatnonzero(doc < 0)):
            s = np.unique(s[s >= 0])
            hits = [f for i in s[marked[s]] for f in of_word[i]]
            if hits:
                doc_of.append(d)
                of_sentence.extend([n] * len(hits))
                feature.extend(hits)
                n += 1
            else:
                plain[d] += len(s) > 0
    doc_of, of_sentence, feature = (np.array(x, dtype=np.int64) for x in (doc_of, of_sentence, feature))
    p = np.concatenate([np.full(len(place), START), [-3.0]])  # weights, logit of the leak
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, leak = p[:-1], p[-1]
        z = BIAS + np.bincount(of_sentence, w[feature], minlength=n)
        clean = -np.logaddexp(0, leak) - plain * np.logaddexp(0, BIAS) - np.bincount(doc_of, np.logaddexp(0, z), minlength=len(docs))
        clean = np.minimum(clean, -1e-9)  # log P(label 0)
        # d(-log likelihood) / d(-clean): 1 for label 0, -P0 / (1 - P0) for label 1
        pull = np.where(label == 0, 1.0, -np.exp(clean) / -np.expm1(clean))
        gz = pull[doc_of] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(feature, gz[of_sentence], minlength=len(w)),
                               [pull.sum() / (1 + np.exp(-leak))]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        p[:-1], p[-1] = np.clip(p[:-1], -MOST, MOST), np.clip(p[-1], -9.0, -0.1)
    return ToxicityModel(dict(zip(place, p[:-1].tolist())), BIAS, float(1 / (1 + np.exp(-p[-1]))))


def score_column(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight_of = model.cache()
        for texts in batches:
            yield pd.Series([model.score(t, weight_of) for t in texts], dtype="float64")

    return score(text)


def score_documents(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null or empty text: the leak alone."""
    scored = df.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"),
                       score_column(model, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                        least: float = 0.5) -> DataFrame:
    """doc_id, start, end, score, sentence of every sentence that scores ``least`` or more."""
    @F.pandas_udf("array<struct<start:int,end:int,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "score"), s)) for s in model.sentences(t, least)] for t in texts])

    text = F.col(f"`{text_col}`")
    return (df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.explode(spans(text)).alias("s"))
            .select("doc_id", "s.start", "s.end", "s.score",
                    F.expr("substring(text, s.start + 1, s.end - s.start)").alias("sentence")))
