"""Language identification by multilingual mixture inference.

A character trigram model for each learned language gives every word a likelihood under every
language. A document is a mixture of languages; expectation-maximisation estimates its
proportions from the likelihoods of all its words. The set of languages is selected by
penalised likelihood: nested sets, in order of their proportions, are refitted, and another
language must raise the log-likelihood by ``PENALTY`` times half the logarithm of the number
of words. The prediction is the language with the largest share of the selected mixture.

The models are fitted on a bounded sample of labelled rows, about ``max_train_docs``, chosen by
hash so that every label fills an equal part of it as far as it has rows (a documented bound);
the nested sets grow as long as the next language has a share of ``LEAST_SHARE``. Predictions
read every whole text.

Defined results: null text and text without a letter are ``und`` with score 0, and so is
everything if nothing was learned; repeated rows are predicted alike; an empty table gives an
empty result; all columns of the input are kept, and the names of new ones are parameters, so
that extra columns need not clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRAIN_DOCS, PENALTY, LEAST_SHARE, UNKNOWN = 8_000, 4.0, 0.02, "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 400_000
_BACK_OFF = 5.0


def _words(text: str | None) -> Counter:
    """Words with a letter and how often each occurs."""
    found = Counter(_WORD.findall(text.lower())) if text else Counter()
    if found and not any(w.isalpha() for w in found):
        found = Counter({w: n for w, n in found.items() if any(map(str.isalpha, w))})
    return found


def _count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            own = counts.setdefault(lang, Counter())
            for word, n in _words(text).items():
                w = f"^{word}$"
                for i in range(1, len(w)):
                    own[w[max(0, i - 2) : i + 1]] += n
    rows = [(lang, gram, n) for lang, own in counts.items() for gram, n in own.items()]
    yield pd.DataFrame(rows, columns=["lang", "gram", "n"])


def fit(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Trigram counts by language from rows with text and lang; the sample, hence the model, is bounded."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), "lang", "text")
    per_label = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(per_label.values()) > max_train_docs:
        # Each label fills an equal part of the bound; what small ones leave goes to the others.
        left, room, share = dict(sorted(per_label.items(), key=lambda x: x[1])), max_train_docs, {}
        for k, (label, n) in enumerate(left.items()):
            part = min(n, room // (len(left) - k))
            share[label], room = part / n, room - part
        table = rows.sparkSession.createDataFrame([(x, int(1_000_000 * p)) for x, p in share.items()], "lang string, _most int")
        rows = rows.join(F.broadcast(table), "lang").where(F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1_000_000)) < F.col("_most")).drop("_most")
    counts = rows.select("lang", "text").mapInPandas(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts})
    at = {x: k for k, x in enumerate(languages)}
    grams: dict[str, np.ndarray] = {}
    for r in counts:
        grams.setdefault(r["gram"], np.zeros(len(languages)))[at[r["lang"]]] += r["n"]
    return {"languages": languages, "grams": grams}


class Mixture:
    """Likelihoods and mixtures under a fitted model; one for each Python worker."""

    def __init__(self, model: dict):
        self.languages, grams = model["languages"], model["grams"]
        n = len(self.languages)
        zero = np.zeros(n)
        self.three, self.two, self.one = {}, {}, {}
        self.after_two, self.after_one, self.total = {}, {}, np.zeros(n)
        for g, c in grams.items():  # a gram of two starts a word: its context is the mark ^
            ctx, last = g[:-1], g[-1]
            self.three[g] = c
            self.after_two[ctx] = self.after_two.get(ctx, zero) + c
            pair = g[-2:]
            self.two[pair] = self.two.get(pair, zero) + c
            self.after_one[pair[0]] = self.after_one.get(pair[0], zero) + c
            self.one[last] = self.one.get(last, zero) + c
            self.total = self.total + c
        self.kinds = len(self.one) + 1
        self.gram_row: dict[str, int] = {}
        self.gram_ll = np.zeros((0, n), "f4")
        self.word_row: dict[str, int] = {}
        self.word_ll = np.zeros((0, n), "f4")

    def _gram(self, g: str) -> np.ndarray:
        zero = np.zeros(len(self.languages))
        p1 = (self.one.get(g[-1], zero) + 0.5) / (self.total + 0.5 * self.kinds)
        p2 = (self.two.get(g[-2:], zero) + _BACK_OFF * p1) / (self.after_one.get(g[-2], zero) + _BACK_OFF)
        p3 = (self.three.get(g, zero) + _BACK_OFF * p2) / (self.after_two.get(g[:-1], zero) + _BACK_OFF)
        return np.log(p3)

    def _learn_words(self, fresh: list[str]) -> None:
        spelled = [f"^{w}$" for w in fresh]
        grams = [w[max(0, i - 2) : i + 1] for w in spelled for i in range(1, len(w))]
        unseen = list(set(grams).difference(self.gram_row))
        if unseen:
            for g in unseen:
                self.gram_row[g] = len(self.gram_row)
            self.gram_ll = np.vstack([self.gram_ll, np.array([self._gram(g) for g in unseen], "f4")])
        rows = np.fromiter(map(self.gram_row.__getitem__, grams), np.int64, len(grams))
        starts = np.concatenate([[0], np.cumsum([len(w) - 1 for w in spelled])[:-1]])
        ll = np.add.reduceat(self.gram_ll[rows], starts, axis=0)
        base = len(self.word_row)
        self.word_row.update((w, base + k) for k, w in enumerate(fresh))
        self.word_ll = np.vstack([self.word_ll, ll])

    def infer(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
        """Prediction, score and selected mixture of each text."""
        bags = [_words(t) if self.languages else Counter() for t in texts]
        full = [k for k, b in enumerate(bags) if b]
        labels, scores, mixtures = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if not full:
            return labels, scores, mixtures
        if len(self.word_row) > _CACHE_WORDS:
            self.word_row, self.word_ll = {}, self.word_ll[:0]
        if len(self.gram_row) > _CACHE_WORDS:
            self.gram_row, self.gram_ll = {}, self.gram_ll[:0]
        fresh = list(set().union(*(bags[k] for k in full)).difference(self.word_row))
        if fresh:
            self._learn_words(fresh)
        lens = np.array([len(bags[k]) for k in full])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        rows = np.fromiter((self.word_row[w] for k in full for w in bags[k]), np.int64, int(lens.sum()))
        times = np.fromiter((n for k in full for n in bags[k].values()), "f4", int(lens.sum()))[:, None]
        ll = self.word_ll[rows]
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - top)
        n = np.add.reduceat(times[:, 0], starts).astype("f8")
        shift = np.add.reduceat((times * top)[:, 0].astype("f8"), starts)
        share = np.full((len(full), len(self.languages)), 1 / len(self.languages), "f4")
        share = self._em(like, times, starts, lens, n, share, 12)
        single = np.add.reduceat((times * ll).astype("f8"), starts, axis=0)
        best = single.argmax(axis=1)
        chosen = np.zeros_like(share)
        chosen[np.arange(len(full)), best] = 1
        value = single[np.arange(len(full)), best]
        order = np.argsort(-share, axis=1, kind="stable")
        for size in range(2, len(self.languages) + 1):
            open_ = np.flatnonzero(np.take_along_axis(share, order[:, size - 1 : size], 1)[:, 0] > LEAST_SHARE)
            if not len(open_):
                break
            mask = np.zeros_like(share[open_])
            np.put_along_axis(mask, order[open_, :size], 1, 1)
            picked = np.concatenate([np.arange(starts[d], starts[d] + lens[d]) for d in open_])
            own_lens = lens[open_]
            own_starts = np.concatenate([[0], np.cumsum(own_lens)[:-1]])
            start = share[open_] * mask + 1e-3 * mask
            fitted = self._em(like[picked], times[picked], own_starts, own_lens, n[open_], start / start.sum(1, keepdims=True), 8)
            mixed = (like[picked] * np.repeat(fitted, own_lens, axis=0)).sum(axis=1, keepdims=True)
            got = np.add.reduceat((times[picked] * np.log(np.maximum(mixed, 1e-30)))[:, 0].astype("f8"), own_starts) + shift[open_]
            got -= (size - 1) * PENALTY * 0.5 * np.log(np.maximum(n[open_], 2))
            better = got > value[open_]
            chosen[open_[better]], value[open_[better]] = fitted[better], got[better]
        for d, k in enumerate(full):
            first = int(chosen[d].argmax())
            labels[k], scores[k] = self.languages[first], min(1.0, float(chosen[d, first]))
            mixtures[k] = [(self.languages[j], float(chosen[d, j])) for j in np.argsort(-chosen[d], kind="stable") if chosen[d, j] > 0]
        return labels, scores, mixtures

    @staticmethod
    def _em(like, times, starts, lens, n, share, rounds):
        for _ in range(rounds):
            part = like * np.repeat(share, lens, axis=0)
            part *= times / np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            share = (np.add.reduceat(part, starts, axis=0) / n[:, None]).astype("f4")
        return share


def annotate(documents: DataFrame, model: dict, keep: list[str] | None = None, label: str = "lang_pred", score: str = "score", mixture: str | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the prediction, its score and, if named, the selected mixture."""
    spark = documents.sparkSession
    keep = documents.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    mix_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    added = [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())] + ([T.StructField(mixture, mix_type)] if mixture else [])
    fields = [documents.schema[c] for c in keep]
    frame = documents.select(F.col("text").alias("_text_"), *[F.col(f"`{c}`") for c in keep])
    names = [*keep, label, score] + ([mixture] if mixture else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Mixture(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                labels, scores, mixtures = fitted.infer(part.column(0).to_pylist())
                columns = [*part.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                if mixture:
                    columns.append(pa.array([[{"lang": a, "share": b} for a, b in m] for m in mixtures], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(run, T.StructType([*fields, *added]))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_table(documents: DataFrame) -> DataFrame:
    """The prediction for every document by models that never saw the held-out ones."""
    model = fit(documents.where(~held_out() & F.col("doc_id").isNotNull()))
    out = annotate(documents, model, keep=["doc_id"], mixture="mixture")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_langs"))
