"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.charlm import Model, count_grams, distinct_words, fit, letter_words, word_scores
from tributary.llm.runtime import Texts, local, map_batches, slices, table

#: A text is rejected if its cross-entropy is above this quantile of its label's texts, times the slack. Cross-entropies are
#: counted in steps of 1/STEPS.
QUANTILE, SLACK, STEPS = 0.999, 1.5, 1000
#: Letters from which a text's cross-entropy says enough to reject it, and letters that count in its confidence.
LEAST_LETTERS, CONFIDENCE_LETTERS = 24, 40


def score(docs: DataFrame, model: Model, limit: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, cross_entropy, rejected) of each whole text; limit has a cross-entropy for each label.

    lang_pred has the lowest cross-entropy a character; among equals the first label. Null texts, texts without letters and
    an empty model give `und`, score 0 and cross_entropy null, and all but an empty model's are rejected. score is the share of the best model's likelihood
    of the text's mean CONFIDENCE_LETTERS characters (or fewer). Repeated keys stay apart. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                names, conf, low, rejected = judge(sent.value, limit, Texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(conf), pa.array(low, from_pandas=True), pa.array(rejected)], ["k", "lang_pred", "score", "cross_entropy", "rejected"])

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return map_batches(source, scored, "k long, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("k", key)


def judge(own: Model, limit: np.ndarray, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label, confidence, cross-entropy and rejection of each text."""
    letters, begin, counts = letter_words(t)
    n = len(counts)
    best, conf, low, size = np.full(n, len(own.labels)), np.zeros(n), np.full(n, np.nan), np.zeros(n)
    some = np.flatnonzero(counts)
    if len(some) and own.labels:
        d_letters, d_begin, place = distinct_words(letters, begin)
        each = word_scores(own, d_letters, d_begin)
        starts = (np.cumsum(counts) - counts)[some]
        total = np.add.reduceat(each[place].astype(float), starts, axis=0)
        size[some] = np.add.reduceat(np.diff(begin) + 1, starts)
        h = -total / size[some][:, None]
        b = np.argmin(h, axis=1)
        best[some], low[some] = b, h[np.arange(len(b)), b]
        gap = (h - h.min(axis=1)[:, None]) * np.minimum(size[some], CONFIDENCE_LETTERS)[:, None]
        conf[some] = 1 / np.exp(-gap).sum(axis=1)
    rejected = (best == len(own.labels)) | ((size >= LEAST_LETTERS) & (np.nan_to_num(low) > np.append(limit, np.inf)[best]))
    if not own.labels:
        rejected[:] = False
    return np.array([*own.labels, "und"], object)[best], conf, low, rejected


def keep(docs: DataFrame, model: Model, limit: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rejected = judge(sent.value, limit, Texts(part.column(part.schema.get_field_index(text))))[3]
                yield part.filter(pa.array(~rejected))

    return map_batches(docs, kept, docs.schema)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[Model, np.ndarray]:
    """Models of all labels, counted over all labelled texts, and for each label the cross-entropy above which a text is rejected.

    A label's limit is a quantile of all its texts with letters. They are counted by rounded cross-entropy in each task, so the
    driver gets a row for each label and step, however many texts there are.
    """
    own = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    model = fit(table(count_grams(own, lang, text)))
    limit = np.full(len(model.labels), np.inf)
    sent = own.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        none = np.full(len(sent.value.labels), np.inf)
        for batch in batches:
            for part in slices(batch, "t"):
                low = judge(sent.value, none, Texts(part.column(1)))[2]
                some = ~np.isnan(low)
                held.update(zip(np.array(part.column(0).to_pylist(), object)[some].tolist(), np.ceil(low[some] * STEPS).astype(np.int64).tolist()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.int64()), pa.array(list(held.values()), pa.int64())], ["l", "step", "n"])

    source = own.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
    steps = local(map_batches(source, counted, "l string, step long, n long").groupBy("l", "step").agg(F.sum("n").alias("n")))
    for i, x in enumerate(model.labels):
        own_steps = steps[steps.l == x].sort_values("step")
        if len(own_steps):
            n = own_steps.n.to_numpy(np.int64).cumsum()
            limit[i] = own_steps.step.to_numpy(np.int64)[np.searchsorted(n, QUANTILE * n[-1])] / STEPS * SLACK
    return model, limit


def fold(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo folds."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected): models learn from the documents not held out."""
    model, limit = train(docs.where(fold("doc_id", folds) != held))
    out = score(docs, model, limit)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
