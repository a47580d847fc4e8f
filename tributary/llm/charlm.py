"""Interpolated Kneser-Ney character language models in sorted arrays of hashes.

Words are maximal runs of letters in lower case. A gram is the last four characters at a place of a word: three begin marks
stand before the first letter and an end mark after the last. Four 16-bit characters make one 64-bit number, which is its
hash without collisions; letters beyond U+FFFF count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.runtime import Texts, binary_array, kept, local, map_batches, ragged, slices
from tributary.llm.splitting import LETTER, class_of, code_points

ORDER = 4
BEGIN, END, FAR = 1, 2, 0xFFFF


def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                out[c] = ord(low)
    return np.where(out > 0xFFFF, FAR, out).astype(np.uint16)


def lower() -> np.ndarray:
    return kept("lower", _lower)


def letter_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all words one after the other, where each word begins (one entry more), and each document's number."""
    cps, _, first = code_points(t)
    n = len(cps)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(t.n, np.int64)
    letter = class_of(cps) == LETTER
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:n]
    b = np.flatnonzero(begin)
    index = np.cumsum(letter) - letter
    return lower()[cps[letter]], np.append(index[b], int(letter.sum())), np.diff(np.searchsorted(b, first))


def distinct_words(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and begins of the distinct words, and each word's place among them."""
    words = binary_array(letters.view(np.uint8), 2 * begin).dictionary_encode()
    t = Texts(words.dictionary)
    return t.data.view(np.uint16), t.offsets >> 1, words.indices.to_numpy()


def word_grams(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every letter and at the end of every word, and where each word's begin (one entry more)."""
    n = np.diff(begin)
    at = np.append(0, np.cumsum(n + 1))
    own = np.full(int(at[-1]), END, np.uint64)
    ends = np.zeros(len(own), bool)
    ends[at[1:] - 1] = True
    own[~ends] = letters
    place = np.arange(len(own)) - np.repeat(at[:-1], n + 1)
    code = own.copy()
    for back in range(1, ORDER):
        before = np.full(len(own), BEGIN, np.uint64)
        before[back:] = own[:-back]
        before[place < back] = BEGIN
        code |= before << np.uint64(16 * back)
    return code, at


def count_grams(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """(label, gram, n) over all docs: counted for each task first, so a frequent gram has a row a task at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang: str) -> None:
            code = np.concatenate([c for c, _ in held[lang]])
            n = np.concatenate([m for _, m in held[lang]])
            u, inv = np.unique(code, return_inverse=True)
            held[lang] = [(u, np.bincount(inv, n, len(u)).astype(np.int64))]

        for batch in batches:
            for part in slices(batch, "t"):
                letters, begin, counts = letter_words(Texts(part.column(1)))
                if not len(letters):
                    continue
                kinds = part.column(0).dictionary_encode()
                own = np.repeat(kinds.indices.to_numpy(), counts)
                d_letters, d_begin, place = distinct_words(letters, begin)
                code, at = word_grams(d_letters, d_begin)
                for i, lang in enumerate(kinds.dictionary.to_pylist()):
                    times = np.bincount(place[own == i], minlength=len(d_begin) - 1)
                    weight = np.repeat(times, np.diff(at))
                    held.setdefault(lang, []).append((code[weight > 0], weight[weight > 0]))
                    if sum(len(c) for c, _ in held[lang]) > 3_000_000:
                        fold(lang)
        for lang in held:
            fold(lang)
            (code, n), = held[lang]
            for a in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[a : a + 100_000]), pa.string()), pa.array(code[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["label", "gram", "n"])

    source = docs.select(F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("l is not null and t is not null")
    return map_batches(source, counted, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities (natural) of all labels: for each order sorted grams with a row of values for each label, and for
    each context length sorted contexts with the weight of the shorter context's model."""

    def __init__(self, labels: list[str], grams: list[tuple[np.ndarray, np.ndarray]], weights: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray):
        self.labels, self.grams, self.weights, self.floor = labels, grams, weights, floor

    def score(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last character for each label."""
        out = np.zeros((len(code), len(self.labels)), np.float32)
        todo = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            own = code[todo] & np.uint64((1 << (16 * k)) - 1)
            keys, values = self.grams[k - 1]
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            out[todo[hit]] += values[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            if k > 1:
                keys, values = self.weights[k - 1]
                own >>= np.uint64(16)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[at] == own
                    out[todo[hit]] += values[at[hit]]
        out[todo] += self.floor
        return out


def fit(counts: DataFrame) -> Model:
    """A model of each label in counts (label, gram, n).

    Highest order: counts less a discount over the context's count. Lower orders: the same with the number of different
    characters seen before. The discount of an order is n1/(n1+2*n2), with n1, n2 the grams counted once and twice.
    Every counted gram and context is stored, so the model grows with the different grams of the corpus.
    """
    table = counts.select("label", F.col("gram").alias("g"), "n")
    rows, contexts, sums = [], [], []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            mask = (1 << (16 * k)) - 1
            table = table.groupBy("label", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        whole = local(table.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")))
        if len(whole) > 256:
            raise ValueError("more than 256 labels")
        sums.append(whole.assign(k=k))
        rows.append(local(table.select("label", "g", "n")).assign(k=k))
        if k > 1:
            ctx = table.groupBy("label", F.shiftrightunsigned("g", 16).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
            contexts.append(local(ctx).assign(k=k))
    return _assemble(pd.concat(sums), pd.concat(rows), pd.concat(contexts))


def _assemble(sums: pd.DataFrame, rows: pd.DataFrame, contexts: pd.DataFrame) -> Model:
    labels = sorted(sums["label"].unique())
    grams: list = [None] * ORDER
    weights: list = [(np.zeros(0, np.uint64), np.zeros((0, len(labels)), np.float32))] * ORDER
    if not labels:
        empty = (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
        return Model([], [empty] * ORDER, [empty] * ORDER, np.zeros(0, np.float32))
    model = Model(labels, grams, weights, np.zeros(len(labels), np.float32))
    one = sums[sums.k == 1].set_index("label")
    size = np.array([one.types[x] + 1 for x in labels], float)  # the alphabet and one letter never seen
    for k in range(1, ORDER + 1):
        own = rows[rows.k == k]
        keys = np.unique(own.g.to_numpy(np.int64).view(np.uint64))
        c = np.zeros((len(keys), len(labels)))
        for j, x in enumerate(labels):
            r = own[own.label == x]
            c[np.searchsorted(keys, r.g.to_numpy(np.int64).view(np.uint64)), j] = r.n
        stat = sums[sums.k == k].set_index("label")
        discount = np.array([stat.n1[x] / (stat.n1[x] + 2 * stat.n2[x]) if stat.n1[x] else 0.1 for x in labels])
        discount = np.clip(discount, 0.05, 0.95)
        if k == 1:
            total = np.array([stat.total[x] for x in labels], float)
            back = discount * np.array([stat.types[x] for x in labels]) / total
            model.floor[:] = np.log(back / size)
            p = np.maximum(c - discount, 0) / total + back / size
        else:
            ctx = contexts[contexts.k == k]
            ckeys = np.unique(ctx.c.to_numpy(np.int64).view(np.uint64))
            n, types = np.zeros((len(ckeys), len(labels))), np.zeros((len(ckeys), len(labels)))
            for j, x in enumerate(labels):
                r = ctx[ctx.label == x]
                at = np.searchsorted(ckeys, r.c.to_numpy(np.int64).view(np.uint64))
                n[at, j], types[at, j] = r.n, r.types
            weight = np.where(n > 0, discount * types / np.maximum(n, 1), 1.0)
            weights[k - 1] = (ckeys, np.log(weight).astype(np.float32))
            at = np.searchsorted(ckeys, keys >> np.uint64(16))
            at = np.minimum(at, max(len(ckeys) - 1, 0))
            hit = ckeys[at] == keys >> np.uint64(16)
            lower_p = np.exp(_partial(model, keys, k - 1))
            w = np.where(hit[:, None], weight[at], 1.0)
            total = np.where(hit[:, None], n[at], 0)
            p = np.where(total > 0, np.maximum(c - discount, 0) / np.maximum(total, 1), 0) + w * lower_p
        grams[k - 1] = (keys, np.log(p).astype(np.float32))
    return model


def _partial(model: Model, code: np.ndarray, order: int) -> np.ndarray:
    """Scores by the orders up to order."""
    none = [(np.zeros(0, np.uint64), np.zeros((0, len(model.labels)), np.float32))] * (ORDER - order)
    cut = Model(model.labels, [*model.grams[:order], *none], [*model.weights[:order], *none], model.floor)
    return cut.score(code).astype(float)


def word_scores(model: Model, letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log-probability of every word (its letters and its end) for each label."""
    code, at = word_grams(letters, begin)
    if not len(begin) - 1:
        return np.zeros((0, len(model.labels)))
    return np.add.reduceat(model.score(code), at[:-1], axis=0)


__all__ = ["ORDER", "Model", "count_grams", "distinct_words", "fit", "letter_words", "ragged", "word_grams", "word_scores"]
