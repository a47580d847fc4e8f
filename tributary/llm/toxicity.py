"""Toxicity scores of texts whose disguised words are restored first.

A disguised word (leetspeak, spacing, separators, repeated letters) is a lattice of what each character may stand for. Viterbi's
algorithm takes the path that a character language model of the corpus and the channel's costs make likeliest. The score
comes from the restored words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.charlm import BEGIN, END, FAR, Model, count_grams, distinct_words, fit, letter_words
from tributary.llm.langid import fold
from tributary.llm.runtime import Texts, binary_array, local, map_batches, ragged, slices, table
from tributary.llm.splitting import blank_words, mix, word_hashes

# What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'’·"
#: The channel's log-probabilities: a letter for a sign, a separator inside a word, a sign that is none, a run of letters cut to
#: one or two, a double letter cut to one, and a blank inside a spaced word.
SIGN, SEPARATED, NONE, CUT, HALVED, BLANK = -1.0, -0.7, -3.0, -0.5, -3.0, -0.2
#: Labelled documents at most that the classifier is fitted on, by label.
POSITIVE_DOCS, NEGATIVE_DOCS = 8_000, 16_000
#: A feature counts if so many positive documents have it.
LEAST_DOCS = 3
PREFIXES = (3, 4, 5, 6)
#: Parts of the labelled documents, each judged by the evidence of the others when the curve is fitted.
PARTS = 4
THRESHOLD = 0.7

_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_MARKS = "".join(map(re.escape, LEET))
#: What gives a token's lattice a choice: a sign, a separator between letters, a double letter.
_TOKEN = re.compile(rf"[{_MARKS}]|[^\W\d_][{re.escape(SEPARATORS)}]+[^\W\d_]|([^\W\d_])\1", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_OTHER_SIGNS = frozenset(c for c in LEET if not c.isdigit())


def disguised(token: str) -> bool:
    """Whether a token can stand for other words than its letters. Digits alone are a number."""
    return bool(_TOKEN.search(token)) and (any(c.isalpha() for c in token) or sum(c in LEET for c in token) > 1 and not _OTHER_SIGNS.isdisjoint(token))


class Restorer:
    """Viterbi decoding of one disguised token or spaced group."""

    def __init__(self, model: Model):
        self.model = model
        self._p: dict[int, float] = {}
        self._done: dict[str, list[str]] = {}

    def _letters(self, code: list[int]) -> list[float]:
        missing = [c for c in code if c not in self._p]
        if missing:
            if len(self._p) > 400_000:
                self._p.clear()
                missing = code
            for c, v in zip(missing, self.model.score(np.array(missing, np.uint64))[:, 0].tolist()):
                self._p[c] = v
        return [self._p[c] for c in code]

    def words(self, token: str) -> list[str]:
        """The words that a token stands for, in lower case."""
        got = self._done.get(token)
        if got is None:
            if len(self._done) > 100_000:
                self._done.clear()
            got = self._done[token] = self._decode(_lattice(token))
        return got

    def others(self, token: str) -> list[str]:
        """The words that a token stands for, if they aren't those of its letters."""
        said = self.words(token) if disguised(token) else []
        return said if said != _WORD.findall(token.lower()) else []

    def _decode(self, steps: list[list[tuple[str, float]]]) -> list[str]:
        """Each step has ways of (letters, cost); a blank among the letters ends a word."""
        start = (BEGIN << 32) | (BEGIN << 16) | BEGIN
        best: dict[int, tuple[float, str]] = {start: (0.0, "")}
        for ways in [*steps, [(" ", 0.0)]]:
            grown: list[tuple[int, float, str]] = []
            for letters, cost in ways:
                paths = [(c, v + cost, said) for c, (v, said) in best.items()]
                for x in letters:
                    if x == " ":
                        open_ = [p for p in paths if p[0] != start]
                        ps = self._letters([(c << 16) | END for c, _, _ in open_])
                        paths = [p for p in paths if p[0] == start] + [(start, v + p, said + " ") for (c, v, said), p in zip(open_, ps)]
                    else:
                        o = min(ord(x), FAR)
                        ps = self._letters([(c << 16) | o for c, _, _ in paths])
                        paths = [(((c << 16) | o) & 0xFFFFFFFFFFFF, v + p, said + x) for (c, v, said), p in zip(paths, ps)]
                grown += paths
            best = {}
            for c, v, said in grown:
                if c not in best or (v, said) > best[c]:
                    best[c] = (v, said)
        return best[start][1].split() if start in best else []


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    low = token.lower()
    spaced = bool(_SPACED.fullmatch(token))
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(low):
        c = low[i]
        run = 1
        while i + run < len(low) and low[i + run] == c:
            run += 1
        inside = 0 < i and i + run < len(low)
        if c in LEET:
            ways = [(x, SIGN * min(run, 2)) for x in LEET[c]]
            if run > 1:
                ways += [(x * 2, SIGN * 2) for x in LEET[c]]
            steps.append([*ways, (" ", NONE)])
        elif c.isspace():
            steps.append([("", BLANK), (" ", 0.0)] if spaced else [(" ", 0.0)])
        elif not c.isalpha():
            steps.append([("", SEPARATED), (" ", NONE)] if c in SEPARATORS and inside else [(" ", 0.0)])
        elif run > 2:
            steps.append([(c, CUT), (c * 2, CUT), (c * run, 0.0)])
        elif run == 2:
            steps.append([(c * 2, 0.0), (c, HALVED)])
        else:
            steps.append([(c, 0.0)])
        i += run
    return steps


def suspects(text: str) -> list[tuple[int, int]]:
    """Where a text has tokens that may be disguised: spaced groups first, then tokens with signs, separators or double letters."""
    found = [m.span() for m in _SPACED.finditer(text) if any(c.isalpha() for c in m[0])]
    held = found[:]
    for m in re.finditer(r"\S+", text):
        if disguised(m[0]) and not any(a < m.end() and m.start() < b for a, b in held):
            found.append(m.span())
    return sorted(found)


def _candidates(t: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens and spaced groups that may be disguised, and the place among them and the document of each occurrence."""
    begin, end, counts = blank_words(t)
    if not len(begin):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(t.n), counts)
    low = t.data | np.uint8(32)
    odd = t.data >= 128
    odd |= np.isin(t.data, [ord(c) for c in "".join(LEET) + SEPARATORS if ord(c) < 128])
    odd[1:] |= (low[1:] == low[:-1]) & (low[1:] >= 97) & (low[1:] <= 122)
    upto = np.append(0, np.cumsum(odd))
    own = np.flatnonzero((upto[end] > upto[begin]) & (end - begin > 1))
    size = (end - begin)[own]
    words = binary_array(t.data[ragged(begin[own], size)], np.append(0, np.cumsum(size))).dictionary_encode()
    tokens = [x.decode() for x in words.dictionary.to_pylist()]
    lead = t.data[begin]
    single = end - begin == np.where(lead < 128, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    starts = single.copy()
    starts[1:] &= ~single[:-1] | (doc[1:] != doc[:-1])
    group, places, docs = np.cumsum(starts)[single], words.indices.to_numpy().tolist(), doc[own].tolist()
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    lone = np.flatnonzero(single)
    for i, n in zip(first.tolist(), np.diff(np.append(first, len(group))).tolist()):
        if n > 2:
            said = " ".join(t.data[begin[j] : end[j]].tobytes().decode() for j in lone[i : i + n].tolist())
            if any(c.isalpha() for c in said):
                places.append(len(tokens))
                docs.append(int(doc[lone[i]]))
                tokens.append(said)
    return tokens, np.array(places, np.int64), np.array(docs, np.int64)


def restored_words(t: Texts, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """letter_words of the texts and of what their suspects stand for; the third is each word's document, in no order."""
    letters, begin, counts = letter_words(t)
    owner = np.repeat(np.arange(t.n), counts)
    tokens, place, doc = _candidates(t)
    found = [restorer.words(x) if " " in x else [w for y in x.split() for w in restorer.others(y)] for x in tokens]
    more = [w for x in found for w in x]
    if more:
        extra = np.frombuffer("".join("".join(c if ord(c) < FAR else chr(FAR) for c in w) for w in more).encode("utf-16-le", "surrogatepass"), np.uint16)
        size = np.array([len(w) for w in more])
        many = np.array([len(x) for x in found])
        word = ragged((np.cumsum(many) - many)[place], many[place])
        begin = np.append(begin, begin[-1] + np.cumsum(size[word]))
        letters = np.append(letters, extra[ragged((np.cumsum(size) - size)[word], size[word])])
        owner = np.append(owner, np.repeat(doc, many[place]))
    return letters, begin, owner


def restorer_of(model: Model) -> Restorer:
    """The model's restorer, which a worker keeps with the model from task to task."""
    if not hasattr(model, "restorer"):
        model.restorer = Restorer(model)
    return model.restorer


def word_features(letters: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and their beginnings, and the word that each belongs to."""
    n = len(begin) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(begin)
    hashes, owner = [word_hashes(letters.view(np.uint8), 2 * begin[:-1], 2 * begin[1:])], [np.arange(n)]
    for k in PREFIXES:
        own = np.flatnonzero(size > k)
        h = np.full(len(own), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + letters[begin[own] + j]
        hashes.append(mix(h))
        owner.append(own)
    return np.concatenate(hashes), np.concatenate(owner)


def restore(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, restored): whole texts with their suspects replaced by the words that they stand for; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value)
        for batch in batches:
            out = []
            for text_ in batch.column(1).to_pylist():
                said, at = "", 0
                for a, b in suspects(text_ or ""):
                    said += text_[at:a] + " ".join(own.words(text_[a:b]))
                    at = b
                out.append(None if text_ is None else said + text_[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "restored"])

    return map_batches(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), restored, "k long, restored string").withColumnRenamed("k", key)


def language_model(docs: DataFrame, text: str = "text") -> Model:
    """The character model of all documents' words, with every gram that they have."""
    return fit(table(count_grams(docs.select(F.lit("all").alias("label"), text), "label", text)))


class Classifier:
    """Evidence of features, and a logistic curve over a text's strongest evidence and how often it has some."""

    def __init__(self, keys: np.ndarray, evidence: np.ndarray, curve: np.ndarray):
        self.keys, self.evidence, self.curve = keys, evidence, curve

    def inputs(self, t: Texts, restorer: Restorer) -> np.ndarray:
        """For each text the strongest evidence of its words, and the logarithm of 1 + the sum of all evidence above 2."""
        return self.judge(restored_words(t, restorer), t.n)

    def judge(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        letters, begin, owner = words
        out = np.zeros((n, 2))
        if len(owner) and len(self.keys):
            d_letters, d_begin, place = distinct_words(letters, begin)
            hashes, of = word_features(d_letters, d_begin)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            each = np.zeros(len(d_begin) - 1)
            np.maximum.at(each, of[hit], self.evidence[at[hit]])
            own = each[place]
            some = own > 0
            np.maximum.at(out[:, 0], owner[some], own[some])
            out[:, 1] = np.log1p(np.bincount(owner, np.where(own > 2, own, 0), n))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most about so many rows, chosen by a hash of the key."""
    n = labels.count()
    return labels if n <= most else labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) < F.lit(int(most / n * (1 << 20))))


def _feature_counts(rows: DataFrame, model) -> DataFrame:
    """(f, t0, n0, t1, n1, ...): the toxic and the other documents of each part that have a feature."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(model.value)
        held: list = []
        for batch in batches:
            for part in slices(batch, "t"):
                t = Texts(part.column(2))
                letters, begin, owner = restored_words(t, restorer)
                if not len(owner):
                    continue
                d_letters, d_begin, place = distinct_words(letters, begin)
                hashes, of = word_features(d_letters, d_begin)
                keys, code = np.unique(hashes, return_inverse=True)
                # each document's distinct words, then its distinct features
                pair = np.unique(owner * np.int64(len(d_begin)) + place)
                doc, word = pair // len(d_begin), pair % len(d_begin)
                order = np.argsort(of, kind="stable")
                many = np.bincount(of, minlength=len(d_begin) - 1)
                first = np.cumsum(many) - many
                feature = code[order[ragged(first[word], many[word])]]
                both = np.unique(np.repeat(doc, many[word]) * np.int64(len(keys)) + feature)
                doc, feature = both // len(keys), both % len(keys)
                toxic, own = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
                for i in np.unique(own):
                    mine = own == i
                    n, t_ = np.bincount(feature[mine], minlength=len(keys)), np.bincount(feature[mine], toxic[mine], len(keys)).astype(np.int64)
                    seen = n > 0
                    held.append(pd.DataFrame({"f": keys.view(np.int64)[seen], "part": np.int32(i), "t": t_[seen], "n": (n - t_)[seen]}))
                if sum(map(len, held)) > 3_000_000:
                    held = [pd.concat(held).groupby(["f", "part"], as_index=False).sum()]
        if held:
            out = pd.concat(held).groupby(["f", "part"], as_index=False).sum()
            for a in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_pandas(out[a : a + 100_000], preserve_index=False)

    sums = [F.sum(F.when(F.col("part") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(PARTS) for c in "tn"]
    return map_batches(rows.select("toxic", "part", "t"), counted, "f long, part int, t long, n long").groupBy("f").agg(*sums)


def _evidence(t: np.ndarray, n: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """Evidence of features that t of so many toxic and n of so many other documents have; 0 for features that don't count."""
    counts = (t >= LEAST_DOCS) & (t * other > 4 * n * toxic)
    return np.where(counts, np.log((t + 0.5) / (toxic + 1)) - np.log((n + 1.5) / (other + 1)), 0.0)


def _inputs(rows: DataFrame, found, model) -> pd.DataFrame:
    """(toxic, a, b) of each row, by the classifier of its part."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(model.value)
        for batch in batches:
            for part in slices(batch, "t"):
                own, t = part.column(1).to_numpy(), Texts(part.column(2))
                words, x = restored_words(t, restorer), np.zeros((t.n, 2))
                for i in np.unique(own):
                    x[own == i] = found.value[i].judge(words, t.n)[own == i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    return local(map_batches(rows.select("toxic", "part", "t"), given, "toxic int, a double, b double"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty; the constant first. A step is halved until the loss falls, so that separable
    classes, where full steps overshoot, end at the minimum too."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-6, *[0.05] * (x.shape[1] - 1)])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), slope)
        size = 1.0
        while size > 1e-9 and not loss(w + size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        w = w + size * step
        now = loss(w)
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, model: Model, text: str = "text") -> Classifier:
    """A classifier from labelled rows (doc_id, toxic): POSITIVE_DOCS and NEGATIVE_DOCS at most, chosen by a hash of doc_id.

    All of them give the features' evidence and the curve: a row's place on the curve is learned from the evidence of the
    other parts, so that no row speaks for itself. Null labels take no part; several labels of a document count as toxic if
    one is; several rows of a doc_id have its label each. Without positive or negative rows every score is the share of
    positive ones (0.5 if none).
    """
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = _sample(own.where("toxic = 1"), POSITIVE_DOCS).unionByName(_sample(own.where("toxic = 0"), NEGATIVE_DOCS))
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int"))
    rows = table(rows)  # bounded by the sample
    size = np.zeros((2, PARTS), np.int64)
    for r in rows.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        size[int(r.toxic > 0), r.part] = r.n
    toxic, other = int(size[1].sum()), int(size[0].sum())
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 1)
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    sent = spark.sparkContext.broadcast(model)
    counts = _feature_counts(rows, sent).withColumn("t", sum((F.col(f"t{i}") for i in range(1, PARTS)), F.col("t0"))).withColumn("n", sum((F.col(f"n{i}") for i in range(1, PARTS)), F.col("n0")))
    speaks = lambda t, n, toxic, other: (t >= LEAST_DOCS) & (t * int(other) > 4 * n * int(toxic))
    used = speaks(F.col("t"), F.col("n"), toxic, other)
    for i in range(PARTS):
        used |= speaks(F.col("t") - F.col(f"t{i}"), F.col("n") - F.col(f"n{i}"), toxic - size[1, i], other - size[0, i])
    counts = local(counts.where(used).drop("t", "n"))
    keys = counts.f.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    t, n = (counts[[f"{c}{i}" for i in range(PARTS)]].to_numpy(np.int64)[order] for c in "tn")
    every, none = _evidence(t.sum(axis=1), n.sum(axis=1), toxic, other), np.zeros(3)
    others = [Classifier(keys, _evidence(t.sum(axis=1) - t[:, i], n.sum(axis=1) - n[:, i], toxic - int(size[1, i]), other - int(size[0, i])), none) for i in range(PARTS)]
    x = _inputs(rows, spark.sparkContext.broadcast(others), sent)
    return Classifier(keys[every > 0], every[every > 0], _logistic(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy(float)))


def score(docs: DataFrame, found: Classifier, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of each whole text; null counts as empty, whose score is that of a text without evidence. No shuffle."""
    spark = docs.sparkSession
    sent, lm = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        restorer = restorer_of(lm.value)
        for batch in batches:
            for part in slices(batch, "t"):
                s = own.score(own.inputs(Texts(part.column(1)), restorer))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["k", "score", "predicted"])

    return map_batches(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), scored, "k long, score double, predicted int").withColumnRenamed("k", key)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of held-out rows are never seen; the character model is of all texts."""
    model = language_model(docs)
    found = train(docs, labels.where(fold("doc_id", folds) != held), model)
    return score(docs, found, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, found: Classifier, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold. No shuffle."""
    spark = docs.sparkSession
    sent, lm = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, restorer = sent.value, restorer_of(lm.value)
        for batch in batches:
            for part in slices(batch, text):
                s = own.score(own.inputs(Texts(part.column(part.schema.get_field_index(text))), restorer))
                yield part.filter(pa.array(s < THRESHOLD))

    return map_batches(docs, kept, docs.schema)
