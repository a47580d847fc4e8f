"""Substring dedup by seed and extend: winnowed anchors, extended both ways, and merged to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.runtime import Texts, binary_array, drop_tables, map_batches, ragged, release, slices, table
from tributary.llm.splitting import blank_words, gram_hashes, mix, word_hashes

WINDOW, ANCHOR = 13, 5
#: Bytes of text in a step: hashing takes some sixty times as many for a moment.
SLICE = 1 << 20
#: Bits that hold a seed's number of windows, below its place.
COUNT_BITS = 8
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Words:
    """The words of a slice with what seeding and extending need."""

    def __init__(self, t: Texts, hashed: bool = True):
        self.begin, self.end, self.counts = blank_words(t)
        self.hash = word_hashes(t.data, self.begin, self.end) if hashed else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.counts) - self.counts
        self._sums: list[tuple[np.ndarray, np.ndarray]] = []

    def seeds(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winnowing: a window's anchor is the least hash of its grams of `anchor` words, the first among equals.

        Consecutive windows with the same anchor are one seed: the anchor's hash, the word where the first window begins, and
        the number of windows."""
        n = len(self.hash)
        last = np.repeat(self.first + self.counts, self.counts)
        windows = np.flatnonzero(np.arange(n) + window <= last)
        if not len(windows):
            return np.zeros(0, np.uint64), windows, windows
        grams = gram_hashes(self.hash, anchor)
        low, at = grams[: n - window + 1].copy(), np.arange(n - window + 1)
        for i in range(1, window - anchor + 1):
            other = grams[i : i + n - window + 1]
            less = other < low
            low[less] = other[less]
            at[less] = np.flatnonzero(less) + i
        own = at[windows]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        return grams[own[start]], windows[start], np.diff(np.append(start, len(own)))

    def owners(self, places: np.ndarray) -> np.ndarray:
        """The document of each word."""
        return np.searchsorted(self.first + self.counts, places, side="right")

    def span_hashes(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each span of words: that different ones agree in all is as good as impossible even among 10^13.

        They are polynomials modulo 2^64: the difference of two running sums, brought to the power 0 by an inverse base."""
        if not self._sums:
            for base in BASES:
                up, down = _powers(base, len(self.hash)), _powers(pow(base, -1, 1 << 64), len(self.hash))
                self._sums.append((np.append(np.uint64(0), np.cumsum(mix(self.hash ^ np.uint64(base)) * up, dtype=np.uint64)), down))
        a, b = ((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64) for sums, down in self._sums)
        return mix(a), mix(b) >> np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _low(c: Column) -> Column:
    """The lower 32 bits of a long."""
    return F.shiftright(F.shiftleft(c, 32), 32).cast("int")


def _identity(docs: DataFrame, text: str, key: str) -> list[Column]:
    """k, the key; d, which tells the rows of one key apart: 32 bits of the text's hash; and t, the text (null: empty)."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return [docs[key].cast("long").alias("k"), _low(F.xxhash64(t)).alias("d"), t.alias("t")]


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, d, spans): for each row with repeats the word ranges [from, to) covered by windows that a smaller key has too.

    k is the key; d, 32 bits of a hash of the text, tells the rows of one key apart.

    Seed: equal windows have equal anchors. Anchors that several keys have are found by a pre-aggregated count. Extend: a seed
    goes both ways from its anchor over all windows that have it; this context meets equal ones by a 96-bit hash of its words.
    Where a smaller key has the same context, all its windows are repeats. There remains each context's smallest key: where
    an anchor has several contexts, these keys' windows meet one by one, again by 96 bits, as a match may end inside
    a context. Keep: ranges that overlap or touch make one maximal repeat.

    Nothing is taken pair by pair: a passage in a third of all documents costs a row for each. Minima are pre-aggregated before
    their shuffle, and joins back to them are split where a key is hot (AQE). Null keys take no part, null texts have no
    words. Windows that only the rows of one key share are no repeats; equal rows have equal spans. An empty table has none.
    """
    if window - anchor + 1 >= 1 << COUNT_BITS:
        raise ValueError("a window has too many anchors")
    source = docs.select(*_identity(docs, text, key)).where("k is not null")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                w = Words(Texts(part.column(2)))
                grams, place, _ = w.seeds(window, anchor)
                own = w.owners(place)
                # a row gives an anchor once
                order = np.lexsort((grams, own))
                own, grams = own[order], grams[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[own[new]]), pa.array(grams[new].view(np.int64))], ["k", "a"])

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                w = Words(Texts(part.column(2)))
                grams, place, n = w.seeds(window, anchor)
                own = w.owners(place)
                c, e = w.span_hashes(place, n + window - 1)
                # e and d, place and number share a column, as a shuffled row takes 8 bytes for each
                ed = (e << np.uint64(32)) | part.column(1).to_numpy().view(np.uint32)[own]
                at = ((place - w.first[own]) << COUNT_BITS) | n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams.view(np.int64), c.view(np.int64), ed.view(np.int64), part.column(0).to_numpy()[own], at)], ["a", "c", "ed", "k", "at"])

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                w = Words(Texts(part.column(2)))
                lists = part.column(3)
                size = np.asarray(lists.value_lengths())
                at = lists.flatten().to_numpy()
                n = at & ((1 << COUNT_BITS) - 1)
                own = np.repeat(np.repeat(np.arange(len(size)), size), n)
                place = ragged(at >> COUNT_BITS, n)
                a, b = w.span_hashes(place + w.first[own], np.full(len(place), window))
                bd = (b << np.uint64(32)) | part.column(1).to_numpy().view(np.uint32)[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), bd.view(np.int64), part.column(0).to_numpy()[own], place.astype(np.int32))], ["a", "bd", "k", "place"])

    halves = lambda df, both, high: df.withColumn(high, F.shiftright(both, 32).cast("int")).withColumn("d", _low(F.col(both)))
    shared = table(map_batches(source, seeded, "k long, a long").groupBy("a").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("a"))
    release(source.sparkSession)
    found = table(map_batches(source, extended, "a long, c long, ed long, k long, at long").join(shared, "a"))
    drop_tables(shared)
    seeds = halves(found, "ed", "e")
    contexts = table(seeds.groupBy("a", "c", "e").agg(F.min("k").alias("low"), F.max("k").alias("high")))
    several = contexts.groupBy("a").agg(F.min("low").alias("first"), F.max("low").alias("last")).where("first < last").select("a", F.lit(True).alias("several"))
    judged = contexts.join(several, "a", "left").where("several or low < high").select("a", "c", "e", "low", F.coalesce("several", F.lit(False)).alias("several"))
    met = table(seeds.join(judged, ["a", "c", "e"]).where("k > low or several").select("k", "d", "at", (F.col("k") > F.col("low")).alias("whole")))
    drop_tables(found, contexts)
    open_ = met.where("not whole").groupBy("k", "d").agg(F.collect_set("at").alias("ats"))
    windows = table(map_batches(source.join(open_, ["k", "d"]), windowed, "a long, bd long, k long, place int"))
    release(source.sparkSession)
    parts = halves(windows, "bd", "b")
    smallest = parts.groupBy("a", "b").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("a", "b", "low")
    single = parts.join(smallest, ["a", "b"]).where("k > low").select("k", "d", F.struct(F.col("place").alias("from"), (F.col("place") + window).alias("to")).alias("span"))
    place = F.shiftright("at", COUNT_BITS).cast("int")
    whole = met.where("whole").select("k", "d", F.struct(place.alias("from"), (place + F.col("at").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) + (window - 1)).cast("int").alias("to")).alias("span"))
    covered = single.unionByName(whole).groupBy("k", "d").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    spans = table(map_batches(covered.select("k", "d", "spans.from", "spans.to"), _merged, "k long, d int, spans array<struct<from:int,to:int>>"))
    drop_tables(met, windows)
    return spans


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's ranges (in order of where they begin), those that overlap or touch made one."""
    for batch in batches:
        size = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        begin, end = (batch.column(i).flatten().to_numpy().astype(np.int64) + (row << 32) for i in (2, 3))
        reach = np.maximum.accumulate(end) if len(end) else end
        first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1])) if len(end) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(end)) - 1
        low = (1 << 32) - 1
        ranges = pa.StructArray.from_arrays([pa.array((begin[first] & low).astype(np.int32)), pa.array((reach[last] & low).astype(np.int32))], ["from", "to"])
        at = np.searchsorted(row[first], np.arange(len(size) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), ranges)], ["k", "d", "spans"])


def _kept_words(w: Words, begins: pa.Array, ends: pa.Array) -> np.ndarray:
    """Which words of a slice lie in none of their document's ranges (null: no ranges)."""
    size = np.asarray(begins.value_lengths().fill_null(0)).astype(np.int64)
    step = np.zeros(len(w.begin) + 1, np.int64)
    shift = np.repeat(w.first, size)
    np.add.at(step, begins.flatten().to_numpy() + shift, 1)
    np.add.at(step, ends.flatten().to_numpy() + shift, -1)
    return np.cumsum(step)[:-1] == 0


def remove(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): each row's words outside the spans that repeats gave it, joined by one blank."""
    joined = docs.select(*_identity(docs, text, key)).join(spans.select("k", "d", "spans.from", "spans.to"), ["k", "d"], "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                t = Texts(part.column(2))
                w = Words(t, hashed=False)
                keep = _kept_words(w, part.column(3), part.column(4))
                upto = np.append(0, np.cumsum(keep))
                n_kept = upto[w.first + w.counts] - upto[w.first]
                # each kept word with the byte before it, which becomes the blank, but for a document's first
                size = w.end[keep] - w.begin[keep]
                lead = np.ones(len(size), np.int64)
                lead[np.unique(upto[w.first][n_kept > 0])] = 0
                ends = np.cumsum(size + lead)
                data = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
                data[ragged(ends - size, size)] = t.data[ragged(w.begin[keep], size)]
                offsets = np.append(0, ends)[np.append(0, np.cumsum(n_kept))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts), pa.array(w.counts - n_kept), binary_array(data, offsets).cast(pa.string())], ["k", "n_words", "n_removed", "kept"])

    return map_batches(joined, kept, "k long, n_words long, n_removed long, kept string").withColumnRenamed("k", key)


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs; a row without doc_id keeps all its words."""
    return remove(docs, repeats(docs, window, anchor))


def cut(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all rows and columns, without the repeated passages in text; what is kept keeps its white space, and n_chars follows.

    A text without repeats stays as it is (null too); one that is a repeat as a whole becomes empty, or the white space before
    its first word. Columns may have any names: they are numbered on the way.
    """
    spans = repeats(docs, window, anchor, text, key).select("k", "d", "spans.from", "spans.to")
    numbered = docs.select(*_identity(docs, text, key)[:2], *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    joined = numbered.join(spans, ["k", "d"], "left").drop("k", "d").withColumn("cut", F.col("from").isNotNull())
    own = f"c{docs.columns.index(text)}"
    at = joined.columns.index(own)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own, SLICE):
                some = np.flatnonzero(np.asarray(part.column(len(part.columns) - 1)))
                if len(some):
                    chosen = part.take(pa.array(some))
                    t = Texts(chosen.column(at))
                    w = Words(t, hashed=False)
                    keep = _kept_words(w, chosen.column(chosen.schema.get_field_index("from")), chosen.column(chosen.schema.get_field_index("to")))
                    # a word goes with the white space behind it, up to its document's next word
                    until = np.append(w.begin[1:], len(t.data))
                    until[np.cumsum(w.counts)[w.counts > 0] - 1] = t.offsets[1:][w.counts > 0]
                    stays = np.ones(len(t.data), bool)
                    stays[ragged(w.begin[~keep], (until - w.begin)[~keep])] = False
                    upto = np.append(0, np.cumsum(stays))
                    new = binary_array(t.data[stays], upto[t.offsets]).cast(pa.string())
                    place = np.full(part.num_rows, -1)
                    place[some] = np.arange(len(some))
                    whole = pa.concat_arrays([part.column(at).cast(pa.string()), new])
                    column = whole.take(pa.array(np.where(place < 0, np.arange(part.num_rows), part.num_rows + place)))
                    part = part.set_column(at, own, column)
                yield part

    out = map_batches(joined, kept, joined.schema)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        back[i] = F.when(F.col("cut"), F.length(own).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"c{i}")).alias("n_chars")
    return out.select(*back)


__all__ = ["Words", "cut", "dedup", "remove", "repeats"]
