"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.runtime import Texts, drop_tables, kept, local, map_batches, ragged, release, slices, table
from tributary.llm.splitting import blank_words, gram_hashes, mix, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8, one in 5,000 pairs meets in no band; at 0.85, one in 150,000.
BANDS, ROWS = 16, 4
#: A word's idf is ln(documents / documents with it), at most ln(1 / RARE). So a table of those below that has at most the mean
#: number of different words in a document, divided by RARE, however many documents there are.
RARE = 1e-3
#: Members that one verifying task compares with a leader, and texts that take a leader's part in a task of the second pass.
MEMBERS, HEADS = 256, 64
LEAST_WEIGHT = 0.05


class Idf:
    """ln(documents / documents with the word) of frequent words, by sorted hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), np.log(1 / RARE), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            out[hit] = self.values[at[hit]]
        return np.maximum(out, LEAST_WEIGHT)


def shingles(t: Texts, idf: Idf, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct shingles in order of their hashes: hashes, weights, and where each document's begin.

    A weight is the shingle's count times the mean idf of its words. A document of fewer words is one shingle.
    """
    begin, end, counts = blank_words(t)
    words = word_hashes(t.data, begin, end)
    n = len(words)
    first = np.cumsum(counts) - counts
    rarity = idf.of(words)
    doc = np.repeat(np.arange(t.n), counts)
    whole = np.arange(n) + k <= np.repeat(first + counts, counts)
    at = np.flatnonzero(whole)
    grams = gram_hashes(words, k)[at] if n >= k else np.zeros(0, np.uint64)
    total = np.append(0, np.cumsum(rarity, dtype=np.float64))
    weight = (total[at + k] - total[at]) / k
    owner = doc[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.array([gram_hashes(words[first[d] : first[d] + counts[d]], int(counts[d]))[0] for d in short], np.uint64)
        w = np.array([rarity[first[d] : first[d] + counts[d]].mean() for d in short])
        owner, grams, weight = np.append(owner, short), np.append(grams, h), np.append(weight, w)
    order = np.lexsort((grams, owner))
    owner, grams, weight = owner[order], grams[order], weight[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    # rounded, so that the same shingle has the same weight wherever it stands
    return grams[at], np.round(weight[at] * times, 3).astype(np.float32), np.searchsorted(owner[at], np.arange(t.n + 1))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2,1) numbers, logarithms of others, and uniform ones, from hashes of 1, 2, ..."""
    u = (mix(np.arange(1, 5 * 4096 + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53 + 2**-54
    a, b, c, d, e = u.reshape(5, 4096)
    return (-np.log(a) - np.log(b)).astype(np.float32), np.log(-np.log(c) - np.log(d)).astype(np.float32), e.astype(np.float32)


def signatures(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """bands hashes of each document that has shingles, each of rows consistent weighted samples (Ioffe's method).

    A sample is the shingle with the least ln(c) - r*(floor(ln(w)/r + beta) - beta + 1), together with that floor, where r, c
    and beta come from the shingle's hash: the chance that two documents share it is their weighted Jaccard similarity.
    """
    r_table, c_table, beta_table = kept("icws", _tables)
    starts = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(starts), bands), np.uint64)
    if not len(starts):
        return out
    log_w = np.log(weights)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for band in range(bands):
        held = np.full(len(starts), np.uint64(band + 1))
        for row in range(rows):
            salt = int(mix(np.array([band * rows + row + 1], np.uint64))[0])
            x = (hashes ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            r = r_table[(x & np.uint64(4095)).astype(np.intp)]
            beta = beta_table[((x >> np.uint64(12)) & np.uint64(4095)).astype(np.intp)]
            t = np.floor(log_w / r + beta)
            a = c_table[((x >> np.uint64(24)) & np.uint64(4095)).astype(np.intp)] - r * (t - beta + np.float32(1))
            bits = a.view(np.uint32)
            ordered = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64) << np.uint64(32)
            least = np.minimum.reduceat(ordered | (low + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)), starts)
            held = (held ^ least) * np.uint64(0xFF51AFD7ED558CCD)
            held ^= held >> np.uint64(32)
        out[:, band] = held
    return out


def document_frequencies(source: DataFrame, n: int) -> DataFrame:
    """(h, df) of words in at least RARE of the n documents: the others' idf is the greatest there is."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([b for _, b in held]), len(u)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "t"):
                t = Texts(part.column(1))
                begin, end, counts = blank_words(t)
                h = word_hashes(t.data, begin, end)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(t.n), counts)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h = h[new]
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                held.append((h[at], np.diff(np.append(at, len(h)))))
                if sum(len(a) for a, _ in held) > 2_000_000:
                    held = [fold()]
        if held:
            u, c = fold()
            for a in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 200_000].view(np.int64)), pa.array(c[a : a + 200_000])], ["h", "df"])

    return map_batches(source, counted, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= F.lit(RARE * n))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), by alternating large and small stars.

    Each step is a minimum for each node and a join back, so a node with very many neighbours costs no task more than its
    share; what a step leaves is written to the shared folder. Nodes without edges are not in the result.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = table(both.join(table(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similar(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (hashes in order, weights)."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(left[1][i], right[1][j]).sum(dtype=np.float64))
    union = float(left[1].sum(dtype=np.float64)) + float(right[1].sum(dtype=np.float64)) - both
    return both / union if union else 0.0


class Block:
    """Texts that one verifying task compares others with, as one sorted list of shingles."""

    def __init__(self, place: tuple, similarity: float):
        self.place, self.similarity = place, similarity
        self.keys: list[int] = []
        self.roots: list[int] = []
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.joined: dict[int, int] = {}
        self.ready = False

    def add(self, k: int, root: int, text: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys.append(k)
        self.roots.append(root)
        self.texts.append((text[0].copy(), text[1].copy()))

    def _sort(self) -> None:
        h = np.concatenate([a for a, _ in self.texts])
        order = np.argsort(h, kind="stable")
        self.h, self.w = h[order], np.concatenate([b for _, b in self.texts])[order]
        self.owner = np.repeat(np.arange(len(self.texts)), [len(a) for a, _ in self.texts])[order]
        self.sums = np.array([b.sum(dtype=np.float64) for _, b in self.texts])
        self.texts, self.ready = [], True

    def _root(self, r: int) -> int:
        while r in self.joined:
            r = self.joined[r]
        return r

    def links(self, k: int, root: int, text: tuple[np.ndarray, np.ndarray], both_ways: bool) -> list[int]:
        """Keys of texts as similar as asked that nothing yet joins with this one; if not both_ways, of smaller keys only."""
        if not self.keys:
            return []
        mine = self._root(root)
        open_ = [i for i, x in enumerate(self.keys) if (both_ways or x < k) and self._root(self.roots[i]) != mine]
        if not open_:
            return []
        if not self.ready:
            self._sort()
        lo, hi = np.searchsorted(self.h, text[0], "left"), np.searchsorted(self.h, text[0], "right")
        at = ragged(lo, hi - lo)
        common = np.bincount(self.owner[at], np.minimum(self.w[at], np.repeat(text[1], hi - lo)), len(self.keys))
        union = self.sums + text[1].sum(dtype=np.float64) - common
        out = []
        for i in open_:
            if union[i] and common[i] / union[i] >= self.similarity and self._root(self.roots[i]) != self._root(root):
                self.joined[self._root(self.roots[i])] = self._root(root)
                out.append(self.keys[i])
        return out


def _identity(docs: DataFrame, text: str, key: str) -> list[Column]:
    """k, the key; d1 and d2, 124 bits of hashes that stand for the text; and t, the text (null: empty)."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return [docs[key].cast("long").alias("k"), F.xxhash64(t).alias("d1"), F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long").alias("d2"), t.alias("t")]


def text_classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two tables: (k, d1, d2) of all rows with a key, and (d1, d2, first, class_id, leads) of all different texts.

    Texts linked by a chain of texts with weighted Jaccard similarity of at least `similarity` are a class. first is the
    text's smallest key, class_id the class's, and one text of a class leads it: of those with that key, the one with the least hash.

    A text is one node, however many rows have it. Texts meet in a band; there each is first compared with the bucket's leaders
    (its smallest node, its largest, and one by a hash), which joins a group at the cost of its members and not of their pairs.
    Then all pairs of a bucket that are still in different components are compared, so no link between texts that share a band
    is left out. Comparisons are of the whole texts. Null keys take no part. A null text counts as empty; texts without words
    are similar only to equal texts.
    """
    spark = docs.sparkSession
    source = docs.select(*_identity(docs, text, key)).where("k is not null")
    digests = table(source.select("k", "d1", "d2"))
    n = digests.count()
    # numbers are fixed once they are written; a key can't be the node, as its rows may have different texts
    nodes = table(digests.groupBy("d1", "d2").agg(F.min("k").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    frequent = local(document_frequencies(source.select("k", "t"), n))
    frequent = frequent.assign(h=frequent.h.to_numpy(np.int64).view(np.uint64)).sort_values("h")
    idf = spark.sparkContext.broadcast(Idf(frequent.h.to_numpy(np.uint64), np.log(n / frequent.df.to_numpy(float)).astype(np.float32)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = idf.value
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                h, w, begin = shingles(Texts(part.column(3)), own)
                sig = signatures(h, w, begin)
                some = pa.array(np.flatnonzero(np.diff(begin) > 0))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(some) for i in range(3)), pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))], ["k", "d1", "d2", "bands"])

    bands = map_batches(source, signed, "k long, d1 long, d2 long, bands array<long>").join(nodes, ["d1", "d2"]).where("k = first")
    bands = table(bands.select(F.col("node").alias("k"), "bands"))
    rows = bands.select("k", F.explode("bands").alias("b"))
    order = F.struct(F.xxhash64("k"), "k")
    leaders = table(rows.groupBy("b").agg(F.min("k").alias("l1"), F.max("k").alias("l2"), F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).where("l1 < l2").select("b", F.array("l1", "l2", F.col("o.k")).alias("leaders"), "n"))
    met = rows.join(leaders, "b").select("k", F.explode("leaders").alias("l")).where("k <> l").select(F.greatest("k", "l").alias("x"), F.least("k", "l").alias("y"), "k", "l")
    # of a pair that met both ways round one is kept: the one whose leader leads more
    met = met.groupBy("x", "y").agg(F.min("l").alias("l"))
    pairs = table(met.select("l", F.when(F.col("l") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("k")))
    release(spark)
    salts = pairs.groupBy("l").agg(F.count(F.lit(1)).alias("n")).select("l", F.ceil(F.col("n") / MEMBERS).cast("int").alias("salts"))
    zero = F.lit(0).alias("h")
    members = pairs.join(salts, "l").select("k", F.col("k").alias("r"), F.col("l").alias("g"), zero, F.pmod(F.xxhash64("k", F.lit(11)), F.col("salts")).cast("int").alias("s"), F.lit(1).alias("kind"))
    heads = salts.select(F.col("l").alias("k"), F.col("l").alias("r"), F.col("l").alias("g"), zero, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.lit(0).alias("kind"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = idf.value
        block = Block((), similarity)
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                h, w, begin = shingles(Texts(part.column(6)), own)
                a, b = [], []
                for i, (k, r, g, head, s, kind) in enumerate(zip(*(part.column(c).to_pylist() for c in range(6)))):
                    me = (h[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]])
                    if block.place != (g, head, s):
                        block = Block((g, head, s), similarity)
                    if kind == 0:
                        block.add(k, r, me)
                        continue
                    for other in block.links(k, r, me, kind == 1):
                        a.append(k)
                        b.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def verify(members: DataFrame, heads: DataFrame) -> DataFrame:
        given = members.unionByName(heads).join(nodes.withColumnRenamed("node", "k"), "k").withColumnRenamed("k", "node")
        wanted = given.join(source.withColumnRenamed("k", "first").hint("merge"), ["d1", "d2", "first"]).repartition("g", "h", "s").sortWithinPartitions("g", "h", "s", "kind")
        return table(map_batches(wanted.select(F.col("node").alias("k"), "r", "g", "h", "s", "kind", "t"), verified, "a long, b long"))

    links = verify(members, heads)
    release(spark)
    roots = table(components(links))
    # what the leaders left in different components of a bucket; its leaders have met all its members
    rest = rows.join(leaders.where("n > 3"), "b").where(~F.array_contains("leaders", F.col("k"))).select("b", "k").distinct()
    rest = table(rest.join(roots, F.col("k") == F.col("node"), "left").select("b", "k", F.coalesce("root", "k").alias("r")))
    parts = rest.groupBy("b", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(F.max(F.struct("n", "r")).alias("major"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    parts = table(parts.select("b", F.col("major.r").alias("major"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("salts"), F.ceil((F.col("n") - F.col("major.n")) / HEADS).cast("int").alias("blocks")))
    left = rest.join(parts, "b").withColumn("minor", F.col("r") != F.col("major"))
    # each pair of different components has a text outside the bucket's largest component: those are heads
    members = left.select("k", "r", F.col("b").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("h"), F.pmod(F.xxhash64("k", F.lit(11)), F.col("salts")).cast("int").alias("s"), F.when(F.col("minor"), 2).otherwise(1).alias("kind"))
    heads = left.where("minor").select("k", "r", F.col("b").alias("g"), F.pmod(F.xxhash64("k", F.lit(13)), F.col("blocks")).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.lit(0).alias("kind"))
    release(spark)
    late = verify(members, heads)
    if not late.isEmpty():
        root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        joined = late.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        merged = table(components(joined))
        # components of one text aren't in roots: their root in merged is their own row's
        alone = merged.join(roots.select("node"), "node", "left_anti")
        moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(alone)
    rooted = nodes.join(roots, "node", "left")
    least = F.struct("first", "d1", "d2")
    labels = rooted.where("root is not null").groupBy("root").agg(F.min(least).alias("least"))
    found = rooted.join(labels, "root", "left").select("d1", "d2", "first", F.coalesce("least.first", "first").alias("class_id"), F.coalesce(F.col("least") == least, F.lit(True)).alias("leads"))
    found = table(found)
    drop_tables(nodes, bands, leaders, pairs, links, rest, parts, late)
    return digests, found


def classes(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id): one row for each row of docs with a key; class_id is the smallest key of the class (see text_classes).

    Equal rows have equal classes; rows of one key with different texts may be in different ones, and then
    two classes may have one class_id. Copies are rows, not pairs. An empty table has no rows.
    """
    digests, found = text_classes(docs, similarity, text, key)
    return digests.join(found, ["d1", "d2"]).select(F.col("k").alias(key), "class_id")


def keep(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs, all columns, of each class: one with the smallest key, and every row without a key.

    Of equal keys with different texts in a class, and of rows with equal keys and texts, one stays. Columns may have any names.
    """
    digests, found = text_classes(docs, similarity, text, key)
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*_identity(docs, text, key)[:3], *[docs[c].alias(x) for c, x in zip(docs.columns, names)])
    on = ["k", "d1", "d2"]
    counted = digests.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(found, ["d1", "d2"])
    counted = table(counted.select(*on, "n", (F.col("leads") & (F.col("k") == F.col("first"))).alias("stays")))
    single = numbered.join(counted.where("not stays or n > 1").select(*on), on, "left_anti")
    # rows that are there several times with key and text: rare, so their table is small
    place = F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0)))
    several = numbered.join(counted.where("stays and n > 1").select(*on), on).withColumn("place", place).where("place = 1")
    return single.select(*names).unionAll(several.select(*names)).toDF(*docs.columns)


__all__ = ["Idf", "classes", "components", "keep", "shingles", "signatures", "similar", "text_classes"]
