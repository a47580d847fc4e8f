"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

A section ends after a blank line, a paragraph after its line breaks. A paragraph's hash is of its text, a section's of its
paragraphs' hashes, the root's of its sections', all SHA-256; the pieces of each level are the whole text, so equal roots
mean equal texts. Below a paragraph lie the labels of its pieces, which measure likeness: a piece ends after a blank that follows
one of the letters a to m, a comma or a full stop (or after 32 characters), so that pieces fall into step again behind an edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.runtime import table

SECTION, PARAGRAPH = r"(?<=\n\n)(?=[^\n])", r"(?<=\n)(?=[^\n])"
PIECE = r"(?s).{3,31}?[a-m.,]\s|.{1,32}"
#: Hex digits of a piece's label, and those of a section's and paragraph's hash that a fingerprint keeps.
LABEL, NODE = 6, 12


def tree(text: Column) -> Column:
    """Sections of (hash, paragraphs of (hash, labels)); an empty text is one empty paragraph without labels."""

    def paragraph(p: Column) -> Column:
        labels = F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 4 * LABEL) - 1).cast("long")).cast("int"))
        return F.struct(F.sha2(p, 256).alias("hash"), labels.alias("labels"))

    whole = F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), paragraph))
    return F.transform(whole, lambda ps: F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["hash"]), ""), 256).alias("hash"), ps.alias("paragraphs")))


def printed(nodes: Column) -> Column:
    """The fingerprint of a tree: root;sections, apart by /. A section is hash:paragraphs, apart by commas, and a paragraph
    hash:labels, in hexadecimal digits of fixed width."""
    root = F.sha2(F.array_join(F.transform(nodes, lambda s: s["hash"]), ""), 256)
    label = lambda x: F.substring(F.hex(x.cast("long") + (1 << 4 * LABEL)), 2, LABEL)
    paragraph = lambda p: F.concat(F.substring(p["hash"], 1, NODE), F.lit(":"), F.array_join(F.transform(p["labels"], label), ""))
    section = lambda s: F.concat(F.substring(s["hash"], 1, NODE), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(root, F.lit(";"), F.array_join(F.transform(nodes, section), "/"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    return printed(tree(F.coalesce(text, F.lit(""))))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ";", 1)


def sections(print_: Column) -> Column:
    """(hash, paragraphs of (hash, labels)) of a fingerprint, as it keeps them."""

    def paragraph(p: Column) -> Column:
        labels = F.regexp_extract_all(F.substring_index(p, ":", -1), F.lit(f"[0-9A-Fa-f]{{{LABEL}}}"), F.lit(0))
        return F.struct(F.substring(p, 1, NODE).alias("hash"), F.transform(labels, lambda x: F.conv(x, 16, 10).cast("int")).alias("labels"))

    section = lambda s: F.struct(F.substring(s, 1, NODE).alias("hash"), F.transform(F.split(F.substring(s, NODE + 2, 1 << 30), ","), paragraph).alias("paragraphs"))
    return F.transform(F.split(F.substring_index(print_, ";", -1), "/"), section)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column that a lambda uses is computed anew for each element, a lambda's argument isn't."""
    return F.get(F.transform(F.array(value), body), 0)


def labels_of(nodes: Column) -> Column:
    """All labels of a tree. One that occurs again carries the number of its occurrence, so that repeats stay apart."""
    plain = F.flatten(F.flatten(F.transform(nodes, lambda s: F.transform(s["paragraphs"], lambda p: p["labels"]))))

    def numbered(given: Column) -> Column:
        begins = F.filter(F.transform(given, lambda x, i: F.when((i == 0) | (x != F.get(given, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
        run = lambda first, a, j: F.struct(F.get(given, a).cast("long").alias("x"), (F.coalesce(F.get(first, j + 1), F.size(given)) - a).alias("n"))
        runs = _let(begins, lambda first: F.transform(first, lambda a, j: run(first, a, j)))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda i: r["x"] + F.shiftleft(i.cast("long"), 4 * LABEL))))

    again = F.size(F.array_distinct(plain)) < F.size(plain)
    return F.when(again, _let(F.sort_array(plain), numbered)).otherwise(plain.cast("array<long>"))


def share(a: Column, b: Column) -> Column:
    """Twice the labels that are in both arrays, over all of them: 0 where there are none."""
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / every)


def likeness(a: Column, b: Column) -> Column:
    """How much two fingerprints have in common, in pieces: 1 for equal roots, 0 where nothing is shared."""
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(share(labels_of(sections(a)), labels_of(sections(b))))


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint b differs from a: (section, paragraph), from 0, of b's paragraphs that a has nowhere. Equal roots end the
    search at once, and a section whose hash a has too isn't entered."""

    def inner(own: Column, other: Column) -> Column:
        hashes = lambda nodes: F.transform(nodes, lambda s: s["hash"])
        said = lambda mine: F.flatten(F.transform(F.filter(other, lambda s: ~F.array_contains(mine, s["hash"])), lambda s: hashes(s["paragraphs"])))
        ways = lambda s, i, there: F.transform(s["paragraphs"], lambda p, j: F.when(~F.array_contains(there, p["hash"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        entered = lambda known, there: F.transform(own, lambda s, i: F.when(~F.array_contains(known, s["hash"]), ways(s, i, there)))
        found = _let(hashes(other), lambda known: _let(_let(hashes(own), said), lambda there: entered(known, there)))
        return F.filter(F.flatten(F.filter(found, lambda x: x.isNotNull())), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(root(a) == root(b), none).otherwise(_let(sections(b), lambda own: _let(sections(a), lambda other: inner(own, other))))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, fingerprint) of each whole text. No shuffle."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, F.length(own).cast("long").alias("n_chars"), fingerprint(own).alias("fingerprint"))


def _fixed(borders: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in borders])


def _range_of(borders: list[tuple[int, int]]) -> Column:
    """The number of the last border that is not above (k, h): by its group of borders, then inside that group."""
    step = max(1, int(len(borders) ** 0.5))
    groups = [borders[i : i + step] for i in range(0, len(borders), step)]
    below = lambda x: (x["k"] < F.col("k")) | ((x["k"] == F.col("k")) & (x["h"] <= F.col("h")))
    group = F.size(F.filter(_fixed([g[0] for g in groups]), below)) - 1
    return group * step + F.size(F.filter(F.get(F.array(*map(_fixed, groups)), group), below)) - 1


def compare_edited(docs: DataFrame, part: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against its edited
    text, whose last floor(n/part) characters are those that the next document begins with, and against the next document.

    Null texts count as empty; rows without doc_id take no part, and an empty table stays empty. Rows of one doc_id follow each other in order of a
    hash of their texts; equal rows are one document in that order and give equal rows each. A document alone is its own next one.

    Documents are dealt by ranges of doc_id (as many as shuffle partitions; only their borders come to the driver), and each
    range gets its next range's first document too. So texts move once, and each text's tree is made once.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.xxhash64(own).alias("h"), own.alias("t"))
    ids = table(texts.select("k", "h").distinct())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = ids.repartitionByRange(parts, "k", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("k", "h")).alias("b"))
    borders = sorted((r.b.k, r.b.h) for r in least.collect()) or [(0, 0)]
    placed = texts.withColumn("range", _range_of(borders))
    is_border = F.get(_fixed(borders), F.col("range")) == F.struct("k", "h")
    place = lambda r, border: F.struct(r.cast("int").alias("range"), F.lit(border).alias("border"))
    twice = F.array(place(F.col("range"), False), place(F.pmod(F.col("range") - 1, F.lit(len(borders))), True))
    placed = placed.withColumn("at", F.explode(F.when(is_border, twice).otherwise(F.slice(twice, 1, 1)))).select("k", "h", "t", "at.range", "at.border")
    order = ["border", "k", "h"]
    dealt = placed.repartitionById(len(borders), "range").sortWithinPartitions("range", *order)
    line, same = Window.partitionBy("range").orderBy(*order), Window.partitionBy("range", *order)
    me = F.struct(*order)
    single = dealt.withColumn("times", F.count(F.lit(1)).over(same)).withColumn("again", F.lag(me).over(line) == me).where("not coalesce(again, false)")
    grown = single.select("range", *order, "times", "t", tree(F.col("t")).alias("tree"))
    grown = grown.select("range", *order, "times", "t", printed(F.col("tree")).alias("fingerprint"), labels_of(F.col("tree")).alias("labels"))
    met = grown.withColumn("next_t", F.lead("t").over(line)).withColumn("next_labels", F.lead("labels").over(line)).withColumn("next_root", F.lead(root(F.col("fingerprint"))).over(line)).where("not border")
    edited = F.expr(f"concat(substring(t, 1, cast(length(t) - floor(length(t) / {part}) as int)), substring(next_t, 1, cast(floor(length(t) / {part}) as int)))")
    out = met.withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited"))).withColumn("edited_fingerprint", printed(F.col("edited_tree"))).withColumn("edited_labels", labels_of(F.col("edited_tree")))
    near = lambda other_root, labels: F.when(root(F.col("fingerprint")) == other_root, F.lit(1.0)).otherwise(share(F.col("labels"), labels))
    return out.select(
        F.col("k").alias("doc_id"), F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near(root(F.col("edited_fingerprint")), F.col("edited_labels")).alias("near_edited"), near(F.col("next_root"), F.col("next_labels")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")


__all__ = ["compare_edited", "edits", "fingerprint", "fingerprints", "labels_of", "likeness", "root", "sections", "share", "tree"]
