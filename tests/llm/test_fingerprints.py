import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tributary.llm import fingerprints


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    """[(hash, [(hash, labels)])] by plain Python."""
    out = []
    for s in re.split(r"(?<=\n\n)(?=[^\n])", text):
        ps = []
        for p in re.split(r"(?<=\n)(?=[^\n])", s):
            pieces = re.findall(r"(?s:.{3,31}?[a-m.,]\s|.{1,32})", p, re.ASCII)
            ps.append((sha(p), [xxhash.xxh64(x.encode(), seed=42).intdigest() & 0xFFFFFF for x in pieces]))
        out.append((sha("".join(h for h, _ in ps)), ps))
    return out


def plain_fingerprint(nodes):
    said = "/".join(f"{h[:12]}:" + ",".join(f"{p[:12]}:" + "".join(f"{x:06X}" for x in labels) for p, labels in ps) for h, ps in nodes)
    return sha("".join(h for h, _ in nodes)) + ";" + said


def plain_likeness(a, b):
    if plain_fingerprint(a).split(";")[0] == plain_fingerprint(b).split(";")[0]:
        return 1.0
    x, y = (Counter(i for _, ps in t for _, labels in ps for i in labels) for t in (a, b))
    every = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / every if every else 0.0


def plain(rows):
    """The result for (key, text) rows, as a list: rows of one key in the order of the text's hash, equal rows as one."""
    code = lambda t: int(np.array([xxhash.xxh64(t.encode(), seed=42).intdigest()], np.uint64).view(np.int64)[0])
    kept = sorted((k, code(t or ""), t or "") for k, t in rows if k is not None)
    order = sorted(set(kept))
    out = []
    for i, (k, _, t) in enumerate(order):
        following = order[(i + 1) % len(order)][2]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        own, other = plain_tree(t), plain_tree(edited)
        row = (k, len(t), sha(edited), plain_fingerprint(own), plain_fingerprint(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, plain_tree(following)), 9))
        out += [row] * sum(x == order[i] for x in kept)
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, k string, h string, range string, t string")
    got = sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, fingerprints.compare_edited(df).collect()))
    assert got == plain(rows)


def test_equals_plain_python(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(1, 9))))
    text = lambda n: "".join(word() + str(rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "\r\n"])) for _ in range(n))
    rows = [(int(i), text(int(n))) for i, n in zip(rng.permutation(60), rng.integers(0, 150, 60))]
    rows += [(100, "abc. " * 30), (101, "abc. " * 30), (102, None), (103, ""), (104, "é漢😀 " * 40), (105, "z"), (106, "\n\n\n"), (107, "x" * 30000 + "\n" + text(3000))]
    check(spark, rows)


def test_repeated_rows_and_keys(spark):
    check(spark, [(1, "one text. and more of it"), (2, "two texts"), (2, "two texts"), (2, "two texts"), (2, "another text of the key"), (3, None), (None, "no key")])
    check(spark, [(5, "alone")])
    assert fingerprints.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differing_branches_locate_edits(spark):
    a = "Title.\n\nFirst line.\nSecond line.\n\nLast section."
    b = "Title.\n\nFirst line.\nSecond word.\nNew line.\n\nLast section."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    got = row.select(fingerprints.edits(F.col("a"), F.col("b")).alias("e"), fingerprints.edits(F.col("a"), F.col("a")).alias("none"), fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert [tuple(x) for x in got.e] == [(1, 1), (1, 2)] and got.none == []
    assert round(got.near, 9) == round(plain_likeness(plain_tree(a), plain_tree(b)), 9)
