import numpy as np
import pyarrow as pa

from tributary.llm import neardup
from tributary.llm.runtime import Texts
from tributary.llm.splitting import blank_words, word_hashes


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def changed(rng, base, n):
    out = list(base)
    for at in rng.choice(len(base), n, replace=False):
        out[at] = words(rng, 1)[0]
    return " ".join(out)


def weighed(texts):
    """Each text's shingles and weights, its idf counted over all of them in plain Python."""
    df = {}
    for t in texts:
        for x in set((t or "").split()):
            df[x] = df.get(x, 0) + 1
    n = len(texts)
    t = Texts(pa.array(list(df) or [""]))
    begin, end, _ = blank_words(t)
    seen = sorted((int(h), c) for h, c in zip(word_hashes(t.data, begin, end), df.values()) if c >= neardup.RARE * n)
    idf = neardup.Idf(np.array([h for h, _ in seen], np.uint64), np.log(n / np.array([c for _, c in seen], float)).astype(np.float32))
    h, w, at = neardup.shingles(Texts(pa.array(texts, pa.string())), idf)
    return [(h[a:b], w[a:b]) for a, b in zip(at, at[1:])]


def brute(rows, similarity=0.8):
    """The class of each (key, text) row by all pairs, and the links."""
    own = weighed([t for _, t in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, (_, t) in enumerate(rows):
        for j in range(i):
            if (t or "") == (rows[j][1] or "") or neardup.similar(own[i], own[j]) >= similarity:
                links += 1
                root[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), k), k)
    return sorted((k, low[top(i)]) for i, (k, _) in enumerate(rows)), links


def check(spark, rows):
    want, links = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(df).collect())) == want
    return links


def test_random_tables_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [words(rng, 120) for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(20 + i, changed(rng, base[int(rng.integers(0, 20))], int(rng.integers(1, 6)))) for i in range(100)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "\n"), (205, " ".join(words(rng, 9000)))]
    assert check(spark, rows) > 60


def test_star_equals_brute_force(spark):
    # copies of a key in the middle are like it, but not like each other; nothing of the 200 is lost
    rng = np.random.default_rng(7)
    base = words(rng, 120)
    rows = [(i if i < 100 else i + 1, changed(rng, base, 2)) for i in range(200)] + [(100, " ".join(base))]
    rows += [(1000 + i, " ".join(words(rng, 40))) for i in range(300)]
    want, links = brute(rows)
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert links > 20 and got == want


def test_rows_of_one_key_and_equal_rows(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (6, b), (9, c), (9, c), (9, c)]
    check(spark, rows)
    names = ["k", "d1", "c0", "node", "class_id", "first"]
    df = spark.createDataFrame([(*r, *names) for r in [*rows, (None, a), (None, a)]], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    out = neardup.keep(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or -1, r.text) for r in out.collect())) == sorted([(-1, a), (-1, a), (1, a), (5, b), (9, c)])
    assert all(r[n] == n for r in out.collect() for n in names)
    none = df.limit(0)
    assert neardup.classes(none).count() == 0 and neardup.keep(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100
