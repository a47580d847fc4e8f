import re

import numpy as np

from tributary.llm import substrings


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, n):
    """Kept words of each (key, text): windows whose words start in a row with a smaller key go."""
    low = {}
    for k, t in rows:
        w = words_of(t)
        for i in range(len(w) - n + 1 if k is not None else 0):
            x = tuple(w[i : i + n])
            low[x] = min(low.get(x, k), k)
    out = []
    for k, t in rows:
        w, gone = words_of(t), set()
        for i in range(len(w) - n + 1 if k is not None else 0):
            if low[tuple(w[i : i + n])] < k:
                gone |= set(range(i, i + n))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def check(spark, rows, window=13, anchor=5):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(map(tuple, substrings.dedup(df, window, anchor).collect())) == by_row(brute(rows, window))
    return df


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(12)]
    texts = [*base, *[base[i][: 40 + i] + "  " + base[(i * 5) % 12][20:90] for i in range(12)], base[0], None, "", "a " * 300, "a " * 200]
    check(spark, list(enumerate(texts)))
    check(spark, list(enumerate(texts)), 6, 3)


def test_passages_of_several_documents_meet_inside_a_text(spark):
    # runs of few different words, so that anchors repeat and contexts differ at every cut
    rng = np.random.default_rng(11)
    pool = [" ".join(rng.choice(["x", "y", "zz"], 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        pieces = [pool[j].split()[a : a + 25] for j, a in zip(rng.integers(0, 6, 3), rng.integers(0, 20, 3))]
        rows.append((int(rng.integers(0, 40)), "\t".join(w for p in pieces for w in [*p, f"u{i}"])))
    check(spark, rows)
    check(spark, rows, 7, 2)


def test_rows_of_one_key_stay_apart(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(20)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (6, b), (7, f"{c} {b}"), (7, f"{c} {b}"), (None, a), (8, None), (8, "")]
    df = check(spark, rows)
    got = sorted((r.doc_id, r.text) for r in substrings.cut(df.where("doc_id is not null")).where("text <> ''").collect())
    assert got == [(1, a), (5, b), (7, f"{c} "), (7, f"{c} ")]


def test_very_long_and_empty(spark):
    check(spark, [(1, "w " * 9000), (2, "w " * 3 + "end"), (3, " ".join(f"q{i}" for i in range(30000))), (4, " ".join(f"q{i}" for i in range(20000, 30013)))])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(none).count() == 0 and substrings.cut(none).count() == 0


def test_cut_keeps_white_space_and_clashing_columns(spark):
    p = " ".join(f"p{i}" for i in range(20))
    names = ["_key", "_from", "_to", "_cut", "k", "d", "t", "from", "to", "cut", "c0", "spans"]
    data = [(1, f"é {p}\nend", 3), (2, f" start\n\n{p}\n漢字 last\n", 4), (3, None, 5), (4, p, None), (None, p, 7)]
    df = spark.createDataFrame([(*r, *names) for r in data], ", ".join(["doc_id long", "text string", "n_chars int", *[f"`{n}` string" for n in names]]))
    out = substrings.cut(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == " start\n\n漢字 last\n" and got[2].n_chars == len(got[2].text)
    assert (got[1].text, got[1].n_chars) == (f"é {p}\nend", 3) and got[3].text is None and got[3].n_chars == 5
    assert (got[4].text, got[4].n_chars) == ("", 0) and (got[None].text, got[None].n_chars) == (p, 7)
    assert all(got[i][n] == n for i in got for n in names)
