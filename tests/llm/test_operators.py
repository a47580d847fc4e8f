import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tributary.llm import bpe, charlm, fingerprints, knn, langid, licenses, neardup, packing, substrings, token_counts, toxicity

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a\n b  c", "it's  they'll '' 12x", "漢字 😀 ￿", "<|endoftext|> a<|endoftext|>", "x" * 5000, "the cat " * 900, "a b a b", "a b a b", "ß É é\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, k long, h string")


def test_bpe_equals_the_library_and_goes_round(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == own.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


def test_token_counts_at_every_prefix(docs):
    model = token_counts.PieceBpe(PIECE)
    size = lambda text: len(model.model.encode(text))
    for r in token_counts.count_tokens(docs, PIECE, 7, prefixes=True).collect():
        whole = TEXTS[r.doc_id] or ""
        text = whole.encode()
        assert r.n_bytes == len(text) and r.n_tokens == size(whole)
        for b, n in list(zip(r.prefix_bytes, r.prefix_tokens))[:40]:
            assert n == size(text[:b].decode())
        longest = max(i for i in range(min(len(whole), 300) + 1) if size(whole[:i]) <= 7)
        assert (r.cut_bytes, r.cut_tokens) == (len(whole[:longest].encode()), size(whole[:longest]))
    for w in ("thinking", "éa漢x", "  a"):
        assert model.inner_counts(w.encode())[1:] == [size(w[:i]) for i in range(1, len(w) + 1)]
    for text in ("Unbelievable  things happened;\tsaid 漢字 and é😀x", " ▁ a▁b  ", "x" * 60, "antidisestablishmentarianism" * 3):
        assert [model.count_at(text, i) for i in range(len(text) + 1)] == [size(text[:i]) for i in range(len(text) + 1)]


def brute_knn(rows, every, k):
    """(query_id, rank, vec_id, score) of (id, vector) rows; shorter vectors count as 0 where they end."""
    v = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64).tolist()) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in v if j != q)[:k]
            out += [(q, i + 1, j, -s) for i, (s, j) in enumerate(best)]
    return sorted(out)


def check_knn(spark, rows, every=50, k=5):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, cell string, r int")
    assert sorted(map(tuple, knn.search(df, every, k).collect())) == brute_knn(rows, every, k)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(1)
    x[40:80] = x[0]
    check_knn(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (501, [float("nan")] * 6), (550, [1.0, None])])


def test_knn_of_groups_lengths_and_repeated_ids(spark, monkeypatch):
    # groups far apart, small parts and blocks, vectors of unequal lengths, empty ones, rows with one id, null ids
    monkeypatch.setattr(knn, "PART_ROWS", 20)
    monkeypatch.setattr(knn, "QUERY_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 0.2 + 9 * (i % 5)).tolist()) for i in range(200)] + [(201, [1.0]), (202, []), (210, [3.0, 4.0]), (210, [-3.0, 4.0, 1.0, 0.0, 5.0]), (211, [2.0] * 4), (211, [2.0] * 4), (None, [1.0] * 4)]
    check_knn(spark, rows, 10, 7)
    check_knn(spark, rows[:3], 1, 5)
    check_knn(spark, [(0, [1.0])], 1, 5)
    assert knn.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_knn_own_row_takes_no_place(spark):
    # all answers of query 0 lie in its own group, and the query itself scores highest there
    data = [(i, [10.0 - i, 0.0]) for i in range(8)]
    got = sorted(map(tuple, knn.top_k(knn.integers(spark.createDataFrame(data, "vec_id long, embedding array<float>"), 1), knn.integers(spark.createDataFrame(data[:1], "vec_id long, embedding array<float>"), 1), 5, 1).collect()))
    assert got == [(0, i, i, 10 * (10 - i)) for i in range(1, 6)]


def test_toxicity_restores(spark):
    df = spark.createDataFrame([(i, "you are an idiot and a stupid moron " * 3) for i in range(40)] + [(99, None)], "doc_id long, text string")
    own = toxicity.Restorer(toxicity.language_model(df))
    for said, meant in (("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("m o r o n", "moron"), ("stuuupid", "stupid")):
        assert "".join(own.words(said)) == meant
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(df, labels).count() == 41


def test_toxicity_restores_ordinary_disguises(spark):
    said = "you are an idiot and a stupid moron loser asshole ass sob shit loo "
    own = toxicity.Restorer(toxicity.language_model(spark.createDataFrame([(i, said * 3) for i in range(40)], "doc_id long, text string")))
    pairs = [("455hole", "asshole"), ("a55", "ass"), ("4$$", "ass"), ("1053r", "loser"), ("50b", "sob"), ("l00", "loo"), ("sh17", "shit"), ("stuupid", "stupid"), ("@ s s", "ass")]
    pairs += [("$ t u p i d", "stupid"), ("i . d . i . o . t", "idiot"), ("1 d 1 0 t", "idiot"), ("m\no\nr\no\nn", "moron"), ("s.t.u.p.i.d", "stupid")]
    letters, begin, owner = toxicity.restored_words(toxicity.Texts(pa.array([None, *(f"once {x} upon" for x, _ in pairs), "in 455 of 1984"])), own)
    got = {}
    for a, b, d in zip(begin, begin[1:], owner):
        got.setdefault(int(d), []).append(letters[a:b].tobytes().decode("utf-16-le"))
    assert {x: got[i + 1] for i, (x, w) in enumerate(pairs) if w not in got[i + 1]} == {}
    assert got[len(pairs) + 1] == ["in", "of"]


def test_toxicity_scores_do_not_depend_on_neighbours(spark):
    # spaced words at the edges of documents belong to their own document
    texts = ["xx", "m o r", "yy", "o n", None, "m o r o n", "a", "", "s t u p", "i d"]
    own = toxicity.Restorer(toxicity.language_model(spark.createDataFrame([(i, "you stupid moron " * 9) for i in range(9)], "doc_id long, text string")))
    found = toxicity.Classifier(*_features(["moron", "stupid", "mor"]), np.array([-3.0, 1.0, 0.5]))
    together = found.inputs(toxicity.Texts(pa.array(texts)), own)
    alone = np.concatenate([found.inputs(toxicity.Texts(pa.array([t], pa.string())), own) for t in texts])
    assert np.array_equal(together, alone) and together[5, 0] > 0 and together[0, 0] == 0


def _features(words):
    keys = np.unique(np.concatenate([toxicity.word_features(np.frombuffer(w.encode("utf-16-le"), np.uint16), np.array([0, len(w)]))[0][:1] for w in words]))
    return keys, np.full(len(keys), 3.0)


def test_toxicity_learns_out_of_fold(spark):
    # every labelled row is used; hidden words of held-out rows are found, clean and empty ones are left alone, rows repeat
    rng = np.random.default_rng(9)
    clean = lambda: " ".join(rng.choice(["house", "garden", "river", "stone", "cloud", "bread"], 30))
    rows = [(i, clean() + (" you stupid moron" if i % 3 == 0 else "")) for i in range(240)]
    rows += [(1000, clean() + " st*pid m0r0n"), (1000, clean() + " st*pid m0r0n"), (1001, clean()), (1002, None), (1003, ""), (None, clean())]
    docs = spark.createDataFrame([(*r, 1, "t", "en") for r in rows], "doc_id long, text string, k int, t string, part string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(240)] + [(5, 0, None), (None, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).select("doc_id", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id is not None and (r.doc_id == 1000 or (r.doc_id < 1000 and r.doc_id % 3 == 0))) for r in got)
    model = toxicity.language_model(docs)
    kept = toxicity.keep(docs, toxicity.train(docs, labels, model), model)
    assert kept.columns == docs.columns and kept.count() == 160 + 4
    none = labels.limit(0)
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5} and toxicity.classify(docs.limit(0), labels).count() == 0


def test_logistic_reaches_the_minimum_on_separable_classes():
    rng = np.random.default_rng(2)
    for n, t in ((4000, 400), (4500, 60), (500, 500)):
        a = np.concatenate([rng.uniform(0, 2.5, n), rng.uniform(5, 6.5, t)])
        x, y = np.column_stack([a, np.log1p(a * 3 * (a > 2))]), np.repeat([0.0, 1.0], [n, t])
        z = np.column_stack([np.ones(n + t), x]) @ toxicity._logistic(x, y)
        assert (z[y == 1] > 0.85).all() and (z[y == 0] < 0.85).all()
    assert toxicity._logistic(np.zeros((9, 2)), np.zeros(9)).shape == (3,)


def test_language_id(spark):
    data = [(i, "the house and the garden of the king", "en") for i in range(30)] + [(100 + i, "das haus und der garten des königs", "de") for i in range(30)] + [(300, None, "en"), (301, "12 !", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert {got[i].lang_pred for i in range(30)} == {"en"} and {got[100 + i].lang_pred for i in range(30)} == {"de"}
    assert got[300].lang_pred == got[301].lang_pred == "und"


def test_language_limits_are_of_each_label_over_all_texts(spark):
    # the only texts of a small language that its model explains badly would be above a common limit
    rng = np.random.default_rng(4)
    odd = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(40))
    data = [(i, "the house and the garden of the king", "en") for i in range(9000)] + [(9000, odd, "xx")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model, limit = langid.train(docs)
    scored = langid.score(docs, model, limit)
    low = {r.lang_pred: r.top for r in scored.groupBy("lang_pred").agg({"cross_entropy": "max"}).toDF("lang_pred", "top").collect()}
    assert model.labels == ["en", "xx"] and all(abs(limit[i] / langid.SLACK - low[x]) <= 1 / langid.STEPS for i, x in enumerate(model.labels))
    assert langid.keep(docs, model, limit).count() == 9001
    nothing = langid.train(docs.where("doc_id < 0"))
    assert langid.keep(docs, *nothing).count() == 9001


def test_models_keep_every_counted_gram(spark):
    data = [(i, "the house and the garden " * 600, "en") for i in range(40)] + [(99, "zyx", "en")]
    counts = charlm.count_grams(spark.createDataFrame(data, "doc_id long, text string, lang string"), "lang").cache()
    model = charlm.fit(counts)
    want = sorted(np.array([r.gram for r in counts.collect()], np.int64).view(np.uint64).tolist())
    assert model.grams[3][0].tolist() == want and len(want) == len(set(want))
    z = np.array([(1 << 48) | (1 << 32) | (1 << 16) | ord("z")], np.uint64)
    assert model.score(z)[0, 0] > model.score(z - np.uint64(ord("z")) + np.uint64(ord("q")))[0, 0]


def test_hashes_of_arrow_slices():
    t = substrings.Texts(pa.array(["a b", None, "c"]).slice(1))
    assert t.n == 2 and t.bytes_of(1) == b"c"
