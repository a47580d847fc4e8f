import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline

WORDS = ["house", "garden", "river", "stone", "cloud", "bread", "winter", "summer", "water", "forest", "mountain", "window", "letter", "morning", "evening", "village", "doctor", "teacher", "market", "bridge"]


def test_all_stages_against_plain_python(spark, tmp_path):
    """run() on rows with toxic, unreadable, copied, repeated, null, empty and very long texts equals what plain Python makes of them."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    passage = prose(30)
    rows = [(i, prose(40) + (" you stupid moron idiot" if i % 4 == 0 else "")) for i in range(120)]
    copied = prose(60)
    rows += [(200, copied), (201, copied), (201, copied), (202, f"{prose(20)} {passage} {prose(20)}"), (203, f"{prose(25)}\n{passage}\n{prose(15)}")]
    rows += [(300, None), (301, ""), (302, "12 34 !"), (303, prose(6000)), (None, prose(30))]
    docs = [(k, t, "en", "web", len(t or ""), "x") for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `_key` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # by hand: toxic and letterless rows go, copies go but for one row, and the later document loses the shared passages
    kept = [(k, t) for k, t in rows if not (k is not None and k < 120 and k % 4 == 0) and k not in (300, 301, 302)]
    kept = [r for i, r in enumerate(kept) if r not in kept[:i] and r[0] != 201]
    first = {}
    for k, t in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    want = {}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in kept:
        spans = [m.span() for m in re.finditer(r"\S+\s*", t)]
        w = t.split()
        gone = {j for i in range(len(w) - 12) if k is not None and first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        said = "".join(t[a:b] for i, (a, b) in enumerate(spans) if i not in gone)
        want[k] = np.array([*own.encode(said, add_special_tokens=False).ids, 0], "<u4")
    assert len(want[203]) < len(own.encode(rows[124][1]).ids)

    got = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.piece):
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for k, parts in got.items():
        assert sum(r.length for r in parts) == len(want[k])
        assert all(zlib.crc32(want[k][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "near-dedup", "substring dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
