import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from tributary.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def plain_place(lengths, size):
    """The rule, gap by gap: what the bins hold in the end. Which of several bins with one gap takes an item makes no difference to it."""
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        gaps = [size - sum(lengths[j] for j in b) for b in bins]

        def squares(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < size)

        fits = sorted({g for g in gaps if g >= lengths[i]})
        if fits:
            g = min(fits, key=lambda g: (squares([*(x for k, x in enumerate(gaps) if k != gaps.index(g)), g - lengths[i]]), g))
            bins[gaps.index(g)].append(i)
        else:
            bins.append([i])
    return sorted(sum(lengths[i] for i in b) for b in bins)


@pytest.mark.parametrize("size", [10, 31, 64])
def test_places_follow_the_rule(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 40, 120):
        lengths = rng.integers(1, size + 1, n)
        bins, offsets = packing.place(lengths, size)
        own = {}
        for b, o, x in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist())):
            assert o == sum(own.get(b, []))
            own.setdefault(b, []).append(x)
        assert sorted(map(sum, own.values())) == plain_place(lengths.tolist(), size)


def test_documents(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [None, "", " ", "<|endoftext|>", "the cat " * 900, "x" * 5000, "漢字 😀", *(" ".join(["word"] * int(n)) for n in rng.integers(1, 150, 120))]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(3, "a b", "n"), (3, "a b", "n"), (None, "no key", "n")], "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(df, BYTE, 64).collect()
    own = Tokenizer.from_file(BYTE)
    by = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(math.ceil(len(ids) / 64))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 64 for r in parts[1:])
        for r, at in zip(parts, np.cumsum([0, *(r.length for r in parts)])):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
    assert sum(r.doc_id == 3 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 64 and len(sequences) <= math.ceil(sum(r.length for r in rows) / 64) + 1
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


def test_shards_leave_few_sequences_unfilled(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    df = spark.range(1000).selectExpr("id as doc_id", "pmod(id * 37, 20) + 1 as length", "'x' as shard")
    rows = packing.pack(df, 64).collect()
    assert len(rows) == 1000 and {r.shard for r in rows} == {"x"}
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(r.length for r in rows) / 64) + 2
    with pytest.raises(Exception, match="out of range"):
        packing.pack(df.selectExpr("doc_id", "65 as length"), 64).collect()
