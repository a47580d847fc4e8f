"""Byte-level BPE encoding and decoding over a distinct-word table.

A merge never crosses a word of the pre-tokenizer's pattern, so a text's ids are its words' ids one after the other.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.runtime import Texts, binary_array, kept, map_batches, ragged, slices
from tributary.llm.splitting import byte_level_words, word_hashes

#: Entries that a worker's cache of words holds before it starts anew.
CACHE_WORDS = 500_000
#: Bytes of text in a step, and distinct words that a partition gathers before it sends them.
SLICE, HELD_WORDS = 2 << 20, 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library, applied word by word."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in w): i for w, i in spec["model"]["vocab"].items()}
        added = spec.get("added_tokens", [])
        if len(added) > 1 or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("only one plain added token is supported")
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        if any(a >= b for a, b in zip(order, order[1:])):
            raise ValueError("merges and ids are in different orders")
        self.special = added[0]["content"].encode() if added else b""
        self.special_id = added[0]["id"] if added else -1
        self._encoder = None
        self.pieces = {i: w for w, i in ranks.items()}
        if added:
            self.pieces[self.special_id] = self.special
        self._cache: dict[bytes, bytes] = {}

    @property
    def _one(self):  # noqa: ANN202
        """The encoder of a word, made when first needed: decoding and joining do without."""
        if self._encoder is None:
            import tiktoken

            ranks = {w: i for i, w in self.pieces.items() if i != self.special_id}
            self._encoder = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return self._encoder

    def word(self, w: bytes) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit integers."""
        if w == self.special:
            return np.array([self.special_id], "<u4").tobytes()
        return np.array(self._one(w), "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self._cache.get, words))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            if len(self._cache) + len(missing) > CACHE_WORDS:
                self._cache.clear()
            one = self._one
            for i in missing:
                w = words[i]
                got[i] = self._cache[w] = array("I", one(w)).tobytes() if w != self.special else self.word(w)
        return got

    def piece_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes one after the other, and where each id's begin (one entry more)."""
        n = max(self.pieces) + 1
        each = [self.pieces.get(i, b"") for i in range(n)]
        return np.frombuffer(b"".join(each), np.uint8), np.append(0, np.cumsum([len(p) for p in each]))


def vocabulary(path: str) -> ByteBpe:
    return kept(f"bpe:{path}", lambda: ByteBpe(path))


def split_words(part: pa.RecordBatch, column: str, special: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a slice as a dictionary array, and their number for each document."""
    t = Texts(part.column(part.schema.get_field_index(column)))
    offsets, counts = byte_level_words(t, special)
    return binary_array(t.data, offsets).dictionary_encode(), counts


def join_ids(codes: np.ndarray, ids: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents one after the other, given each distinct word's; and each document's end."""
    length = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    flat = np.frombuffer(b"".join(ids), "<u4")
    begin = np.cumsum(length) - length
    out = flat[ragged(begin[codes], length[codes])]
    ends = np.cumsum(np.append(0, length[codes]))[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    return out, ends


def slice_ids(part: pa.RecordBatch, column: str, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's documents, encoded here with the worker's cache of distinct words."""
    words, counts = split_words(part, column, bpe.special)
    return join_ids(words.indices.to_numpy(), bpe.words(words.dictionary.to_pylist()), counts)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): each whole text's ids as little-endian unsigned 32-bit integers in one binary value.

    1. Each scan partition splits its words and gives each distinct one once, in a value for each bucket of their hashes. A word
       comes about once for each partition, however often it occurs.
    2. Buckets are dealt out, so each distinct word is encoded in one place, once.
    3. The ids go back to their partition, meet its (compressed) texts there, and are joined by position.

    Null text counts as empty and has no ids; key may be null or repeat, as each row stands for itself. The
    memory of a task is bounded by a scan partition's distinct words. Should a retried task see other rows in a partition
    than before, words that the table lacks are encoded on the spot, so results stay exact.
    """
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.spark_partition_id().alias("part"))
    special = vocabulary(path).special
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[bytes] = []
        part = 0
        for batch in batches:
            for piece in slices(batch, "t", SLICE):
                part = piece.column(2)[0].as_py()
                words, _ = split_words(piece, "t", special)
                new = [w for w in words.dictionary.to_pylist() if w not in seen]
                held += new
                seen.update(new)
                if len(held) > HELD_WORDS:  # beyond it a word may come once more
                    yield _dealt(held, part, buckets)
                    held = []
                    seen.clear()
        if held:
            yield _dealt(held, part, buckets)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for i, part in enumerate(batch.column(1).to_pylist()):
                words = _words_of(batch.column(2)[i].as_buffer())[0]
                data = _words_with(words, bpe.words(words))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int8()), pa.array([data], pa.binary())], ["part", "kind", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t", SLICE):
                data = _closed(["k", "t"], [pa.concat_arrays([c]) for c in piece.columns[:2]])
                yield pa.RecordBatch.from_arrays([piece.column(2).slice(0, 1), pa.array([1], pa.int8()), pa.array([data], pa.binary())], ["part", "kind", "data"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for i, (part, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if part != at:
                    table, at = {}, part
                data = batch.column(2)[i].as_buffer()
                if kind == 0:
                    table.update(zip(*_words_of(data)))
                    continue
                piece = _opened(data)
                words, counts = split_words(piece, "t", special)
                ids = [table.get(w) or vocabulary(path).word(w) for w in words.dictionary.to_pylist()]
                flat, ends = join_ids(words.indices.to_numpy(), ids, counts)
                yield pa.RecordBatch.from_arrays([piece.column(0), binary_array(flat.view(np.uint8), 4 * np.append(0, ends))], ["k", "ids"])

    columns = "part int, kind byte, data binary"
    words = map_batches(map_batches(source, distinct, "bucket int, part int, data binary").repartition("bucket"), encoded, columns)
    meet = words.unionByName(map_batches(source, packed, columns)).repartition("part").sortWithinPartitions("part", "kind")
    return map_batches(meet, joined, "k long, ids binary").withColumnRenamed("k", key)


def _closed(names: list[str], columns: list[pa.Array]) -> bytes:
    """Columns as one compressed value."""
    import zstandard

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names)
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _opened(data: pa.Buffer) -> pa.RecordBatch:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


def _words_with(words: list[bytes], ids: list[bytes] | None = None) -> bytes:
    """Words, and their ids if given, as one compressed value: the number of words, lengths in bytes, then what they hold.

    Ids are split into their four bytes' planes, of which the upper two are mostly nought.
    """
    import zstandard

    parts = [np.array([len(words)], "<u4").tobytes()]
    for own in (words, ids or []):
        parts += [np.fromiter(map(len, own), "<u4", len(own)).reshape(-1, 1).view(np.uint8).T.tobytes(), b"".join(own)]
    if ids:
        parts[-1] = np.frombuffer(parts[-1], np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _words_of(data: pa.Buffer) -> tuple[list[bytes], list[bytes]]:
    """What _words_with made: words and ids."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4, []
    for ids in (False, True):
        if at >= len(raw):
            out.append([])
            continue
        size = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()
        at += 4 * n
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        held = raw[at : at + int(ends[-1])]
        at += int(ends[-1])
        if ids:
            held = np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(4, -1).T).tobytes()
        out.append([held[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    return out[0], out[1]


def _dealt(words: list[bytes], part: int, buckets: int) -> pa.RecordBatch:
    """Distinct words of a partition, one value for each bucket of their hashes; in order, as that compresses well."""
    words = sorted(words)
    column = pa.array(words, pa.binary())
    t = Texts(column)
    bucket = (word_hashes(t.data, t.offsets[:-1], t.offsets[1:]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
    data = [_words_with([words[i] for i in order[a:b].tolist()]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts[:-1]]]), pa.array([part] * len(data), pa.int32()), pa.array(data, pa.binary())], ["bucket", "part", "data"])


def decode(tokens: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): texts from ids, special tokens kept.

    The id-to-piece table is bounded by the vocabulary, so the join to it is a broadcast one; as ids are dense it is an
    index into the pieces' bytes. Bytes that aren't UTF-8 become U+FFFD; null or empty ids give an empty text.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin = vocabulary(path).piece_table()
        length = np.diff(begin)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                t = Texts(part.column(1))
                own = t.data.view("<u4")
                size = length[own]
                out = data[ragged(begin[own], size)]
                ends = np.append(0, np.cumsum(size))[t.offsets >> 2]
                try:
                    out.tobytes().decode("utf-8")
                    texts = binary_array(out, ends).cast(pa.string())
                except (UnicodeDecodeError, pa.ArrowInvalid):
                    texts = pa.array([out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["k", "ids", "decoded"])

    return map_batches(tokens.select(F.col(key).alias("k"), F.col(ids).alias("ids")), pieces, "k long, ids binary, decoded string").withColumnRenamed("k", key)
