"""Exact token counts of a sentencepiece BPE vocabulary at every prefix of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.runtime import Texts, binary_array, kept, map_batches, slices

#: Entries that a worker's cache of chunks holds before it starts anew.
CACHE_CHUNKS = 300_000
MARK = "▁".encode()


class PieceBpe:
    """A sentencepiece BPE model that counts tokens chunk by chunk.

    A chunk is a run of blanks with what follows up to the next run. No piece holds a blank after another character, so
    no merge crosses the start of a chunk and the count at a chunk's end is the count at its start plus its own.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = MARK.decode()
        if any(mark in self.model.id_to_piece(i).lstrip(mark) for i in range(self.model.get_piece_size())):
            raise ValueError(f"{path} has pieces that cross words")
        if self.model.encode("a  b") == self.model.encode("a b"):
            raise ValueError(f"{path} folds blanks")
        self._cache: dict[bytes, int] = {}

    def chunk_counts(self, chunks: list[bytes]) -> np.ndarray:
        """Tokens of chunks that are given without their first blank."""
        cache = self._cache
        missing = [c for c in chunks if c not in cache]
        if missing:
            if len(cache) + len(missing) > CACHE_CHUNKS:
                cache.clear()
                missing = chunks
            for c, ids in zip(missing, self.model.encode([c.decode() for c in missing], num_threads=1)):
                cache[c] = len(ids) if c else 1
        return np.fromiter(map(cache.__getitem__, chunks), np.int64, len(chunks))

    def inner_counts(self, chunk: bytes, limit: int | None = None) -> list[int]:
        """Tokens of each prefix of a chunk (given without its first blank), by characters, from none to all, or to where no longer
        prefix can have at most limit tokens.

        best[i] is the last piece of the encoding of the first i characters: the one whose predecessor's encoding ends in a
        piece that doesn't merge with it. So the count at i is one more than the count where that piece begins.
        """
        text = MARK.decode() + chunk.decode().replace(" ", MARK.decode())
        n = len(text)
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            # a longer prefix has a token at least for each longest piece
            if limit is not None and i > 1 and (i - 1) > (limit + 1) * self.longest:
                return count[1:i]
            for a in range(max(0, i - self.longest), i):
                piece = text[a:i]
                width = self._width(piece)
                if width and (not a or self._apart(last[a], piece)):
                    count[i], last[i] = count[a] + width, piece
                    break
        return count[1:]

    @property
    def longest(self) -> int:
        """Characters of the longest piece: none that ends at a place begins further back."""
        if not hasattr(self, "_longest"):
            self._longest = max(len(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        return self._longest

    def count_at(self, text: str, chars: int) -> int:
        """Tokens of the text's first so many characters: the count where its last chunk begins and the programme inside that."""
        part = text[:chars].encode()
        ends, tokens, _ = self.prefixes(Texts(pa.array([part.decode()])))
        if not len(ends):
            return 0
        begin, before = (int(ends[-2]), int(tokens[-2])) if len(ends) > 1 else (0, 0)
        return before + self.inner_counts(_unmarked(part[begin:], begin == 0))[-1]

    def within(self, chunk: bytes, first: bool, limit: int) -> tuple[int, int]:
        """Bytes and tokens of a chunk's longest prefix of whole characters that has at most limit tokens. first: the chunk begins a text."""
        said = _unmarked(chunk, first)
        lead = len(chunk) - len(said)
        counts = self.inner_counts(said, limit)
        # counts[0] is of the blank alone, which a text's own first chunk doesn't have
        sizes = np.cumsum([lead, *(len(c.encode()) for c in said.decode())][: len(counts)])
        fit = [i for i, n in enumerate(counts) if n <= limit and not (first and i == 0)]
        return (int(sizes[fit[-1]]), counts[fit[-1]]) if fit else (0, 0)

    def _width(self, piece: str) -> int:
        """Tokens that stand for a piece: 1, or a byte's each for a character outside the vocabulary; 0 if it is none."""
        if self.model.piece_to_id(piece) != self.model.unk_id():
            return 1
        return len(piece.encode()) if len(piece) == 1 else 0

    def _apart(self, left: str, right: str) -> bool:
        """Whether the encoding of two pieces' text is these two pieces."""
        box = kept("apart", dict)
        if len(box) > CACHE_CHUNKS:
            box.clear()
        if (left, right) not in box:
            whole = self.model.encode_as_pieces((left + right).removeprefix(MARK.decode())) if (left + right).startswith(MARK.decode()) else self.model.encode_as_pieces("\n" + left + right)[2:]
            want = [p for x in (left, right) for p in ([x] if self.model.piece_to_id(x) != self.model.unk_id() else [f"<0x{b:02X}>" for b in x.encode()])]
            box[left, right] = whole == want
        return box[left, right]

    def prefixes(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every chunk the byte where it ends and the tokens of its document up to there; and each document's chunks."""
        begin, skip, counts = _chunks(t)
        n = len(begin)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
        ends = np.append(begin[1:], len(t.data))
        # a word's bytes without the first blank: an Arrow array has no gaps, so blanks are taken out of the data
        keep = np.ones(len(t.data), bool)
        gap = begin[skip > 0]
        for i in range(3):
            wide = gap[skip[skip > 0] > i]
            keep[wide + i] = False
        offsets = np.append(0, np.cumsum(ends - begin - skip))
        words = binary_array(t.data[keep], offsets).dictionary_encode()
        own = self.chunk_counts(words.dictionary.to_pylist())[words.indices.to_numpy()]
        total = np.cumsum(own)
        first = np.cumsum(counts) - counts
        base = np.repeat((total - own)[np.minimum(first, n - 1)], counts)
        return ends - np.repeat(t.offsets[:-1], counts), total - base, counts


def _unmarked(chunk: bytes, first: bool) -> bytes:
    """A chunk without its first blank; a text's own first chunk has none, as sentencepiece puts one there."""
    return chunk if first else chunk[1:] if chunk[:1] == b" " else chunk[len(MARK) :]


def _chunks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = t.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(t.n, np.int64)
    size = np.zeros(n, np.int8)  # bytes of the blank that begins here
    size[data == 32] = 1
    wide = np.flatnonzero((data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])) if n > 2 else np.zeros(0, np.int64)
    inside = size > 0
    if len(wide):
        size[wide] = 3
        inside = inside.copy()
        for i in range(3):
            inside[wide + i] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (size[1:] > 0) & ~inside[:-1]
    edge = t.offsets[:-1][np.diff(t.offsets) > 0]
    # a document's own start is a chunk's start, with the blank that sentencepiece puts there and that takes no byte
    start[edge] = True
    begin = np.flatnonzero(start)
    skip = size[begin].astype(np.int64)
    skip[np.isin(begin, edge, assume_unique=True)] = 0
    return begin, skip, np.diff(np.searchsorted(begin, t.offsets))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, prefixes: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, cut_bytes, cut_tokens[, prefix_bytes, prefix_tokens]) of each whole text.

    prefix_tokens[i] is the exact token count of the text's first prefix_bytes[i] bytes, for every prefix that ends with a
    chunk. cut_* is the longest prefix of whole characters within limit: up to the chunk where the budget ends by these
    counts, inside it by the programme over its prefixes; PieceBpe.count_at answers any prefix so. Null and
    empty texts have no tokens; each row stands for itself, so keys may be null or repeat. No shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(f"pieces:{path}", lambda: PieceBpe(path))
        for batch in batches:
            for part in slices(batch, "t"):
                t = Texts(part.column(1))
                ends, tokens, counts = model.prefixes(t)
                upto = np.append(0, np.cumsum(counts))
                some = counts > 0
                total = np.zeros(t.n, np.int64)
                total[some] = tokens[upto[1:][some] - 1]
                within = np.append(0, np.cumsum(tokens <= limit))
                fit = within[upto[1:]] - within[upto[:-1]]
                cut_b, cut_t = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
                at = (upto[:-1] + fit - 1)[fit > 0]
                cut_b[fit > 0], cut_t[fit > 0] = ends[at], tokens[at]
                for i in np.flatnonzero(fit < counts).tolist():
                    # the budget ends inside the next chunk
                    data = t.bytes_of(i)[cut_b[i] : ends[upto[i] + fit[i]]]
                    b, n = model.within(data, not fit[i], limit - int(cut_t[i]))
                    cut_b[i] += b
                    cut_t[i] += n
                cols = [part.column(0), pa.array(np.diff(t.offsets)), pa.array(total), pa.array(cut_b), pa.array(cut_t)]
                if prefixes:
                    off = pa.array(upto.astype(np.int32))
                    cols += [pa.ListArray.from_arrays(off, pa.array(ends)), pa.ListArray.from_arrays(off, pa.array(tokens))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "n_bytes", "n_tokens", "cut_bytes", "cut_tokens", "prefix_bytes", "prefix_tokens"][: len(cols)])

    schema = "k long, n_bytes long, n_tokens long, cut_bytes long, cut_tokens long" + ", prefix_bytes array<long>, prefix_tokens array<long>" * prefixes
    return map_batches(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), counted, schema).withColumnRenamed("k", key)
