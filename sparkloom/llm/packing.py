"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token ids, projected to a few
dimensions and keyed by its place on a Hilbert curve. Documents are range-sorted
by that key, laid end to end, and cut every `width` ids, so that neighbours on
the curve share sequences and only the last sequence is short.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, small_batches, written

WIDTH, END = 4096, 2
#: Hashed vector, dimensions of the curve and bits of each.
BUCKETS, DIMS, BITS = 256, 4, 10
#: Words that a worker remembers; bytes of the texts it tokenises at once (a longer text goes alone).
TABLE_WORDS, CHARS = 200_000, 1 << 21

SPACE, LETTER, DIGIT, OTHER = range(4)


def _kinds() -> np.ndarray:
    """By Latin-1 character, what the public 49k tokenizer's split pattern takes it for."""
    t = np.full(256, OTHER, np.uint8)
    for c in range(256):
        kind = unicodedata.category(chr(c))[0]
        t[c] = SPACE if chr(c).isspace() and c not in range(0x1C, 0x20) else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return t


def _byte_names() -> dict[int, int]:
    """The character that byte-level models write for each byte: itself if visible, else one from 256 up, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
_KINDS, _NAMES = _kinds(), _byte_names()
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


def split_words(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the words of lower-cased Latin-1 text, as the pattern

    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+

    finds them. A word begins where the kind of character changes, and digits
    stand alone; a quote that begins a word takes the letters of the first
    alternatives with it.
    """
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _KINDS[low]
    start = np.ones(len(low) + 1, bool)
    start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((low == ord("'")) & start[:-1])
    if len(quote):
        after = np.append(low, np.zeros(2, np.uint8))
        a, b = after[quote + 1], after[quote + 2]
        taken = np.isin(a, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        taken += 2 * (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        quote, taken = quote[taken > 0], taken[taken > 0]
        start[quote + 1] = False
        start[quote + 1 + taken] = True
    full = kind != SPACE
    first = np.flatnonzero(start[:-1] & full)
    return first, np.flatnonzero(start[1:] & full) + 1 - first


class WordTokenizer:
    """Ids of whole texts as the library gives them, from a table of distinct words.

    The model splits a text into words before it merges, so a text's ids are its
    words' ids in order. Texts within Latin-1 are split here, many at a time
    (their characters are stable under NFC, and both sides agree on letters and
    digits there), and the library's model merges each new word; texts with other
    characters or with the string of a special token go to the library whole.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.model = self.tk.model
        assert self.tk.get_vocab_size() <= 1 << 16
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tk.get_added_tokens_decoder().values()).encode() or b"(?!)")
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}  # row of a lower-cased word
        self.flat, self.ends = array("H"), array("q", [0])  # ids of all rows, and where each row's begin

    def _learn(self, words: list[bytes]) -> None:
        merge, table, flat, ends = self.model.tokenize, self.table, self.flat, self.ends
        for w in words:
            s = w.decode("latin-1")
            if not (s.isascii() and s.isprintable()):
                s = s.encode().decode("latin-1").translate(_NAMES)
            flat.extend([t.id for t in merge(s)])
            table[w] = len(ends) - 1
            ends.append(len(flat))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.table]
        if new and len(self.table) + len(new) > self.limit:
            self._clear()
            new = words
        self._learn(new)
        return np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))

    def run(self, texts: list[str | None], end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, each text's followed by `end`; and where each text's ids begin, and the last's end. Null counts as empty."""
        raw, whole = [], {}
        for k, t in enumerate(texts):
            try:
                r = t.encode("latin-1") if t else b""
            except UnicodeEncodeError:
                r = None
            if r is None or (b"<" in r and self.special.search(r)):
                whole[k], r = self.tk.encode(t, add_special_tokens=False).ids, b""
            raw.append(r)
        low = _LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
        first, size = split_words(low)
        bytes_, places = low[_KINDS[low] != SPACE], np.append(0, np.cumsum(size)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(bytes_)]).dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        # Ids of texts encoded whole, then the end id, stand as further rows behind each text's words
        extra = np.fromiter((i for ids in whole.values() for i in ids), np.uint16)
        flat = np.concatenate([np.frombuffer(self.flat, np.uint16) if self.flat else np.empty(0, np.uint16), extra, np.array([end], np.uint16)])
        ends = np.concatenate([np.frombuffer(self.ends, np.int64), len(self.flat) + np.cumsum([*map(len, whole.values()), 1])]).astype(np.int64)
        n, k = len(self.ends) - 1, len(whole)
        upto = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]))
        added = np.full((len(raw), 2), n + k)
        added[list(whole), 0] = np.arange(n, n + k)
        both = np.ones((len(raw), 2), bool)
        both[:, 0] = np.isin(np.arange(len(raw)), list(whole))
        rows = np.insert(rows, np.repeat(upto, both.sum(1)), added[both])
        count = (ends[1:] - ends[:-1])[rows]
        before = np.cumsum(count) - count
        ids = flat[np.repeat(ends[rows] - before, count) + np.arange(int(count.sum()))]
        closing = np.flatnonzero(rows == n + k)
        return ids, np.append(0, before[closing] + 1)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (rows: points)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the excess work of the inverse rotation
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(up, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, BUCKETS, 1 << 16), r.choice([-1.0, 1.0], 1 << 16), r.standard_normal((BUCKETS, DIMS))


def _keys(ids: np.ndarray, begins: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    bucket, sign, matrix = table
    n = len(begins) - 1
    cells = np.repeat(np.arange(n) * BUCKETS, np.diff(begins)) + bucket[ids]
    vectors = np.bincount(cells, weights=sign[ids], minlength=n * BUCKETS).reshape(n, BUCKETS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    spread = (vectors @ matrix) / 3.0  # a unit vector's projection is standard normal
    return hilbert_key(np.clip((spread + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _tokenised(docs: DataFrame, path: str | None, id_col: str, text_col: str, end: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tk, table = tokenizer(path or public_tokenizers.path("word_bpe_49k.json")), _projection()
        for b in batches:
            at = 0
            for texts in slices(b.column(1), CHARS):
                ids, begins = tk.run(texts.to_pylist(), end)
                blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((begins * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                own = b.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(begins), pa.int64()), pa.array(_keys(ids, begins, table), pa.int64()), blobs], names=[id_col, "doc_tokens", "curve_key", "ids"])

    return docs.select(id_col, text_col).mapInArrow(frugal(work), f"`{id_col}` {kind}, doc_tokens bigint, curve_key bigint, ids binary").withColumn("row", F.monotonically_increasing_id())


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0
    for b in batches:
        upto = b["doc_tokens"].cumsum() + total
        if len(b):
            yield pd.DataFrame({"row": b["row"], "part": b["part"], "before": upto - b["doc_tokens"], "upto": upto})
            total = int(upto.iloc[-1])


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of documents, laid along the curve and cut every `width` ids.

    Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with_ids also ids (array<int>). Every document ends with the id `end`, so
    null and empty texts give one piece of one id. Ties on the curve are ordered
    by id, then by row; rows that repeat an id, and null ids, are documents of
    their own. No rows give no pieces. Sequences are full but for the last.

    Ids are tokenised once and written to the shared folder. Only (row, key,
    length) is sorted; the driver gets one sum for each sorted partition, and ids
    are shuffled once, evenly, by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name, docs = id_col, docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    id_col, text_col = "__id", "__text"  # clash with nothing
    table = written(_tokenised(docs, path, id_col, text_col, end), "tokens")
    order = table.select("row", id_col, "curve_key", "doc_tokens").repartitionByRange("curve_key", id_col, "row").sortWithinPartitions("curve_key", id_col, "row")
    run = written(order.withColumn("part", F.spark_partition_id()).select("row", "part", "doc_tokens").mapInPandas(_running, "row bigint, part int, before bigint, upto bigint"), "order")
    sums = sorted((r["part"], r["n"]) for r in run.groupBy("part").agg(F.max("upto").alias("n")).collect())
    shift, total = [], 0
    for part, n in sums:
        shift.append((part, total))
        total += n
    shifts = spark.createDataFrame(shift, "part int, shift bigint")
    begins = run.join(F.broadcast(shifts), "part").select("row", (F.col("before") + F.col("shift")).alias("begin"))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for b in batches:
            at, rows, pieces = [], [], []
            for k, (ids, begin) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                a, n, start = np.frombuffer(ids, "<u2").astype("<u4"), len(ids) // 2, 0
                while start < n:
                    seq, off = divmod(begin + start, width)
                    size = min(width - off, n - start)
                    piece = a[start : start + size]
                    at.append(k)
                    rows.append((start, size, zlib.crc32(piece.tobytes()), n, seq, off))
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                    start += size
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols, *([pa.array(pieces, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    joined = table.select("row", id_col, "ids").join(begins, "row").select(id_col, "ids", "begin")
    return joined.mapInArrow(frugal(work), f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids).withColumnRenamed(id_col, name)
