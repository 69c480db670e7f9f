"""What the operators share: the shared folder, written tables, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Most bytes of an Arrow batch handed to Python (a longer row goes alone).
BATCH_BYTES = 1 << 22
#: Bytes of texts whose words are worked on at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only in local mode, where there is one machine, a folder of our own stands in
    for an unset one.
    """
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="sparkloom-")
    return "file://" + _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and each row is computed once.

    The table stays until the folder is cleared, since results are lazy and may
    read it later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch. Plans are lazy, so the session keeps the setting; a lower one of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key).rstrip("b")
    if not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, after which a Python worker, which lives on, gives free memory back to the machine."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The column in slices of `size` bytes or one text at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, end - at)
        at = end


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df with columns under names that clash with nothing, the new name of each, and what gives the old ones back."""
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names, [F.col(n).alias(c) for c, n in names.items()]


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, as UTF-8; no words for null."""
    return text.encode().lower().split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    m = np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * m
    h = (h ^ (h >> np.uint64(32))) * m
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; all words as one shingle if fewer than k."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(_runs(a, min(k, len(a))))


_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32  # A-Z
_BLANK = np.isin(np.arange(256), [0x20, *range(9, 14)])


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words that lower_words gives of each text of a column, one text after another; and where each text's begin, and the end."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    low, full = _BYTES[data], ~_BLANK[data]
    begins = np.zeros(len(data) + 1, bool)  # of runs of blanks or of others; a text ends a run
    begins[1:-1] = full[1:] != full[:-1]
    begins[ends] = True
    first = np.flatnonzero(begins[:-1] & full)
    size = np.flatnonzero(begins[1:] & full) + 1 - first
    places = np.append(0, np.cumsum(size))
    coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(low[full])]).dictionary_encode()
    return coded, np.searchsorted(first, ends)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """shingle_hashes of each text of a column; words are split, coded and hashed for SLICE_BYTES of it at once."""
    for some in slices(texts, SLICE_BYTES):
        yield from _shingle_sets(some, k)


def _shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    coded, begins = words_of(texts)
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    a = known[coded.indices.to_numpy()]
    whole = _runs(a, k)
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if end - start >= k:
            h = np.sort(whole[start : end - k + 1])
            fresh = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=fresh[1:])
            yield h[fresh]
        else:
            yield _runs(a[start:end], end - start)


def _runs(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes."""
    size = len(a) - n + 1
    if n < 1 or size < 1:
        return np.empty(0, np.uint64)
    h = np.full(size, np.uint64(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[j : j + size])
    return h


def set_print(hashes: np.ndarray) -> int:
    """A signed 64-bit print of a sorted set of hashes and its size."""
    h = xxhash.xxh64_intdigest(hashes.tobytes(), seed=len(hashes))
    return h - (1 << 64) if h >= 1 << 63 else h


