"""SentencePiece encoding and decoding through a table of distinct chunks.

With an identity normaliser, a dummy prefix and no piece that holds a marker
(U+2581) after another character, no piece can cross the place where a run of
markers begins. A text is then a sequence of chunks (a run of markers and what
follows it), and its ids are the chunks' ids in order. Each task keeps a table
of the distinct chunks it has met: the library segments and decodes a chunk
once, and texts are put together from the table by position. The table has a
bound, so memory doesn't grow with the input; a global table would have to
shuffle every word of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
#: Chunks remembered by a Python worker.
TABLE_CHUNKS = 600_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_CODECS: dict[str, "Codec"] = {}


class Codec:
    """Encodes exactly as the library does; whole texts go to the library if the model doesn't allow chunks."""

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, pieces = spec.normalizer_spec, [p.piece for p in spec.pieces]
        kinds = {p.type for p in spec.pieces}
        self.by_chunk = (
            norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
            and kinds <= {1, 2, 3, 6} and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        )
        self.end, self.mark, self.limit = self.sp.eos_id(), self.sp.piece_to_id(MARK), limit
        self.ids: dict[str, str] = {}  # of a chunk without its first marker: ids as decimal text
        self.texts: dict[str, str] = {}  # and what they decode to, without the first blank

    def _learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            self.texts.clear()
            new = list(chunks)
        found = self.sp.encode(new, num_threads=1)
        for c, ids, text in zip(new, found, self.sp.decode(found, num_threads=1), strict=True):
            if c:
                self.ids[c], self.texts[c] = " ".join(map(str, ids)), text
            else:
                self.ids[c], self.texts[c] = str(self.mark), ""

    def _chunks(self, text: str) -> list[str]:
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def run(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """(decimal ids with the end id, joined by a blank; decoded text) of each text; null counts as empty."""
        if not self.by_chunk:
            out = []
            for t in texts:
                ids = self.sp.encode(t or "", num_threads=1) + [self.end]
                out.append((" ".join(map(str, ids)), self.sp.decode(ids)))
            return out
        split = [self._chunks(t) if t else [] for t in texts]
        out, at = [], 0
        while at < len(split):  # so many texts at a time that their chunks fit the table
            upto, chunks = at, set()
            while upto < len(split) and (upto == at or len(chunks) < self.limit // 4):
                chunks.update(split[upto])
                upto += 1
            self._learn(chunks)
            ids, text = self.ids.__getitem__, self.texts.__getitem__
            for c in split[at:upto]:
                out.append((" ".join(map(ids, c)) + (" " if c else "") + str(self.end), " ".join(map(text, c))))
            at = upto
        return out


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array<int>, with the end id), decoded (string).

    Null and empty texts give the end id alone and an empty decoded text. Rows
    are kept one for one, repeated and null ids included; other columns are
    dropped. model: a path that every executor can open; by default the public
    32k model, looked up on the executor.
    """
    return _run(docs, model, id_col, text_col, False)


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of what encode_decode returns, without shipping it to the JVM."""
    return _run(docs, model, id_col, text_col, True)


def _run(docs: DataFrame, model: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(model or public_tokenizers.path("piece_bpe_32k.model"))
        for b in batches:
            done = c.run(b.column(1).to_pylist())
            if digest:
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                cols = [pa.array([i.count(" ") + 1 for i, _ in done], pa.int64()), pa.array([sha(i) for i, _ in done], pa.string()), pa.array([sha(t) for _, t in done], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([[int(x) for x in i.split(" ")] for i, _ in done], pa.list_(pa.int32())), pa.array([t for _, t in done], pa.string())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(work, schema)
