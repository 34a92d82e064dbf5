"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the vocabulary holds a whitespace marker after another character, no merge can cross
from a word to the marker of the next one, so a text splits into marked words that can be segmented one
by one.  Every worker keeps a table of the distinct marked words it has met, each segmented once by the library and
decoded once by its ``decode(ids)``; a text's ids are those of its words, joined by position.  Every word begins with a
piece that is a marker, so a text decodes to its words' decoded texts one after another; only texts with a word that
does not decode to itself (unknown characters) are decoded as a whole.  The table is bounded by ``TABLE_CHARS`` and
starts anew beyond it, so memory doesn't depend on the corpus, and no word is ever shuffled.  One table for all tasks would
need every word of every text sent twice, or a table that grows with the corpus in each worker.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts of
any length are handled whole; repeated rows are kept; an empty table gives an empty result.  The columns
``out_ids`` and ``out_text`` replace columns of the same name, all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
TABLE_CHARS = 1 << 22
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """Encodes and decodes exactly as the library's ``encode`` and ``decode(ids)`` do."""

    def __init__(self, model_file: str, table_chars: int = TABLE_CHARS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = proto.ModelProto()
        spec.ParseFromString(self.sp.serialized_model_proto())
        norm = spec.normalizer_spec
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.by_chunk = (
            norm.name == "identity"
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(crossing.search(p.piece) for p in spec.pieces)
            and not any(p.type == 4 for p in spec.pieces)  # user-defined symbols are matched before the merges
        )
        self.mark = self.sp.piece_to_id(MARK)
        self.by_chunk = self.by_chunk and self.mark != self.sp.unk_id()
        # what each piece stands for, in bytes of the text; an unknown character fits no count and takes the slower way
        self.bytes_of = np.array([1 if p.type == 6 else 1 << 40 if p.type == 2 else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.table: dict[str, bytes] = {}
        self.odd: set[str] = set()  # chunks of the table that don't decode to themselves
        self.size, self.most = 0, table_chars

    def encode(self, text: str) -> np.ndarray:
        return self.both(text)[0]

    def both(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, and the text that they decode to."""
        if not text:
            return np.zeros(0, np.int32), ""
        if not self.by_chunk:
            ids = self.sp.encode(text)
            return np.array(ids, np.int32), self.sp.decode(ids)
        chunks = _CHUNK.findall(" " + text)
        own, table = set(chunks), self.table
        missing = own.difference(table)
        if missing:
            if self.size > self.most:
                table.clear()
                self.odd.clear()
                self.size, missing = 0, own
            self._segment(list(missing))
        ids = np.frombuffer(b"".join(map(table.__getitem__, chunks)), np.int32)
        return ids, text.replace(MARK, " ") if self.odd.isdisjoint(own) else self.decode(ids)

    def _segment(self, chunks: list[str]) -> None:
        """Segments new chunks as one text, as no piece crosses from one to the next; bytes tell where each ends."""
        text = "".join(chunks)
        if len(text) > 1:
            found = self.sp.encode(text[1:])  # the library puts a marker before a text
            ids = np.array(found, np.int32)
            size = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(c.encode()) + 2 * c.count(" ") for c in chunks])
            cut = np.searchsorted(size, ends) + 1
            if cut[-1] == len(ids) and (size[cut - 1] == ends).all() and self.sp.decode(found) == text[1:].replace(MARK, " "):
                raw, cut = ids.tobytes(), (cut * 4).tolist()
                for chunk, lo, hi in zip(chunks, [0, *cut], cut):
                    self.table[chunk] = raw[lo:hi]
                    self.size += len(chunk) + 8
                return
        # a lone marker is the library's prefix of an empty text, which it would leave out
        found = [ids if len(chunk) > 1 else [self.mark] for chunk, ids in zip(chunks, self.sp.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        for chunk, ids, back in zip(chunks, found, self.sp.decode(found), strict=True):
            self.table[chunk] = np.array(ids, np.int32).tobytes()
            self.size += len(chunk) + 8
            if back != chunk[1:].replace(MARK, " "):
                self.odd.add(chunk)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist()) if len(ids) else ""


_CODECS: dict[str, ChunkCodec] = {}


def codec(model_file: str) -> ChunkCodec:
    """One codec in a worker process for all its tasks."""
    if model_file not in _CODECS:
        _CODECS[model_file] = ChunkCodec(model_file)
    return _CODECS[model_file]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_decode(
    docs: DataFrame, model_file: str | None = None, text: str = "text", out_ids: str = "ids", out_text: str = "decoded"
) -> DataFrame:
    """``docs`` with the ids of each text (array<int>) and the text that they decode to."""
    model_file = model_file or default_model()
    own = docs.drop(out_ids, out_text)
    schema = T.StructType(
        [*own.schema.fields, T.StructField(out_ids, T.ArrayType(T.IntegerType())), T.StructField(out_text, T.StringType())]
    )
    at = own.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for start, texts in common.blocks(batch.column(at).to_pylist(), 1 << 21):
                ids, back = zip(*map(c.both, texts))
                cols = batch.slice(start, len(texts)).columns
                yield pa.RecordBatch.from_arrays([*cols, _lists(list(ids)), pa.array(back, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
