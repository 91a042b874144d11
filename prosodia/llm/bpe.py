"""Byte-level BPE through a sentencepiece model serialised from the ranks."""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.pretokens import Once, parts, splitter
from prosodia.llm.shared import lean, process_store, utf8


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is a visible Latin-1 character, else one past U+00FF."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


def model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with the byte-mapped tokens as pieces, scored by negative rank, identity normalisation.

    The unknown piece comes last, so a piece's id is its rank. Scores are single floats, exact up to 2**24 ranks.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = pb.TrainerSpec.BPE
    proto.trainer_spec.vocab_size = len(tokens) + 1
    proto.trainer_spec.unk_id = len(tokens)
    proto.trainer_spec.bos_id = proto.trainer_spec.eos_id = proto.trainer_spec.pad_id = -1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.precompiled_charsmap = b""
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = False
    for rank, token in enumerate(tokens):
        proto.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    proto.pieces.add(piece="", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    return proto.SerializeToString()


class Codec:
    """Encoding of pre-tokens and decoding of ids, for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = load_ranks(path)
        self.processor = SentencePieceProcessor(model_proto=model(self.tokens))
        self.letters = dict(enumerate(byte_letters()))
        self.split = splitter(pattern)
        self.once = Once(self._encode)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def _encode(self, pretokens: list[str]) -> list[bytes]:
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in pretokens]
        return [array.array("I", ids).tobytes() for ids in self.processor.encode(mapped, num_threads=1)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        for part in parts(map(self.split, texts)):
            known = self.once.learn(p for found in part for p in found)
            for found in part:
                yield b"".join([known[p] for p in found])

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(ids), 1 << 17):
            part = ids[at : at + (1 << 17)]
            size = self.size[part]
            ends = np.cumsum(size)
            shift = np.repeat(self.start[part] - (ends - size), size)
            out.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return process_store(("codec", path, pattern), lambda: Codec(path, pattern))


def round_trips(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): one row per input row.

    Each match of ``pattern`` is encoded separately, once for each distinct one that a worker meets; the ids are then
    decoded by the inverse mapping and compared with the text (``exact``). ``with_ids`` adds the ids themselves as
    ``ids``. Null counts as empty. Repeated rows come out as often as they came in, null ids too; very long texts are
    encoded whole. An empty table gives no rows. ``path`` is opened on the executors. Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            texts = [text or b"" for text in utf8(batch.column(1))]
            for text, ids in zip(texts, coder.encode_all(map(bytes.decode, texts)), strict=True):
                back = coder.decode(ids)
                row = (len(ids) // 4, sha(ids), sha(back), back == text, np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())][: 4 + with_ids]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.name for f in fields])

    fields = [
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("exact", T.BooleanType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), T.StructType(fields))
