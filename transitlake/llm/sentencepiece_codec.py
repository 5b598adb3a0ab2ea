"""Operator 1: SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model joins a non-marker character to a following whitespace
marker, so a text falls into chunks, each a run of markers with the characters
up to the next marker, and no merge crosses a chunk's edge.  Each task keeps a
table of distinct chunks: a chunk is segmented once by the sentencepiece
library and its ids (and their decoded text) are joined back by position.  The
same holds for a newline, which no piece contains (both are checked when the
model is loaded; a model that fails the check is refused).

The table is bounded by ``max_entries``; when full it is started anew, which
costs a second segmentation of a chunk and changes no result.  It is held per
task because a corpus-wide table would need every position shuffled (several
times the input), while segmenting is only a small part of the work.

Rows: null or empty texts give only the begin and end ids (or none) and an
empty decoded text; repeated rows each give a row; other columns are carried
only where asked for.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from transitlake.llm.common import documents, map_texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_CODECS: dict = {}


class ChunkCodec:
    """Distinct-chunk table over one model file (one per Python worker)."""

    def __init__(self, model_file: str, max_entries: int):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        normal = [p.piece for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in normal):
            raise ValueError("pieces of this model cross whitespace markers or newlines")
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces) \
                or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("chunks need a model with identity normalisation and no user-defined pieces")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False  # chunks carry their own marker
        self.sp = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.max_entries = max_entries
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > self.max_entries:
            self.ids, self.texts = {}, {}
            new = list(chunks)
        encoded = self.sp.encode(new, num_threads=1)
        for chunk, ids, decoded in zip(new, encoded, self.sp.decode(encoded, num_threads=1)):
            self.ids[chunk] = np.asarray(ids, "<u4").tobytes()
            if decoded != chunk.replace(MARK, " "):
                self.texts[chunk] = decoded  # only where decoding differs

    def slice(self, texts: list[str], begin_end: bool) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian 32-bit) and decoded text of each text."""
        split = [CHUNK.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*split))
        head, tail = (np.asarray([i], "<u4").tobytes() for i in (self.bos, self.eos))
        if not begin_end:
            head = tail = b""
        look, cut = self.ids.__getitem__, len(self.prefix)
        ids = [head + b"".join(map(look, s)) + tail for s in split]
        if self.texts:
            get = self.texts.get
            decoded = ["".join([get(c, c) for c in s]) for s in split]
        else:
            decoded = ["".join(s) for s in split]
        return ids, [d.replace(MARK, " ")[cut:] for d in decoded]


def _codec(model_file: str, max_entries: int) -> ChunkCodec:
    key = (model_file, max_entries)
    if key not in _CODECS:
        _CODECS[key] = ChunkCodec(model_file, max_entries)
    return _CODECS[key]


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                  begin_end: bool = True, max_entries: int = 150_000, carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, token_ids array<int>, decoded string."""

    def run(texts):
        ids, decoded = _codec(model_file, max_entries).slice(texts, begin_end)
        sizes = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
        flat = np.frombuffer(b"".join(ids), "<i4")
        return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(decoded, pa.string())]

    return map_texts(df, id_col, text_col, "token_ids array<int>, decoded string", run, carry)


def digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
            max_entries: int = 150_000) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_chars: what encode_decode
    makes, digested where it is made so that no ids leave the task."""

    def run(texts):
        ids, decoded = _codec(model_file, max_entries).slice(texts, True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]),
                pa.array([sha(x.encode()) for x in decoded]), pa.array([len(x) for x in decoded], pa.int64())]

    return map_texts(df, id_col, text_col,
                     "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long", run)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), model_path())


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE: dict[str, str] = {}
