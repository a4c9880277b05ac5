"""Sampled SentencePiece segmentations that can be drawn again, and their exact decoding.

A text is cut before each space that follows another character and around each line end; no piece used here crosses
such a cut.  Over the pieces that spell a part, forward filtering sums the probability of all segmentations up to each
character, and backward sampling draws one from its end.  Piece probabilities follow the model's merge order (Zipf in
the rank, to the power `sharpness`).  Draws hash (seed, row key, place in the text), so a row's segmentation does not
depend on partitions, batches or retries.

Spaces are spelled by the vocabulary's mark; characters without a piece, and real U+2581, by their UTF-8 bytes.  There
is no normalisation and no added space, so decoding gives back every text exactly.

Defined cases: null text gives null ids; empty text an empty list; null keys hash as one fixed key; repeated rows with
equal key get equal ids; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.lattice import _ALIEN, SPACE_MARK, Lattice, Vocabulary
from clausemill.llm.shared import small_batches
from clausemill.llm.words import mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_SLICE = 3 << 19


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Parts of the texts in order: the text of each, its number among different parts, and the different parts."""
    texts = pc.fill_null(texts, "")
    counts = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in texts), np.uint8)
    if not len(data):
        return np.empty(0, int), np.empty(0, int), []
    begin = (np.cumsum(counts) - counts)[counts > 0]
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20) | (data[1:] == 0x0A) | (data[:-1] == 0x0A)
    cut[begin] = True
    at = np.flatnonzero(cut)
    flat = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    coded = flat.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), counts)[at]
    return owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _utf8(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of characters: a column for each of up to four bytes, and how many count."""
    c = np.where(chars == _ALIEN, SPACE_MARK, chars)
    n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    tail = [0x80 | (c >> s & 0x3F) for s in (18, 12, 6, 0)]
    rows = np.stack(tail, axis=1)
    lead = np.choose(n - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    rows[np.arange(len(c)), 4 - n] = lead
    return rows, n


def encode_batch(vocabulary: Vocabulary, log_p: np.ndarray, texts: pa.Array, seeds: np.ndarray) -> pa.ListArray:
    owner, which, different = parts(texts)
    if not len(owner):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
    lattice = Lattice(vocabulary, different)
    size = lattice.sizes[which]
    run = np.cumsum(size) - size
    lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    place = run - np.repeat(run[lead], np.diff(np.append(lead, len(owner))))
    at, edge = lattice.sample(log_p, which, seeds[owner], place)
    row = np.repeat(owner, size)[at]
    ids = lattice.piece[edge]
    bare = np.flatnonzero(ids == -1)
    string = np.searchsorted(lattice.base, lattice.start[edge[bare]], side="right") - 1
    spelled, n = _utf8(lattice.chars[lattice.start[edge[bare]] - string])
    times = np.ones(len(ids), np.int64)
    times[bare] = n
    out = np.repeat(ids, times)
    if len(bare):
        first = (np.cumsum(times) - times)[bare]
        for k in range(4):
            on = n > k
            out[first[on] + k] = vocabulary.byte_ids[spelled[on, (4 - n[on]) + k]]
    counts = np.bincount(np.repeat(row, times), minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(out.astype(np.int32)))


def spellings(vocabulary: Vocabulary) -> pa.Array:
    """What each id stands for, in bytes."""
    plain = [b"" if x is None else x.replace(chr(SPACE_MARK), " ").encode() for x in vocabulary.pieces]
    for value, number in enumerate(vocabulary.byte_ids.tolist()):
        plain[number] = bytes([value])
    return pa.array(plain, pa.binary())


def decode_batch(spelled: pa.Array, ids: pa.ListArray) -> pa.Array:
    flat = spelled.take(ids.flatten())
    offsets = ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat), b"").cast(pa.string())


def _seeds(keys: pa.Array, seed: int) -> np.ndarray:
    values = pc.fill_null(keys, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    return mix(values, seed * 0x9E3779B97F4A7C15 + 1)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = 1.0, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text by default), then n_pieces, token_ids and lossless (decoding gives the text).

    The key is id_col as a long, or the hash of its string.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    vocabulary = Vocabulary.from_model(model)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.zipf(sharpness), spellings(vocabulary)))
    key = F.col(f"`{id_col}`")
    key = key.cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(key.cast("string"))
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField("n_pieces", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p, spelled = shared.value
        for batch in slices(batches, "text", _SLICE):
            texts = batch.column("text")
            ids = encode_batch(vocabulary, log_p, texts, _seeds(batch.column("key"), seed))
            same = pc.equal(decode_batch(spelled, ids), pc.fill_null(texts, ""))
            counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            none = texts.is_null()
            if none.null_count or pc.any(none).as_py():
                ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=none)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(counts), ids, same], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*keep, "n_pieces", "token_ids", "lossless")


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """All columns, and the text that the ids in ids_col spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(spellings(Vocabulary.from_model(model)))
    n = len(encoded.columns)
    inner = encoded.toDF(*(f"c{k}" for k in range(n)))
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*inner.schema.fields, T.StructField("out", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            text = decode_batch(shared.value, pa.array(ids.to_pylist(), pa.list_(pa.int32())) if ids.null_count else ids)
            if ids.null_count:
                text = pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), text], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*encoded.columns, out_col)
