"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import wordhash as W
from leafmill.llm.lattice import Pieces, sample
from leafmill.llm.tables import column, map_batches, spread, unused

#: Weight of a byte piece against the pieces' 1 / (rank + FLAT).
BYTE_CHANCE, FLAT = 1e-9, 30.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def rank_chances(pieces: Pieces, theta: float = 1.0) -> np.ndarray:
    """[pieces + 1, 1]: Zipf's rule over the order of the vocabulary, to the power theta; byte pieces are a last resort."""
    rank = np.arange(len(pieces.spelling))
    chance = (1.0 / (rank - 259 + FLAT).clip(min=1.0)) ** theta / np.log(len(rank))
    chance[:259] = BYTE_CHANCE
    return np.append(chance, 0.0)[:, None]


def padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) with a space before each row that isn't empty."""
    filled = np.diff(offsets) > 0
    out = np.concatenate([[0], np.cumsum(filled)]) + offsets
    return out, np.insert(data, offsets[:-1][filled], 32)


def segments(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that no piece reaches across: each begins with a row (`rows`, positions), with a run of spaces, or
    is a line break or begins behind one. Together they are all of the bytes."""
    opens = (data == 32) | (data == 10)
    opens[1:] &= (data[1:] == 10) | (data[:-1] != 32)
    opens[1:] |= data[:-1] == 10
    opens[rows] = True
    start = np.flatnonzero(opens)
    return start, np.append(start[1:], len(data)).astype(np.int64)


class Coder:
    """Encodes and decodes rows of bytes; holds the vocabulary and its chances."""

    def __init__(self, pieces: Pieces, theta: float = 1.0):
        self.pieces, self.chances = pieces, rank_chances(pieces, theta)

    def encode(self, offsets: np.ndarray, data: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each row, ids)."""
        rows = len(offsets) - 1
        at, raw = padded(offsets, data)
        start, end = self.pieces.split(raw, *segments(raw, at[:-1][np.diff(at) > 0]))
        row = np.searchsorted(at, start, side="right") - 1
        token = np.arange(len(row)) - np.searchsorted(row, row)
        counts, ids = sample(self.pieces, self.chances, raw, start, end, seeds[row], token)
        return np.bincount(row, weights=counts, minlength=rows).astype(np.int64), ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.spelling.__getitem__, ids))[1:]


def _encoder(coder, into: str, text: str):
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            offsets, data = W.column_bytes(batch.column(at))
            seeds = W.mix(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            for lo, hi in W.blocks(batch.num_rows, offsets, W.MB):
                mine, raw = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                counts, ids = coder.value.encode(mine, raw, seeds[lo:hi])
                ends = np.concatenate([[0], np.cumsum(counts)])
                back, flat = [], ids.tolist()
                for i in range(hi - lo):
                    back.append(coder.value.decode(flat[ends[i] : ends[i + 1]]) == raw[mine[i] : mine[i + 1]].tobytes())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays([lists, pa.array(back)], fields=list(kind))], names=[*batch.schema.names[:-1], into])

    return run


def encode(docs: DataFrame, model: str | None = None, seed: int = 0, theta: float = 1.0, text: str = "text", key: tuple[str, ...] = ("doc_id",), into: str = "pieces") -> DataFrame:
    """Adds the struct column `into`: ids (one sampled segmentation of the whole text), lossless (the ids were decoded and
    gave the text).

    The lattice has all pieces of the model; a piece's chance falls with its rank (Zipf's rule to
    the power theta; a small theta samples more freely), and byte pieces spell what no other piece does. A text gets
    a leading space, each run of spaces begins a piece ("▁"), a literal "▁" is spelled in bytes, so ids stand for one text
    only. Draws are hashes of (seed, key columns, place in the text): a row is segmented alike in any partition and
    in any run. Null and empty texts have no ids; repeated rows get equal ids; null keys are allowed. Other
    columns pass through, one named `into` is replaced. No shuffle; the vocabulary (0.5 MB) is broadcast."""
    spark, docs = docs.sparkSession, docs.drop(into)
    coder = spark.sparkContext.broadcast(Coder(Pieces.load(model or default_model()), theta))
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    seeded = spread(docs).select("*", row_seed(seed, *key).alias(*unused(docs.columns, "seed")))
    return seeded.transform(map_batches, _encoder(coder, into, text), T.StructType([*docs.schema.fields, T.StructField(into, kind)]))


def row_seed(seed: int, *key: str) -> Column:
    return F.xxhash64(F.lit(seed), *map(column, key))


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the column `into`: the text that the ids spell; null ids give null, no ids the empty text."""
    encoded = encoded.drop(into)
    coder = encoded.sparkSession.sparkContext.broadcast(Coder(Pieces.load(model or default_model())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            texts = [None if x is None else coder.value.decode(x).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return encoded.transform(map_batches, run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
