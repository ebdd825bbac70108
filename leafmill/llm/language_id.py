"""Language ID by unigram pieces, marginalised over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import lattice
from leafmill.llm import wordhash as W
from leafmill.llm.lattice import Pieces
from leafmill.llm.sentencepiece_sampling import default_model
from leafmill.llm.tables import column, cut, map_batches, scratch, spread

UNKNOWN = "und"
#: Expected counts are rounded to a fraction of one.
UNIT = 1 << 24
#: No piece gets a smaller chance.
LEAST = 1e-9
FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1


class Model:
    """chances: [pieces + 1, languages], the last row zeros."""

    def __init__(self, pieces: Pieces, languages: list[str], chances: np.ndarray):
        self.pieces, self.languages, self.chances = pieces, languages, chances

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """[rows, languages]: logarithm of each text's probability."""
        rows = len(offsets) - 1
        raw, start, end, row, hashes = words(self.pieces, offsets, data)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        sums = lattice.log_sums(self.pieces, raw, start[first], end[first], self.chances)
        return np.stack([np.bincount(row, weights=sums[which, c], minlength=rows) for c in range(len(self.languages))], axis=1)

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[list[str], list[float]]:
        scores = self.scores(offsets, data)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        known = has_letter(offsets, data)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, odds.max(axis=1), 0.0).tolist()


def words(pieces: Pieces, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bytes, start, end, row, hash) of all words, each behind one space in the bytes given; long ones in the parts
    that Pieces.split() gives."""
    found = W.words(offsets, data, W.NON_SPACE)
    raw = np.insert(data, found.start, 32)
    opens = found.start + np.arange(len(found.start))
    start, end = pieces.split(raw, opens, opens + found.end - found.start + 1)
    row = found.doc if len(start) == len(opens) else found.doc[np.searchsorted(opens, start, side="right") - 1]
    return raw, start, end, row, W.span_hashes(raw, start, end)


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of each row whether it has a letter of any script."""
    counts = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = counts[offsets[1:]] > counts[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
    return out


def _counted(pieces):
    """(lang, text) to (lang, word, n), the word behind a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            offsets, data = W.column_bytes(batch.column(1))
            for lo, hi in W.blocks(batch.num_rows, offsets, 2 * W.MB):
                langs = names[lo:hi]
                raw, start, end, row, hashes = words(pieces.value, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                code = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                own = np.array([code[x] for x in langs], dtype=np.uint64)[row]
                _, first, counts = np.unique(W.mix(hashes ^ W.mix(own + np.uint64(1))), return_index=True, return_counts=True)
                spelled = [raw[start[i] : end[i]].tobytes() for i in first]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in row[first]], pa.string()), pa.array(spelled, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

    return run


def _expected(shared):
    """(lang, word, n) to (lang, piece, n): how often each piece is expected in the words, in units of 1 / UNIT, whole
    numbers, so that sums don't depend on how the rows are dealt. One language is held at a time."""

    def told(lang: str, sums: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], names=["lang", "piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, chances = shared.value
        code, held, sums = {x: k for k, x in enumerate(languages)}, None, None
        for batch in batches:
            offsets, data = W.column_bytes(batch.column(1))
            own, times = np.array([code[x] for x in batch.column(0).to_pylist()], dtype=np.int64), batch.column(2).to_numpy()
            for lang in np.unique(own):
                if lang != held:
                    if held is not None:
                        yield told(languages[held], sums)
                    held, sums = lang, np.zeros(len(chances) - 1, dtype=np.int64)
                rows = np.flatnonzero(own == lang)
                sums += lattice.expected(pieces, data, offsets[rows], offsets[rows + 1], times[rows], chances[:, lang], UNIT)
        if held is not None:
            yield told(languages[held], sums)

    return run


def fit(counts: DataFrame | None, pieces: Pieces, rounds: int = 3, smoothing: float = 0.1) -> Model:
    """Expectation maximisation of each language's piece probabilities over (lang, word, n). The expected counts are
    summed on the executors; vocabulary x languages numbers a round reach the driver, however many words there are."""
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect()) if counts is not None else []
    code = {x: k for k, x in enumerate(languages)}
    live = np.array([bool(x) for x in pieces.spelling])
    table = np.zeros((len(live) + 1, len(languages)))
    table[:-1] = (live / live.sum())[:, None]
    for _ in range(rounds if languages else 0):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, languages, table))
        found = counts.transform(map_batches, _expected(shared), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        of = np.array([code[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
        table = np.zeros(table.shape)
        table[found.column("piece").to_numpy(), of] = found.column("n").to_numpy() / UNIT
        table[:-1] = (table[:-1] + smoothing) * live[:, None]
        table /= table.sum(axis=0)
        table[:-1] = np.maximum(table[:-1], LEAST * live[:, None])
        shared.unpersist()
    return Model(pieces, languages, table)


def train(labelled: DataFrame, model: str | None = None, text: str = "text", lang: str = "lang", docs_per_language: int = 1500) -> Model:
    """Fits a model to rows with a text and a non-null lang: at most about `docs_per_language` rows of each language, chosen
    by a hash of the row, and all words of these, of any length; every labelled language with a word is in the model. Words are
    counted and fitted on the executors; the driver holds the model (vocabulary x languages). Without any row the model
    has no language."""
    pieces = Pieces.load(model or default_model())
    rows = labelled.where(column(lang).isNotNull() & column(text).isNotNull()).select(column(lang).cast("string").alias("lang"), column(text).alias("text"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), docs_per_language / F.count("*")).alias("share"))
    hashed = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003)) / 1_000_003
    chosen = spread(rows).join(F.broadcast(share), "lang").where(hashed < F.col("share")).select("lang", "text")  # a row a language, as the model has columns
    shared = chosen.sparkSession.sparkContext.broadcast(pieces)
    counted = chosen.transform(map_batches, _counted(shared), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    with scratch():
        return fit(cut(counted.sortWithinPartitions("lang"), "words"), pieces)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(doc_id)))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _predictor(model, text: str, into: str):
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (langs, scores) = batch.schema.names.index(text), ([], [])
            offsets, data = W.column_bytes(batch.column(at))
            for lo, hi in W.blocks(batch.num_rows, offsets, 2 * W.MB):
                found = model.value.predict(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                langs += found[0]
                scores += found[1]
            told = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, into])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct column `into`: lang (the language under which the text is likeliest), score (its posterior
    under equal priors, 0 to 1).

    A text's probability is the product of its words' (`[^\\x20\\x09-\\x0D]+` behind a space), a word's the sum over all of
    its segmentations into pieces (forward algorithm over bytes; every byte has a piece, so none is impossible).
    Null texts, texts without a letter, and all texts under a model without languages are `und` with score 0. Ties go to
    the language that sorts first. Only the text is read; other columns pass through, one named `into` is replaced;
    repeated rows get the same answer. No shuffle; the model (vocabulary x languages) is broadcast."""
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])
    if not model.languages:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    return spread(docs).transform(map_batches, _predictor(docs.sparkSession.sparkContext.broadcast(model), text, into), schema)
