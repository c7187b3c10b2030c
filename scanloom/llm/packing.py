"""Packing of documents into token sequences along a space-filling curve.

A document's token ids are hashed into signed buckets and that vector is projected
to few dimensions; the place of the projection on a Hilbert curve is its key.
Documents are range-sorted by key, so neighbours in a sequence are alike, and each
partition fills one sequence after the other, cutting a document where a sequence
is full. What is left at a partition's end goes to sequences whose lengths are
powers of two, which need no padding.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import drop_settled, range_partitions, settle, tidied
from scanloom.llm.tokens import PieceIds

SEQUENCE = 1024
END = 0
DIMENSIONS, BITS, BUCKETS, SEED = 3, 16, 256, 17

#: Texts whose new pieces are encoded together, and pieces that a worker remembers at most.
TEXTS, MEMORY = 64, 600_000

_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64())] + [(f"x{i}", pa.float32()) for i in range(DIMENSIONS)])
_TOKENS_DDL = "doc_id long, ids binary, tokens long, " + ", ".join(f"x{i} float" for i in range(DIMENSIONS))
_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_PIECES_DDL = ", ".join(f"{c} long" for c in _PIECES)


def projection(dimensions: int = DIMENSIONS, buckets: int = BUCKETS, seed: int = SEED) -> np.ndarray:
    """A row for each hash bucket: its place among the dimensions, of a seeded normal matrix."""
    return np.random.default_rng(seed).standard_normal((buckets, dimensions)).astype(np.float32)


def signed_buckets(vocabulary: int, buckets: int = BUCKETS) -> np.ndarray:
    """By token id: its hash bucket, those of negative sign after all others."""
    hashed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    negative = hashed >> np.uint64(63) == 0
    return ((hashed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64) + buckets * negative


def projected(ids: np.ndarray, buckets: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The mean of a document's hashed token vector, projected."""
    counts = np.bincount(buckets[ids], minlength=2 * len(matrix))
    return (counts[: len(matrix)] - counts[len(matrix) :]) @ matrix.astype(np.float64) / len(ids)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, a row each with coordinates below 2 ** bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and swaps of the cubes, from the largest
        low = (1 << level) - 1
        for i in range(dims):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):  # Gray code of the cubes
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, memory: int = MEMORY) -> DataFrame:
    """(doc_id, ids, tokens, x0, x1, ..): ids of each whole text and the end id, as bytes, and the projected vector's mean."""

    def run(source):
        pieces = PieceIds.shared(tokenizer, memory)
        buckets, matrix = signed_buckets(pieces.tokenizer.get_vocab_size()), projection()
        close = np.array([end], pieces.dtype).tobytes()
        for batch in source:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                found = [ids + close for ids in pieces.ids_of([t or "" for t in part.column("text").to_pylist()])]
                units = [np.frombuffer(ids, pieces.dtype) for ids in found]
                means = [projected(u, buckets, matrix) for u in units]
                rows = [(doc, ids, len(u), *m.tolist()) for doc, ids, u, m in zip(part.column("doc_id").to_pylist(), found, units, means, strict=True)]
                yield _columns(rows, _TOKENS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run, keeps_pieces=True), _TOKENS_DDL)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def curve_key(tokens: DataFrame) -> Column:
    """The Hilbert key: each coordinate by its mean and spread over all documents, squeezed into (0, 1)."""
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    got = tokens.agg(*(F.avg(x).alias(f"m_{x}") for x in axes), *(F.stddev_pop(x).alias(f"s_{x}") for x in axes)).first()
    mean = np.array([got[f"m_{x}"] or 0.0 for x in axes])
    spread = np.array([got[f"s_{x}"] or 1.0 for x in axes])

    @F.arrow_udf("long")
    def key(source: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in source:
            z = (np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1) - mean) / spread
            cells = np.minimum(((np.tanh(0.8 * z) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.array(hilbert_keys(cells), pa.int64())

    return key(*axes)


def cut_lengths(tokens: int, sequence: int) -> list[int]:
    """Lengths of the sequences that hold a partition's last ``tokens`` ids, fewer than ``sequence``: powers of two, largest first."""
    return [1 << b for b in range(sequence.bit_length(), -1, -1) if tokens >> b & 1]


def _pack(sequence: int, dtype: str):
    """Fill sequences in the order of the rows; a row is held until the sequence that ends it is known to be full."""

    def run(source):
        first = TaskContext.get().partitionId() << 36
        number, used, out = 0, 0, []
        held: list[tuple] = []  # pieces of the sequence that is being filled: doc, start, ids, tokens of the document

        def close(lengths):
            """Hand the held pieces out to sequences of these lengths."""
            nonlocal number, held
            pieces = iter(held)
            held, piece = [], None
            for length in lengths:
                offset = 0
                while offset < length:
                    doc, start, ids, total = piece or next(pieces)
                    piece, part = None, ids[: length - offset]
                    out.append((doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, first + number, offset))
                    offset += len(part)
                    if len(part) < len(ids):
                        piece = (doc, start + len(part), ids[len(part) :], total)
                number += 1

        for batch in source:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids, start = np.frombuffer(raw.as_py(), dtype), 0
                total = len(ids)
                while start < total:
                    part = ids[start : start + sequence - used]
                    held.append((doc, start, part, total))
                    start, used = start + len(part), used + len(part)
                    if used == sequence:
                        close([sequence])
                        used = 0
            if out:
                yield _columns(out, pa.schema([(c, pa.int64()) for c in _PIECES]))
                out = []
        if used:
            close(cut_lengths(used, sequence))
            yield _columns(out, pa.schema([(c, pa.int64()) for c in _PIECES]))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end: int = END, memory: int = MEMORY) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, all longs.

    A document is the ids of its whole text and the id ``end``; a null or empty text is
    ``end`` alone, so each row of ``docs`` has at least one piece. Its pieces lie one
    after the other, in neighbouring sequences. All sequences have ``sequence`` ids,
    but for those at the ends of partitions, whose lengths are powers of two: nothing
    is padded. Repeated rows are packed as often; a null doc_id is carried along.
    Other columns are not looked at. An empty table gives an empty table.

    Documents with equal keys are told apart by doc_id and length, so a group of
    copies is spread over as many partitions as it fills. A worker remembers the ids of
    at most ``memory`` pieces of text.
    """
    tokens = settle(tokenized(docs, tokenizer, id_col, text_col, end, memory), "tokens")
    dtype = str(PieceIds(tokenizer, 0).dtype)
    keyed = tokens.select("doc_id", "ids", "tokens", curve_key(tokens).alias("curve"))
    order = ["curve", "doc_id", "tokens"]
    pieces = settle(keyed.repartitionByRange(range_partitions(tokens), *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(tidied(_pack(sequence, dtype)), _PIECES_DDL), "pieces")
    drop_settled(tokens)
    return pieces
