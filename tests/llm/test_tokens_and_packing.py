import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from scanloom.llm import packing, token_counts
from scanloom.llm.common import range_partitions
from scanloom.llm.tokens import PieceIds, load, windows

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = ["a", "B", "'s", "'ll", " ", " ", "  ", "\n", "\n\n", "\t", "7", "é", "!", ".", ",", "*", "　", "<|endoftext|>", "\x1c", "\x85", "Σ", "İ", "ﬁ", "e", "́", "½", "क़", "東京", "\U0001f600", "Word", "%%"]


def odd_texts(n, seed=2, most=120):
    r = random.Random(seed)
    return ["", " ", "\n", " a", "a ", "x" * 3000, "x" * 900 + " " + "y" * 900, " " * 500 + "a"] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("file", FILES)
def test_pieces_give_the_library_ids(file):
    path = public_tokenizers.path(file)
    library, own = load(path), PieceIds(path, memory=200)
    for text in odd_texts(1500):
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_windows_and_spliced_chunks_change_nothing(file):
    path = public_tokenizers.path(file)
    library, own, widened = load(path), PieceIds(path), 0
    for text in odd_texts(400, 5):
        want = library.encode(text, add_special_tokens=False).ids
        parts = list(windows(text, 9))
        assert "".join(parts) == text
        assert [i for p in parts for i in (np.frombuffer(own.ids(p), own.dtype).tolist() if p else [])] == want
        for chunk, overlap in ((16, 4), (100, 16)):
            tokens, _, wider = token_counts.spliced_count(text, library, chunk, overlap)
            widened += wider
            assert tokens == len(want)
    assert widened


def test_counts_of_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path(FILES[1])
    library = load(path)
    got = sorted((tuple(r) for r in token_counts.token_counts(odd_docs, path, limit=100, chunk=300, overlap=8).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, path).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_keys_visit_each_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("sequence", [64, 1024])
def test_packing_is_a_round_trip(odd_docs, sequence):
    path = public_tokenizers.path(FILES[0])
    library = load(path)
    ids = defaultdict(list)
    for r in odd_docs.collect():
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = packing.pack(odd_docs, path, sequence=sequence).collect()
    assert sum(p.length for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    for p in pieces:
        fits = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens]
        assert p.ids_crc32 in {zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in fits}
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id, p.doc_tokens].append((p.start, p.length))
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1] and length > 0
            ends.append(offset + length)
        assert ends[-1] == sequence or bin(ends[-1]).count("1") == 1 and ends[-1] < sequence
    for (doc, tokens), parts in documents.items():
        covered = sorted(i for start, length in parts for i in range(start, start + length))
        assert covered == sorted(list(range(tokens)) * sum(len(x) == tokens for x in ids[doc]))


def test_copies_lie_side_by_side(spark):
    docs = spark.createDataFrame([(i, f"text of kind {i % 5} " * 9) for i in range(50)], "doc_id long, text string")
    order = [p.doc_id % 5 for p in sorted(packing.pack(docs, public_tokenizers.path(FILES[0])).collect(), key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == 4


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs, public_tokenizers.path(FILES[0])).count() == 0
    assert packing.cut_lengths(700, 1024) == [512, 128, 32, 16, 8, 4] and packing.cut_lengths(0, 1024) == []


def test_neighbours_follow_the_curve_of_plainly_computed_keys(spark):
    """Ids, vectors, projections and keys by the definition, one document at a time."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    library = load(path)
    matrix, points = packing.projection(), {}
    for doc, text in docs.collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        vector = np.zeros(packing.BUCKETS)
        for i in ids:
            h = i * 0x9E3779B97F4A7C15 % (1 << 64)
            vector[(h >> 40) % packing.BUCKETS] += 1 if h >> 63 else -1
        points[doc] = (vector @ matrix.astype(float) / len(ids)).astype(np.float32).astype(float), len(ids)
    x = np.array([p for p, _ in points.values()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cells = np.minimum(((np.tanh(0.8 * z) + 1) / 2 * 65536).astype(int), 65535)
    keys = dict(zip(points, packing.hilbert_keys(cells).tolist(), strict=True))
    pieces = packing.pack(docs, path).select("doc_id", "start", "sequence_id", "offset").collect()
    begins = [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sorted(begins) == sorted(points)
    # A coordinate may fall into the next cell by rounding of the sums, so a few keys may differ by a turn of the curve.
    wrong = sum((keys[a], a) > (keys[b], b) for a, b in zip(begins, begins[1:], strict=False))
    assert wrong <= 0.02 * len(begins)


def test_partitions_follow_the_bytes(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert range_partitions(table) == cores and range_partitions(table, size=100) > cores and range_partitions(table, size=1, most=50) == 50
