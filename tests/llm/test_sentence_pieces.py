import random

import numpy as np
import public_tokenizers
import pytest

from scanloom.llm import sentence_pieces as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "b", "e", "t", "h", "n", " ", "  ", "▁", "▁▁", "\n", "\t", ".", ",", "0", "é", "é", "\U0001f600", "\x00", "<s>", "<0x0A>", "東京", "the", "ing", " the", "­"]


@pytest.fixture(scope="module")
def coder():
    return sp.Coder(MODEL)


def test_ids_and_texts_equal_the_library(coder):
    r = random.Random(4)
    library = coder.vocabulary.library
    texts = ["".join(r.choices(SIGNS, k=r.randint(0, 60))) for _ in range(3000)]
    for text, ids in zip(texts, sp._encoded(coder, texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert coder.decode(ids) == library.decode(ids.tolist()) == text.replace("▁", " ")


def test_any_ids_decode_as_in_the_library(coder):
    r = random.Random(6)
    library = coder.vocabulary.library
    known = [0, 1, 2, 28705, 259, 260, 264, 13, 35, 198, 200, 201, 230, 240, 243]
    for _ in range(5000):
        ids = [r.choice([*known, r.randrange(32000)]) for _ in range(r.randint(1, 7))]
        assert coder.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_heap_and_matrix_agree(coder):
    r, v = random.Random(8), coder.vocabulary
    words = ["".join(r.choices("ethionasr", k=r.randint(1, 30))) for _ in range(500)]
    symbols = np.full((500, 32), -1, np.int32)
    for row, w in zip(symbols, words, strict=True):
        row[: len(w)] = v.of_char[[ord(c) for c in w]]
    joined, counts = sp.agendas(v, symbols)
    for w, ids in zip(words, np.split(joined, np.cumsum(counts)[:-1]), strict=True):
        assert sp.agenda(v, v.of_char[[ord(c) for c in w]].tolist()) == ids.tolist()


def test_windows_and_small_memory(monkeypatch):
    monkeypatch.setattr(sp, "TOGETHER", 64)
    r, coder = random.Random(10), sp.Coder(MODEL, memory=5)
    texts = ["".join(r.choices(SIGNS, k=r.randint(0, 300))) for _ in range(200)] + ["x" * 3000, " " * 500, "a " * 200, "", None]
    for text, ids in zip(texts, sp._encoded(coder, texts), strict=True):
        assert ids.tolist() == coder.vocabulary.library.encode(text or "", add_bos=True, add_eos=True), text


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as fmt

    model = fmt.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sp.Vocabulary(str(tmp_path / "u.model"))


def test_odd_rows(odd_docs, no_docs, coder):
    got = sp.round_trip(odd_docs, MODEL).collect()
    want = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert sorted((str(g.doc_id), g.decoded) for g in got) == sorted((str(d), t) for d, t in want)
    for g in got:
        assert np.frombuffer(g.ids, "<u4").tolist() == coder.vocabulary.library.encode(g.decoded, add_bos=True, add_eos=True)
    coded = sp.encode(odd_docs, MODEL)
    assert sorted(r.decoded for r in sp.decode(coded, MODEL).collect()) == sorted(t for _, t in want)
    assert sp.round_trip(no_docs, MODEL).count() == sp.decode(coded.limit(0), MODEL).count() == 0
