"""SentencePiece encoding and decoding with merge-type vocabularies, by an agenda of adjacent symbol pairs.

A text is normalised as the model says (blanks become a sign, one more stands in
front) and begins as its characters. All adjacent symbols that together make a piece
are on an agenda ordered by the piece's score, the leftmost first among equal ones.
The best is merged, its neighbours make new pairs, and so on until the agenda is
empty. Characters left over that are no piece become their bytes.

No piece holds the blank sign behind another character (the model is tested for
that), so no merge reaches over the start of a run of blanks: a text may be cut
there, and the ids of its words joined are the ids of the text. The words of an
Arrow batch are made distinct, and the agendas of all that are new run side by side
as rows of a matrix; long words have a heap of their own. Every new word is compared
with the sentencepiece library, and so is a whole text of each batch, both ways.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from scanloom.llm.common import gathered

BLANK = "▁"
#: Words that a task remembers at most, characters of texts that are encoded together, longest word for a row of the matrix.
MEMORY, TOGETHER, ROW = 200_000, 1 << 21, 32
#: Characters of the whole text that a batch compares with the library at most; a longer one is compared by its words only.
COMPARED = 1 << 16

_IDS = "doc_id long, ids binary"
_BOTH = "doc_id long, ids binary, decoded string"


class Vocabulary:
    """The pieces of a model as arrays: symbols of characters, pairs that make a piece, order of scores.

    A symbol is the id of a piece, or the number of pieces plus the code point of a
    character that is none.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kind = model.normalizer_spec, model.SentencePiece
        usual = {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type not in usual for p in model.pieces):
            raise ValueError("only merge-type vocabularies without unused or user-defined pieces")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep characters and blanks and put a blank in front")
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.may_cut = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.byte_ids = np.zeros(256, np.uint32)
        self.falls_back = model.trainer_spec.byte_fallback
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        _, place = np.unique(np.array([p.score for p in model.pieces], np.float32), return_inverse=True)
        self.order = place.astype(np.int32)  # higher is better

        symbol = lambda s: normal.get(s, self.size + ord(s) if len(s) == 1 else None)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by_key = np.argsort(keys)
        self.pair_keys = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.pair_ids = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[by_key], -1).astype(np.int32)

        # What each id decodes to; a byte piece is its byte, a control piece nothing.
        self.is_byte = np.array([p.type == kind.BYTE for p in model.pieces])
        self.is_text = np.array([p.type == kind.NORMAL for p in model.pieces])
        self.surfaces = [self._surface(p, kind) for p in model.pieces]

    def _surface(self, p, kind) -> bytes:
        if p.type == kind.BYTE:
            return bytes([int(p.piece[3:5], 16)])
        if p.type == kind.CONTROL:
            return b""
        if p.type == kind.UNKNOWN:
            return self.library.decode([self.unknown]).encode()
        return p.piece.replace(BLANK, " ").encode()

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, -1 if none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)


def agenda(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """The symbols of one word after all merges: a heap of pairs, those that are out of date are skipped."""
    pairs, order = vocabulary.pairs, vocabulary.order
    here, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            piece = pairs.get(here[i] << 32 | here[after[i]])
            if piece is not None:
                heapq.heappush(heap, (-int(order[piece]), i, here[i], here[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if here[i] != left or j >= n or here[j] != right:
            continue
        here[i], here[j] = pairs[left << 32 | right], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in here if s >= 0]


def agendas(vocabulary: Vocabulary, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many words at once: rows of symbols, filled up with -1. Returns (symbols joined, number of each row).

    Each round takes the best pair of every row, the leftmost of equal ones, and
    looks up the two new pairs around it; rows without a pair are done.
    """
    rows, width = symbols.shape
    here = np.concatenate([symbols, np.full((rows, 1), -1, np.int32)], 1)
    width += 1
    left, right = here[:, :-1], here[:, 1:]
    piece = vocabulary.merged(left.ravel(), right.ravel()).reshape(left.shape)
    piece[(left < 0) | (right < 0)] = -1
    waiting = np.full((rows, width), -1, np.int32)
    waiting[:, :-1] = np.where(piece >= 0, vocabulary.order[piece], -1)
    cols = np.arange(width, dtype=np.int32)
    after, before = np.tile(cols + 1, (rows, 1)).ravel(), np.tile(cols - 1, (rows, 1)).ravel()
    flat, agenda_of = here.ravel(), waiting.ravel()
    live = np.arange(rows)
    while live.size:
        table = waiting if live.size == rows else waiting[live]
        best = table.argmax(1)
        going = table[np.arange(live.size), best] >= 0
        live, best = live[going], best[going]
        if not live.size:
            break
        base = live * width
        i = base + best
        j = base + after[i]
        flat[i] = vocabulary.merged(flat[i], flat[j])
        flat[j] = -1
        agenda_of[j] = -1
        k = after[j]
        after[i] = k
        before[base + k] = best  # the last column always stays
        for a, b, there in ((i, base + k, None), (base + before[i], i, before[i] >= 0)):
            made = vocabulary.merged(flat[a], flat[b])
            made = np.where((flat[b] >= 0) & (made >= 0), vocabulary.order[made], -1)
            if there is None:
                agenda_of[a] = made
            else:
                agenda_of[a[there]] = made[there]
    kept = here >= 0
    return here[kept], kept.sum(1)


class Coder:
    """Encodes and decodes texts, and remembers the ids of words."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.vocabulary, self.memory = Vocabulary(path), memory
        self.known: dict[str, bytes] = {}
        surfaces = self.vocabulary.surfaces
        self.lengths = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(surfaces), np.uint8)

    # -- encoding

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids of words whose symbols are joined; a character that is no piece becomes its bytes."""
        v = self.vocabulary
        odd = np.flatnonzero(symbols >= v.size)
        ends = np.cumsum(counts)
        if odd.size:
            own = [v.byte_ids[list(chr(s - v.size).encode())] if v.falls_back else [v.unknown] for s in symbols[odd].tolist()]
            more = np.array([len(o) for o in own])
            longer = np.ones(symbols.size, np.int64)
            longer[odd] = more
            ends = np.concatenate([[0], np.cumsum(longer)])[ends]
            spread = np.repeat(symbols, longer)
            spread[np.repeat(symbols >= v.size, longer)] = np.concatenate(own)
            symbols = spread
        joined = symbols.astype("<u4").tobytes()
        begins = np.concatenate([[0], ends[:-1]])
        return [joined[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the blank sign in front, compared with the library."""
        v, found = self.vocabulary, [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        by_length = np.argsort(lengths, kind="stable")
        widths = np.unique(np.minimum(-(-lengths // 4) * 4, ROW + 4))
        for width in widths.tolist():
            low = np.searchsorted(lengths[by_length], width - 4, "right")
            if width > ROW:
                for w in by_length[low:].tolist():
                    symbols = v.of_char[np.frombuffer((BLANK + words[w]).encode("utf-32-le"), np.uint32)]
                    merged = np.array(agenda(v, symbols.tolist()), np.int32)
                    found[w] = self._ids(merged, np.array([merged.size]))[0]
                continue
            these = by_length[low : np.searchsorted(lengths[by_length], width, "right")]
            text = np.frombuffer("".join(BLANK + words[w] for w in these.tolist()).encode("utf-32-le"), np.uint32)
            symbols = np.full((len(these), width), -1, np.int32)
            symbols[np.arange(width) < lengths[these][:, None]] = v.of_char[text]
            for w, ids in zip(these.tolist(), self._ids(*agendas(v, symbols)), strict=True):
                found[w] = ids
        self._compare(words, found)
        return found

    def _compare(self, words: list[str], found: list[bytes]) -> None:
        theirs = self.vocabulary.library.encode(words, num_threads=1)
        joined = np.fromiter((i for ids in theirs for i in ids), "<u4", sum(map(len, theirs)))
        # The library encodes a text of no characters as nothing; our empty word is the blank sign alone.
        if joined.tobytes() != b"".join(f for w, f in zip(words, found, strict=True) if w):
            wrong = next(w for w, f, t in zip(words, found, theirs, strict=True) if w and f != np.array(t, "<u4").tobytes())
            raise AssertionError(f"ids of {wrong!r} differ from the library's")

    def _words(self, texts: list[str]) -> pa.ListArray:
        """The words of texts; each stands for itself behind one blank sign. A text of no characters must not be among them."""
        if not self.vocabulary.may_cut:
            return pa.array([[t.replace(" ", BLANK)] for t in texts], pa.list_(pa.string()))
        odd = [t[0] == " " or t[-1] == " " or "  " in t or BLANK in t for t in texts]
        if not any(odd):
            return pc.split_pattern(pa.array(texts, pa.string()), " ")
        cut = [[w[1:] for w in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + t.replace(" ", BLANK))] if o else t.split(" ") for t, o in zip(texts, odd, strict=True)]
        return pa.array(cut, pa.list_(pa.string()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that have characters, without begin and end."""
        words = self._words(texts)
        coded = pc.dictionary_encode(words.values)
        known = self.known
        distinct = coded.dictionary.to_pylist()
        ids = [known.get(w) for w in distinct]
        new = [n for n, i in enumerate(ids) if i is None]
        if new:
            names = [distinct[n] for n in new]
            for n, w, found in zip(new, names, self._new(names), strict=True):
                ids[n] = found
                if len(known) < self.memory:
                    known[w] = found
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        joined, at = gathered(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths, lengths, coded.indices.to_numpy())
        ends = at[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [joined[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    # -- decoding

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        """The pieces of ids one after the other, blank signs as blanks."""
        return gathered(self.bytes, self.starts, self.lengths, ids)[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode gives it: without the blank in front; bytes that are no character become U+FFFD each."""
        v = self.vocabulary
        shown = self.decoded_bytes(ids)
        leads = int(shown[:1] == b" " and v.is_text[ids[np.argmax(self.lengths[ids] > 0)]])
        try:
            return shown[leads:].decode()
        except UnicodeDecodeError:
            pass
        parts, at = [], 0
        is_byte = v.is_byte[ids]
        runs = np.flatnonzero(np.diff(is_byte, prepend=not is_byte[0]))
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(ids)], strict=True):
            part = shown[at : at + int(self.lengths[ids[a:b]].sum())]
            at += len(part)
            parts.append(_characters(part) if is_byte[a] else part.decode())
        return "".join(parts)[leads:]


def _characters(raw: bytes) -> str:
    """Bytes as characters; each byte that begins none becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _windows(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at a blank that follows something other than blanks; that blank goes."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        while end > 0 and text[end - 1] in (" ", BLANK):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _encoded(coder: Coder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text with begin and end, encoding about ``TOGETHER`` characters at a time."""
    v = coder.vocabulary
    size = TOGETHER if v.may_cut else 1 << 62
    held: list[str] = []
    owners: list[int] = []  # parts of each text that wait
    done: list[np.ndarray] = []

    def flush() -> Iterator[np.ndarray]:
        ids = iter(coder.encode(held) if held else [])
        for parts in owners:
            yield np.concatenate([[v.begin], *(next(ids) for _ in range(parts)), [v.end]]).astype("<u4")
        held.clear()
        owners.clear()

    total = 0
    for text in texts:
        if text and len(text) > size:  # by itself, window by window
            yield from flush()
            total = 0
            done = []
            for w in _windows(text, size):
                done += coder.encode([w]) if w else [np.frombuffer(coder._new([""])[0], "<u4")]
            yield np.concatenate([[v.begin], *done, [v.end]]).astype("<u4")
            continue
        owners.append(1 if text else 0)
        if text:
            held.append(text)
            total += len(text)
        if total >= TOGETHER:
            yield from flush()
            total = 0
    yield from flush()


def _coded(docs: DataFrame, model: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def run(source):
        coder = Coder(model)
        library = coder.vocabulary.library
        for batch in source:
            ids_out, text_out, doc_out, size, compared = [], [], [], 0, False
            names = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for name, text, ids in zip(names, texts, _encoded(coder, texts), strict=True):
                text = text or ""
                shown = coder.decode(ids) if decoded else None
                if not compared and 0 < len(text) <= COMPARED:
                    compared = True
                    if library.encode(text, add_bos=True, add_eos=True) != ids.tolist() or decoded and library.decode(ids.tolist()) != shown:
                        raise AssertionError(f"document {name} differs from the library")
                doc_out.append(name)
                ids_out.append(ids.tobytes())
                text_out.append(shown)
                size += len(text)
                if size >= TOGETHER:
                    yield _batch(doc_out, ids_out, text_out, decoded)
                    ids_out, text_out, doc_out, size = [], [], [], 0
            if doc_out:
                yield _batch(doc_out, ids_out, text_out, decoded)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _BOTH if decoded else _IDS)


def _batch(names: list, ids: list, texts: list, decoded: bool) -> pa.RecordBatch:
    columns = [pa.array(names, pa.int64()), pa.array(ids, pa.binary())]
    if decoded:
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of ``docs``: the ids of the whole text with begin and end, as little-endian unsigned 32-bit integers.

    A null text is an empty one and has begin and end alone. Repeated rows and null ids
    come back as they are; other columns are not looked at. An empty table gives an
    empty table. A task that finds ids other than the library's fails.
    """
    return _coded(docs, model, id_col, text_col, False)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): as ``encode``, and the text that the ids decode to."""
    return _coded(docs, model, id_col, text_col, True)


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for each row of ids as ``encode`` gives them; null ids decode to null.

    Any ids of the model will do: control pieces decode to nothing, bytes that make no
    character to U+FFFD each.
    """

    def run(source):
        coder = Coder(model)
        for batch in source:
            texts = [None if i is None else coder.decode(np.frombuffer(i, "<u4")) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
