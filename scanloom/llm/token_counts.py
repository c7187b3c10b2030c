"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced.

A text of ordinary length is encoded at once. A huge one would need memory many
times its size for its offsets, so it is cut into chunks that reach into the next
one by an overlap. Neighbouring chunks are spliced at a boundary that both found
in their overlap and that is proven stable: the place before a blank that follows
something other than white space, over which the tokenizer never merges and
behind which it sees nothing of what came before. Tokens before it count in the
first chunk, those from it on in the second. Where the overlap has no such place,
it is widened until it has one or the text ends.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.tokens import PieceIds

CHUNK, OVERLAP = 1 << 15, 256
LIMIT = 2048
#: Texts whose new pieces are encoded together.
TEXTS = 64

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.int32()), ("widened", pa.int32())])
_COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long, chunks int, widened int"


class Chunk:
    """Where the tokens of an encoded chunk begin and end, in characters of the whole text."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        offsets = tokenizer.encode(text[begin:end], add_special_tokens=False).offsets
        self.starts = np.array([a for a, _ in offsets], np.int64) + begin
        self.ends = np.array([b for _, b in offsets], np.int64) + begin

    def before(self, place: int) -> int:
        """Number of tokens that begin before a place."""
        return int(np.searchsorted(self.starts, place))

    def next_start(self, place: int) -> int | None:
        """Where the next token begins, at the place or after it; None if there is none or a token reaches over the place."""
        i = self.before(place)
        if i == len(self.starts) or (i and self.ends[i - 1] > place):
            return None
        return int(self.starts[i])


def common_boundary(text: str, left: Chunk, right: Chunk, begin: int, end: int) -> int | None:
    """The first stable place after ``begin`` and before ``end`` at which both chunks agree, or None.

    It lies before a blank that follows something other than white space, no token of
    either chunk reaches over it, and the next token of both begins at the same place.
    """
    at = text.find(" ", begin + 1, end)
    while at >= 0:
        if not text[at - 1].isspace():
            following = left.next_start(at)
            if following is not None and following == right.next_start(at):
                return at
        at = text.find(" ", at + 1, end)
    return None


def spliced_count(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of a text, the same count as of the text encoded at once.

    A chunk begins where the one before it was spliced. The start of the next one is
    encoded over the overlap alone to find the splice, and in full in its turn. Tokens
    of a character that are several count where the character lies.
    """
    count = chunks = widenings = begin = 0
    while True:
        end, reach = begin + chunk, overlap
        while True:
            stop = min(len(text), end + reach)
            left = Chunk(tokenizer, text, begin, stop)
            chunks += 1
            if stop == len(text):
                return count + len(left.starts), chunks, widenings
            at = common_boundary(text, left, Chunk(tokenizer, text, end, stop), end, stop)
            if at is not None:
                break
            reach *= 4
            widenings += 1
        count += left.before(at)
        begin = at


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chunks, widened) for each row of ``docs``.

    n_bytes: UTF-8 bytes of the text. n_tokens: ids that the library gives for the
    whole text, without begin, end or added special tokens; special strings inside it
    as is its default. A null text is an empty one. Texts of more than ``chunk``
    characters are encoded in chunks and spliced; of others the pieces between blanks
    are remembered. Repeated rows and null ids come back as they are; other columns
    are not looked at. An empty table gives an empty table.
    """

    def run(source):
        pieces = PieceIds.shared(tokenizer)
        for batch in source:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                whole = pieces.ids_of([t if len(t) <= chunk else "" for t in texts])
                rows = []
                for doc, text, ids in zip(part.column("doc_id").to_pylist(), texts, whole, strict=True):
                    got = (len(ids) // pieces.dtype.itemsize, 1, 0) if len(text) <= chunk else spliced_count(text, pieces.tokenizer, chunk, overlap)
                    rows.append((doc, len(text.encode("utf-8", "surrogatepass")), *got))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _COUNTS_DDL).withColumn("over_limit", F.col("n_tokens") > limit)
