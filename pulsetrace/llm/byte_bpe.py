"""Byte-level BPE: encoding without a regular expression, and decoding.

Pre-tokenisation of a whole batch of texts: an array of codepoint classes becomes an array of symbols (a class, with
what follows where the split pattern looks ahead), and each symbol is a function from states to states. These
functions compose associatively: every block of the array is composed on its own, block results are scanned by
doubling, and a second sweep from the known states marks the starts of pieces. Each piece, a slice of the text's
bytes, is merged once by rank and kept in a bounded cache; byte offsets of the tokens are kept beside the ids.

Ranks come from a vocabulary file whose path is a parameter; its bytes (under a megabyte) travel with the task.

Defined cases. Null text: encoded like the empty text, no tokens. Unpaired surrogates cannot occur in Spark
strings. Repeated rows: each its own row. A text of any length is encoded whole; a batch is cut into runs of about
``RUN_CHARS`` characters between texts. Empty table: empty result. Extra columns pass through; a column named
like an output column is replaced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsetrace.llm.common import OWN, named, numbered, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Symbols. A1, A2: an apostrophe that may open a contraction of one or two letters. SPACE: a blank before anything
# but white space; WHITE: other white space before such; GAP: white space before more of it or the end.
L, N, O, A1, A2, SPACE, WHITE, GAP, END = range(9)
# States: the piece that is open. PREFIX: a blank that joins what follows; C1, C2: letters of a contraction to come;
# FRESH: none.
IN_L, IN_N, IN_O, PREFIX, IN_GAP, C1, C2, FRESH = range(8)
STATES = 8
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTINEL = 0x110000
BLOCK = 256
RUN_CHARS = 1 << 20
CACHE = 300_000
#: Pieces longer than this are merged with a heap, and not kept.
LONG = 64


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by symbol * STATES + state."""
    step, cut = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)

    def joins(symbol: int, states: dict[int, int], otherwise: int) -> None:
        step[symbol] = otherwise
        for state, after in states.items():
            step[symbol, state], cut[symbol, state] = after, False

    joins(L, {IN_L: IN_L, PREFIX: IN_L, C1: FRESH, C2: C1}, IN_L)
    joins(N, {IN_N: IN_N, PREFIX: IN_N}, IN_N)
    joins(O, {IN_O: IN_O, PREFIX: IN_O}, IN_O)
    joins(A1, {IN_O: IN_O, PREFIX: IN_O}, C1)
    joins(A2, {IN_O: IN_O, PREFIX: IN_O}, C2)
    joins(SPACE, {}, PREFIX)
    joins(WHITE, {}, FRESH)
    joins(GAP, {IN_GAP: IN_GAP}, IN_GAP)
    joins(END, {}, FRESH)
    return step.ravel(), cut.ravel()


STEP, CUT = automaton()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: L, N, O, GAP for white space, END for the sentinel. Built once per process."""
    if not _classes:
        table = np.full(SENTINEL + 1, O, np.uint8)
        first = np.array([unicodedata.category(chr(c))[0] for c in range(SENTINEL)])
        table[:-1][first == "L"], table[:-1][first == "N"] = L, N
        table[WHITE_SPACE], table[SENTINEL] = GAP, END
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; texts are closed by the sentinel, which ends every look ahead."""
    out = classes()[points]
    white = np.flatnonzero(out == GAP)
    solid = white[np.append(out, END)[white + 1] < GAP]
    out[solid] = np.where(points[solid] == 0x20, SPACE, WHITE)
    ahead = np.append(points, [SENTINEL, SENTINEL])
    quote = np.flatnonzero(points == 0x27)
    after, then = ahead[quote + 1], ahead[quote + 2]
    for opening in ("re", "ve", "ll"):
        out[quote[(after == ord(opening[0])) & (then == ord(opening[1]))]] = A2
    out[quote[np.isin(after, [ord(c) for c in "stmd"])]] = A1
    return out


def starts(symbol: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol, by a blocked scan over composed transition functions."""
    blocks = -(-len(symbol) // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[: len(symbol)] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(STATES)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for column in columns:
        whole = STEP.take(column[:, None] + whole)
    # Inclusive scan by doubling: after the round of width w each row composes the 2w blocks up to its own.
    width = 1
    while width < blocks:
        later = np.take_along_axis(whole[width:], whole[:-width].astype(np.int64), axis=1)
        whole = np.concatenate([whole[:width], later])
        width *= 2
    state = np.concatenate([[np.uint8(FRESH)], whole[:-1, FRESH]])
    cut = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column + state
        cut[j] = CUT.take(at)
        state = STEP.take(at)
    return np.ascontiguousarray(cut.T).ravel()[: len(symbol)]


def pieces(texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
    """UTF-8 bytes and piece borders (byte offsets, 0 and the end included) of each text."""
    points = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), SENTINEL) for t in texts])
    cut = starts(symbols(points))
    ends = np.flatnonzero(points == SENTINEL)
    sizes = (points >= 0x80).astype(np.uint8)
    sizes += points >= 0x800
    sizes += points >= 0x10000
    sizes += 1
    sizes[ends] = 0
    offset = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.flatnonzero(cut)
    first = 0
    for text, end in zip(texts, ends):
        lo, hi = np.searchsorted(at, [first, end + 1])
        yield text.encode("utf-8", "surrogatepass"), (offset[at[lo:hi]] - offset[first]).tolist()
        first = end + 1


class Merger(dict):
    """Piece -> packed token ids; a missing piece is merged by rank and kept while there is room."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        known = self.ranks.get(piece)
        ids = [known] if known is not None else self.short(piece) if len(piece) <= LONG else self.long(piece)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def short(self, piece: bytes) -> list[int]:
        parts = [piece[i: i + 1] for i in range(len(piece))]
        ranks, none = self.ranks, 1 << 60
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def long(self, piece: bytes) -> list[int]:
        """Same merges with a heap of (rank, start) over a linked list; an outdated entry no longer fits its span."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(piece[i: after[j]])) is not None:
                heapq.heappush(heap, (rank, i, after[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            gone = after[i]
            alive[gone], after[i] = False, end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i: after[i]]])
            i = after[i]
        return out


_mergers: dict[int, Merger] = {}


def merger(vocabulary: bytes) -> Merger:
    key = hash(vocabulary)
    if key not in _mergers:
        _mergers[key] = Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a})
    return _mergers[key]


def encode_texts(texts: list[str], merge: Merger) -> Iterator[bytes]:
    """Packed ids (little-endian, 32 bits) of each text."""
    run: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text) + 1
        if size >= RUN_CHARS or i == len(texts) - 1:
            for data, borders in pieces(run):
                yield b"".join([merge[data[a:b]] for a, b in zip(borders, borders[1:])])
            run, size = [], 0


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str = VOCABULARY, column: str = "text") -> DataFrame:
    """Adds ``tokens`` (packed little-endian 32-bit ids) and ``token_ends`` (byte offset after each token, packed alike)."""
    vocabulary = read_vocabulary(path)
    names = [c for c in docs.columns if c not in ("tokens", "token_ends")]
    kept = numbered(docs.select(*[named(c) for c in names]))
    schema = kept.schema.add("tokens", "binary").add("token_ends", "binary")
    rows = docs.select(*[named(c).alias(OWN + str(i)) for i, c in enumerate(names)], text_of(column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(vocabulary)
        lengths = np.zeros(max(merge.ranks.values()) + 1, np.uint32)
        for token, rank in merge.ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            # A batch is taken in slices, so that a few texts' worth of arrays is all that is held.
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                packed = list(encode_texts(part.column(part.num_columns - 1).to_pylist(), merge))
                ends = [np.cumsum(lengths[np.frombuffer(p, "<u4")], dtype="<u4").tobytes() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(packed, pa.binary()), pa.array(ends, pa.binary())],
                    names=[*part.schema.names[:-1], "tokens", "token_ends"])

    return rows.mapInArrow(run, schema).toDF(*names, "tokens", "token_ends")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the bytes of the text, to rows with ``tokens``."""
    vocabulary = read_vocabulary(path)
    names = [c for c in encoded.columns if c not in ("decoded", "tokens")] + ["tokens"]
    rows = numbered(encoded.select(*[named(c) for c in names]))
    schema = numbered(encoded.select(*[named(c) for c in names])).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = merger(vocabulary).ranks
        words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            words[rank] = token
        for batch in batches:
            out = [b"".join(map(words.__getitem__, np.frombuffer(p or b"", "<u4").tolist()))
                   for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema).toDF(*names, "decoded")

