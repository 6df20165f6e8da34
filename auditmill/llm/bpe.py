"""Byte-level BPE: text to token ids and back.

Pre-tokenisation uses no regular expression.  Every character becomes a symbol (its class and
what follows it), every symbol a function between the states of a small automaton, and the
functions are composed by a prefix scan: composition is associative, so blocks are scanned side
by side and joined afterwards.  A piece starts where the automaton says so.  The slices go
through a cache of merged pieces.

Defined results: null or empty text has no tokens; texts are never cut; equal rows give equal
results; other columns are kept, an old column of an output's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from auditmill.llm.common import python_ready

# Symbols of the scan.
LETTER, NUMBER, OTHER, SPACE_BEFORE, BLANK_BEFORE, BLANK_INSIDE, SUFFIX_1, SUFFIX_2, RESET = range(9)
# States: inside letters, numbers, others; a space that joins what follows; inside blanks;
# a piece has just ended; one or two letters of an apostrophe suffix are still to come.
STATES = "letter number other space blank ended suffix1 suffix2".split()
#: The suffixes after an apostrophe that form a piece of their own.
SUFFIXES = ["s", "t", "m", "d", "re", "ve", "ll"]
SEPARATOR = 0x110000  # no character
BLOCK, WINDOW = 64, 1 << 19
CACHED_PIECES, CACHED_LENGTH, SHORT, UNKNOWN = 150_000, 48, 100, 1 << 40


def _step(state: str, symbol: int) -> tuple[str, bool]:
    """Next state, and whether a piece starts at this character."""
    if symbol == RESET:
        return "ended", False
    if symbol == LETTER:
        if state in ("suffix1", "suffix2"):
            return ("ended" if state == "suffix1" else "suffix1"), False
        return "letter", state not in ("letter", "space")
    if symbol == NUMBER:
        return "number", state not in ("number", "space")
    if symbol in (SUFFIX_1, SUFFIX_2) and state not in ("other", "space"):
        return ("suffix1" if symbol == SUFFIX_1 else "suffix2"), True
    if symbol in (OTHER, SUFFIX_1, SUFFIX_2):
        return "other", state not in ("other", "space")
    if symbol == SPACE_BEFORE:
        return "space", True
    if symbol == BLANK_BEFORE:
        return "ended", True
    return "blank", state != "blank"


@lru_cache(maxsize=1)
def automaton():
    """(function of each symbol, composition table, functions as state arrays, start flags)."""
    at = {s: i for i, s in enumerate(STATES)}
    start = np.zeros((len(STATES), 9), bool)
    known: dict[tuple, int] = {tuple(range(len(STATES))): 0}
    symbols = []
    for symbol in range(9):
        steps = [_step(s, symbol) for s in STATES]
        start[:, symbol] = [x[1] for x in steps]
        symbols.append(tuple(at[x[0]] for x in steps))
    todo = list(dict.fromkeys(symbols))
    while todo:  # all functions that compositions of symbols can give
        f = todo.pop()
        if f not in known:
            known[f] = len(known)
            todo += [tuple(g[x] for x in f) for g in symbols]
    functions = list(known)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    return np.array([known[f] for f in symbols], np.uint16), compose, np.array(functions, np.uint8), start


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, other; blanks as BLANK_INSIDE.

    Python's own tables are of an older Unicode version than those that the rank files are used
    with, so the members of each property are read once from the tokenizer library: it is shown
    all characters and returns those that have the property.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    table = np.full(SEPARATOR + 1, OTHER, np.uint8)
    for kind, has in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK_INSIDE, r"\s")):
        found = tiktoken.Encoding(has, pat_str=has, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    table[SEPARATOR] = RESET
    return table


def scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions, block by block."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros((BLOCK, rows), np.uint16)  # filled up with the identity
    grid.T.flat[:n] = functions
    for i in range(1, BLOCK):
        grid[i] = compose[grid[i - 1], grid[i]]
    before = scan(grid[-1], compose)
    grid[:, 1:] = compose[before[None, :-1], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Positions at which pieces start; ``codes`` are code points, texts apart by SEPARATOR.

    Works through windows of bounded size and hands the state on, so texts of any length fit.
    """
    symbol_function, compose, functions, start = automaton()
    table, found, state = classes(), [], STATES.index("ended")
    for a in range(0, len(codes), WINDOW):
        part = codes[a:a + WINDOW + 2]
        n = min(WINDOW, len(part))
        kind = table[part]
        symbol = kind[:n].copy()
        after = np.full(n, RESET, np.uint8)
        after[: len(kind) - 1] = kind[1:n + 1]
        last = (symbol == BLANK_INSIDE) & (after != BLANK_INSIDE) & (after != RESET)
        symbol[last] = np.where(part[:n][last] == 0x20, SPACE_BEFORE, BLANK_BEFORE)
        for i in np.flatnonzero(part[:n] == 0x27):
            follow = "".join(chr(c) for c in part[i + 1:i + 3] if c != SEPARATOR)
            if follow[:1] in SUFFIXES[:4] and follow:
                symbol[i] = SUFFIX_1
            elif follow in SUFFIXES[4:]:
                symbol[i] = SUFFIX_2
        after_each = functions[scan(symbol_function[symbol], compose), state]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = state, after_each[:-1]
        found.append(a + np.flatnonzero(start[before, symbol]))
        state = int(after_each[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Join the pair of lowest rank, leftmost first, until no pair is known."""
    if piece in rank:
        return [rank[piece]]
    if len(piece) > SHORT:
        return merge_long(piece, rank)
    cut = list(range(len(piece) + 1))
    known = [rank.get(piece[i:i + 2], UNKNOWN) for i in range(len(piece) - 1)]
    while known and (least := min(known)) < UNKNOWN:
        i = known.index(least)
        del known[i], cut[i + 1]
        if i:
            known[i - 1] = rank.get(piece[cut[i - 1]:cut[i + 1]], UNKNOWN)
        if i < len(known):
            known[i] = rank.get(piece[cut[i]:cut[i + 2]], UNKNOWN)
    return [rank[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def merge_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same in n log n by a heap, for pieces of any length."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := rank.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i:end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Piece to its ids as bytes; short pieces are remembered, and forgotten together when there are too many."""

    def __init__(self, rank):
        super().__init__()
        self.rank = rank

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge(piece.encode(), self.rank)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(ranks(path))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, where each starts, and how long it is."""
    rank = ranks(path)
    size = max(rank.values(), default=-1) + 1
    tokens = [b""] * size
    for token, i in rank.items():
        tokens[i] = token
    length = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers."""
    pieces, out = pieces_of(path), []
    codes, at = [], [0]
    gap = np.array([SEPARATOR], np.uint32)
    for text in texts:
        codes += [np.frombuffer(text.encode("utf-32-le"), np.uint32), gap]
        at.append(at[-1] + len(codes[-2]) + 1)
    if not texts:
        return out
    starts = piece_starts(np.concatenate(codes))
    cut = np.searchsorted(starts, at)
    for k, text in enumerate(texts):
        begin = (starts[cut[k]:cut[k + 1]] - at[k]).tolist()
        out.append(b"".join(map(pieces.__getitem__, map(text.__getitem__, map(slice, begin, [*begin[1:], len(text)])))))
    return out


def decode_ids(ids: np.ndarray, ends: np.ndarray, path: str) -> bytes:
    """Bytes of ``ids``; ``ends`` are the retained byte offsets at which tokens end.  Bounded slices at a time."""
    flat, first, length = vocabulary(path)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(ids), WINDOW // 4):
        part, stop = ids[a:a + WINDOW // 4], ends[a:a + WINDOW // 4].astype(np.int64)
        size = length[part]
        begin, total = int(stop[0] - size[0]), int(stop[-1])
        out[begin:total] = flat[np.repeat(first[part] - (stop - size), size) + np.arange(begin, total)]
    return out.tobytes()


def _batches(texts: list[str | None]):
    """Runs of texts of about one window of characters."""
    group, n = [], 0
    for text in texts:
        group.append(text or "")
        n += len(group[-1])
        if n >= WINDOW:
            yield group
            group, n = [], 0
    yield group


def _with(df: DataFrame, made: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    rest = df.drop(*[f.name for f in made])
    return rest, T.StructType([*rest.schema.fields, *made])


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids`` and ``token_ends``: binaries of little-endian unsigned 32-bit integers.

    ``token_ends`` holds the byte offset in the UTF-8 text at which each token ends.  ``path``
    is the rank file, readable on every executor.  The text column is kept.  With ``decoded``
    the ids are decoded again in the same pass and their bytes added, as by :func:`decode`.
    """
    made = [T.StructField(n, T.BinaryType(), False) for n in ("ids", "token_ends", *["decoded"] * decoded)]
    rest, schema = _with(df, made)
    kept = rest.columns

    def run(batches):
        for batch in batches:
            length = vocabulary(path)[2]
            ids = [x for group in _batches(batch[text].to_pylist()) for x in encode_texts(group, path)]
            ends = [np.cumsum(length[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() if x else b"" for x in ids]
            columns = [*[batch[n] for n in kept], pa.array(ids, pa.binary()), pa.array(ends, pa.binary())]
            if decoded:
                columns.append(pa.array([decode_ids(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), path) for a, b in zip(ids, ends, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return python_ready(rest).mapInArrow(run, schema)


def decode(df: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (binary) from ``ids`` and ``token_ends``; null ids decode to nothing."""
    _, schema = _with(df, [T.StructField("decoded", T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            pairs = zip(batch["ids"].to_pylist(), batch["token_ends"].to_pylist(), strict=True)
            out = [decode_ids(np.frombuffer(a or b"", "<u4"), np.frombuffer(b or b"", "<u4"), path) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in schema.names[:-1]], pa.array(out, pa.binary())], names=schema.names)

    return python_ready(df.drop("decoded")).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode whole texts; keep counts and SHA-256 digests in place of the texts."""
    both = encode(df, path, text, decoded=True).drop(text)
    made = {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    return both.withColumns(made).drop("ids", "token_ends", "decoded")
