"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

``Transducer`` compiles the ranks of a vocabulary into transitions on bytes, each
built when it is first taken. A state is what is still open of a piece: the last
token emitted before it, the open bytes, and the last token of the encoding of each
open prefix. The encoding of a prefix ends in the one token that may follow the
encoding of what is before it. Two tokens may follow each other if no merge across
their border would have come before the merges that made them, which a walk down
their merge trees tells. A token is emitted as soon as every token that could
still be read starts behind it, so the open bytes are a bounded lookahead (the
longest token, about). States met before are kept up to ``MOST_STATES``, then forgotten
and built again; of whole pieces met before the last one to two times ``MOST_PIECES``
stay known. Pieces that are a token themselves need no transition.

``decode_stream`` runs an incremental UTF-8 state machine over token bytes; bytes
that are no UTF-8 become U+FFFD, whole characters appear as soon as they are complete.

Each piece of the split pattern is encoded alone, without special tokens: their
strings are text. Null and empty texts give no ids. Long pieces take time linear in
their length. Equal texts get equal ids; other columns, whatever their names, are
not read, and ``encode`` returns one list of ids per row."""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.llm.common import quoted, slices, text_of
from clientpulse.session import ship_package

MOST_STATES = 500_000
MOST_PIECES = 500_000
MOST_PAIRS = 1_000_000
#: The same pattern for texts whose characters below U+0250 are letters, ASCII digits
#: and signs on which both regular expression libraries agree.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85²³¹¼-¾]")
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str):
    """Text to pieces."""
    full = regex.compile(pattern)
    if pattern != GPT_PATTERN:
        return full.findall
    return lambda text: PLAIN.findall(text) if NOT_PLAIN.search(text) is None else full.findall(text)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class State:
    __slots__ = ("edges", "flush", "last", "live", "open", "prefix")

    def __init__(self, last: int, open_bytes: bytes, prefix: tuple[int, ...], live: tuple[int, ...] = ()):
        self.last, self.open, self.prefix = last, open_bytes, prefix
        self.live = live  # where a token may start that goes on beyond the open bytes
        self.edges: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.flush: tuple[int, ...] | None = None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks, self.share = ranks, share
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.starts = {b[:i] for b in ranks for i in range(1, len(b) + 1)}
        self.ends = {b[i:] for b in ranks for i in range(len(b))}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.single = [bytes((b,)) for b in range(256)]
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(-1, b"", ())
        self.states: dict[tuple[int, bytes], State] = {(-1, b""): self.start}
        gc.collect()

    def merged_from(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own bytes joins; None for a byte,
        and for a token that its bytes do not merge to."""
        if token in self.halves:
            return self.halves[token]
        get, none = self.ranks.get, len(self.ranks) + (1 << 32)
        text = self.bytes_of[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        # lowest rank first, then leftmost
        while len(parts) > 2 and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
        found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self.halves[token] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """May token ``right`` come directly after ``left`` (-1: the start) in an encoding?"""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS * self.share:
                self.pairs.clear()
            made = len(self.bytes_of[right]) == 1 or self.merged_from(right) is not None
            found = self.pairs[key] = made and (left < 0 or self.stays_apart(left, right))
        return found

    def stays_apart(self, a: int, b: int) -> bool:
        """Does no merge across the border of two encoded tokens come first? The merges at the
        border are undone one by one, latest first; at each point the parts on both sides
        would have joined, were the rank of their pair lower than that of the merge that
        took one of them. Of equal ranks the left merge comes first."""
        get, text = self.ranks.get, self.bytes_of
        before = 1 << 62  # a merge across the border has to have a rank below
        while True:
            across = get(text[a] + text[b])
            if across is not None and across < before:
                return False
            from_a, from_b = self.merged_from(a), self.merged_from(b)
            if from_a is None and from_b is None:
                return True
            if from_b is None or (from_a is not None and a > b):
                before, a = a, from_a[1]
            else:
                before, b = b + 1, from_b[0]

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Build the transition of ``state`` on ``byte``: the next state, the tokens emitted."""
        text = state.open + self.single[byte]
        n, ranks, ends, starts, size = len(text), self.ranks, self.ends, self.starts, self.size
        before, pairs = state.prefix, self.pairs
        # tokens that end here, longest last
        ending, j = [], n - 1
        tail = text[j:]
        while tail in ends:
            token = ranks.get(tail)
            if token is not None:
                ending.append((j, token))
            if not j:
                break
            j -= 1
            tail = text[j:]
        end = -1
        while ending:
            j, token = ending.pop()
            left = before[j - 1] if j else state.last
            fits = pairs.get(left << 32 | token)
            if fits or (fits is None and self.follows(left, token)):
                end = token
                break
        prefix = before + (end,)
        # places where a later token may still start
        live = [j for j in state.live if text[j:] in starts]
        live.append(n - 1)
        # the last place that the encodings of all of them, and of the whole, pass
        cut = n
        for place in reversed(live):
            while place != cut:
                if place > cut:
                    place -= size[prefix[place - 1]]
                else:
                    cut -= size[prefix[cut - 1]]
            if not cut:
                break
        if cut:
            common = self.chain(prefix, cut)
            last, left_open = common[-1], text[cut:]
        else:
            common, last, left_open = (), state.last, text
        key = (last, left_open)
        target = self.states.get(key)
        if target is None:
            if len(self.states) >= MOST_STATES * self.share:
                self.reset()
            target = State(last, left_open, prefix[cut:], tuple([j - cut for j in live] if cut else live))
            self.states[key] = target
        edge = (target, tuple(common))
        state.edges[byte] = edge
        return edge

    def chain(self, prefix: tuple[int, ...], end: int) -> list[int]:
        """Tokens of the encoding of the open bytes up to ``end``."""
        out = []
        while end:
            token = prefix[end - 1]
            out.append(token)
            end -= self.size[token]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in piece:
            edge = state.edges.get(byte)
            if edge is None:
                edge = self.step(state, byte)
            state, emitted = edge
            if emitted:
                out += emitted
        if state.flush is None:
            state.flush = tuple(self.chain(state.prefix, len(state.open)))
        out += state.flush
        return out


class Encoder:
    """A transducer with the pieces it has met: their ids, and those as text. ``share`` is the
    part of ``MOST_STATES``, ``MOST_PIECES`` and ``MOST_PAIRS`` that it keeps; ids are the same."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.share = share
        self.transducer = Transducer(ranks, share)
        self.split = splitter(pattern)
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}

    def pieces_of(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Ids of each piece, joined by commas and as numbers."""
        known, out = self.known, []
        for piece in self.split(text):
            found = known.get(piece)
            if found is None:
                found = self.older.get(piece)
                if found is None:
                    ids = tuple(self.transducer.encode_piece(piece.encode()))
                    found = (",".join(map(str, ids)), ids)
                if len(piece) < 64:
                    if len(known) >= MOST_PIECES * self.share:
                        # what is still in use moves over from the older half
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.pieces_of(text)))


def decode_stream(chunks: Iterable[Iterable[int]], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of token ids. A character whose bytes are spread over tokens or
    chunks appears when its last byte has come."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        text = machine.decode(b"".join(map(bytes_of.__getitem__, chunk)))
        if text:
            yield text
    rest = machine.decode(b"", True)
    if rest:
        yield rest


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to every executor; its name there."""
    ship_package(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


@lru_cache(maxsize=2)
def encoder(name: str, pattern: str, share: float = 1.0) -> Encoder:
    """One per Python worker. Its states and pieces live long and are many, and only
    ``reset`` leaves reference cycles behind, so it alone has them collected."""
    gc.disable()
    with open(SparkFiles.get(name), "rb") as lines:
        return Encoder(read_ranks(lines), pattern, share)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    name = ship(docs.sparkSession, ranks_path)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            code = encoder(name, pattern)
            ids = [code.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    name = ship(encoded.sparkSession, ranks_path)
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = encoder(name, GPT_PATTERN).transducer.bytes_of
            texts = ["".join(decode_stream([ids or []], table)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def forget() -> None:
    """Give back the memory of the encoder that this worker has. All of it: parts of its tables
    freed one by one leave their pages in use."""
    encoder.cache_clear()
    gc.collect()


def digests(batch: pa.RecordBatch, code: Encoder) -> pa.RecordBatch:
    table = code.transducer.bytes_of
    counts, ids_digests, text_digests = [], [], []
    for text in batch.column(1).to_pylist():
        pieces = code.pieces_of(text)
        joined = ",".join([names for names, _ in pieces])
        ids = list(chain.from_iterable([numbers for _, numbers in pieces]))
        decoded = hashlib.sha256()
        parts = (ids[i : i + 4096] for i in range(0, len(ids), 4096))
        for part in decode_stream(parts, table):
            decoded.update(part.encode())
        counts.append(len(ids))
        ids_digests.append(hashlib.sha256(joined.encode()).hexdigest())
        text_digests.append(decoded.hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def digest_table(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", share: float = 1.0
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are encoded
    and decoded again text by text, so no list of ids leaves the task. ``share`` is that of
    ``Encoder``; below 1 a task also forgets its encoder at its end, as idle workers would
    keep it next to what other stages need."""
    name = ship(docs.sparkSession, ranks_path)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield digests(batch, encoder(name, pattern, share))
        if share < 1:
            forget()

    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
