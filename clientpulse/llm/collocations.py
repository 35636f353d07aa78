"""Phrase collocations from a weighted de Bruijn graph.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and pieces
into words. The longest grams, of ``MOST_WORDS`` words, are the edges of a graph whose
nodes are the grams of one word less; an edge's weight is the number of its occurrences.
A gram occurs as often as the edges that leave it weigh, plus the times that it ends a
piece: so only edges and piece ends are counted, and the counts of shorter grams follow
level by level from the flow through the nodes.

Three things keep the graph small; none changes a result.

* Two passes count hashed grams by fragments of the hash space, words and pairs first,
  then longer ones whose pairs are frequent, and keep those that may reach ``LEAST`` as
  bitmaps of bounded size (``MOST_BITS``). Every word of a text then gives one gram, the
  longest from there on that may be frequent with all its parts: an edge, or where it is
  shorter the end of a piece of the graph. Any frequent gram is a prefix of what its
  first word gives. A full bitmap only leaves more to count.
* A task builds the graph of half a million words at a time and compacts its
  unary paths: edges between nodes with one way in, one way out and no piece that starts
  or ends there have one weight and travel as one run of words.
* Edges and ends are combined before each shuffle, however frequent a phrase is.

A phrase is dropped when a longer one that holds it is as frequent; a chain of equal
counts leads from it to that one, so phrases longer by one word tell.

Counts, totals and texts are exact: hashes only choose what can be left out, and phrases
are compared as text. Products of the score are decimals of 38 digits, exact while
a * n is below 10**35.

Defined cases: null texts are empty, a null language is ``und``, rows are counted as
often as they occur, ids and other columns do not matter, and an empty table gives an
empty result. A text's pieces are cut at ASCII characters only; other blanks are letters
of words. Very long texts are hashed in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import words_of
from clientpulse.llm.common import Scratch, quoted, slices, text_of
from clientpulse.llm.fragments import chunks_of, fragment_count, fragment_of, runs_of, slices_of
from clientpulse.llm.hashing import BYTE_VALUES, STEP, mix, prefix_sums, run_hashes

MOST_WORDS = 5
LEAST = 100
TOP = 2000
BITS_PER_KEY = 32
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Words whose graph a task builds at a time, and grams it adds up before they leave it.
PACK_WORDS = 1 << 19
MOST_HELD = 250_000
#: Parts in which a language's best phrases are chosen before they meet.
TOP_PARTS = 1024
#: Bytes of text per word, to choose the number of fragments.
BYTES_PER_ITEM = 6
UNKNOWN = "und"

# fixed values: the characters that end a piece, and those between words
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b" \t"
IS_END = np.zeros(256, dtype=bool)
IS_END[list(PIECE_ENDS)] = True
IS_GAP = IS_END.copy()
IS_GAP[list(WORD_ENDS)] = True


class Words:
    """The words of a pack of texts, in order: hashes, byte ranges, and whether the next
    word follows in the same piece."""

    def __init__(self):
        self.raw: list[bytes] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n_words = 0
        self.langs: list[str] = []

    def add(self, text: str, lang: str) -> None:
        raw = text.encode().lower() + b"\n"
        seed = mix(np.array([hash_of(lang)], dtype=np.uint64))[0]
        for offset, data in chunks_of(raw, IS_END):
            inside = np.zeros(len(data) + 2, dtype=np.int8)
            inside[1:-1] = ~IS_GAP[data]
            change = np.diff(inside)
            starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            if not len(starts):
                continue
            hashes = mix(run_hashes(prefix_sums(BYTE_VALUES[data]), starts, ends) + seed)
            piece = np.cumsum(IS_END[data])[starts]
            follows = np.append(piece[1:] == piece[:-1], False)
            lang_of = np.full(len(starts), len(self.langs), dtype=np.int32)
            self.parts.append((hashes, starts + (self.size + offset), ends + (self.size + offset), follows, lang_of))
            self.n_words += len(starts)
        self.langs.append(lang)
        self.raw.append(raw)
        self.size += len(raw)

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.parts)]


def hash_of(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return run_hashes(prefix_sums(BYTE_VALUES[data]), np.array([0]), np.array([len(data)]))[0]


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    pack = Words()
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pack.add(text, lang)
            if pack.n_words >= PACK_WORDS:
                yield pack
                pack = Words()
    if pack.n_words:
        yield pack


def item_ids(items: np.ndarray, fragments: int) -> np.ndarray:
    """What a fragment knows an item by: the fragment and 32 bits."""
    return (fragment_of(items, fragments) << np.uint64(32)) | (items & np.uint64(0xFFFFFFFF))


def gram_sums(hashes: np.ndarray) -> np.ndarray:
    return prefix_sums(mix(hashes))


def extended_by(shorter: np.ndarray, follows: np.ndarray, k: int) -> np.ndarray:
    """Where a gram of ``k`` words of one piece starts whose two parts of k - 1 words pass."""
    out = np.zeros(len(shorter), dtype=bool)
    m = len(shorter) - k + 1
    if m > 0:
        out[:m] = shorter[:m] & shorter[1 : m + 1] & follows[k - 2 : k - 2 + m]
    return out


def grams_at(sums: np.ndarray, where: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the grams of ``k`` words that ``where`` marks, and their hashes."""
    at = np.flatnonzero(where)
    return at, run_hashes(sums, at, at + k)


def words_and_pairs(pack: Words) -> np.ndarray:
    hashes, _, _, follows, _ = pack.arrays()
    sums, every = gram_sums(hashes), np.ones(len(hashes), dtype=bool)
    return np.concatenate([grams_at(sums, every, 1)[1], grams_at(sums, extended_by(every, follows, 2), 2)[1]])


def longer_grams(test, width: int):
    """The grams of 3 to ``width`` words all of whose pairs pass."""

    def items(pack: Words) -> np.ndarray:
        hashes, _, _, follows, _ = pack.arrays()
        sums = gram_sums(hashes)
        passes, found = passed(sums, follows, test.value, 2), []
        for k in range(3, width + 1):
            passes = extended_by(passes, follows, k)
            found.append(grams_at(sums, passes, k)[1])
        return np.concatenate(found)

    return items


def counters(items, fragments: int):
    """The ``items`` of each pack with their counts, one row per fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches):
            found = np.sort(items(pack))
            first, counts = runs_of(found)
            found = found[first]
            names, low, many, times = [], [], [], []
            for name, i, j in slices_of(fragment_of(found, fragments)):
                short, n = found[i:j].astype(np.uint32), counts[i:j]
                names.append(name)
                low.append(short[n == 1].tobytes())
                many.append(short[n > 1].tobytes())
                times.append(n[n > 1].tobytes())
            arrays = [pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in (low, many, times))]
            yield pa.RecordBatch.from_arrays(arrays, names=["fragment", "low", "many", "times"])

    return run


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def frequent_items(least: int):
    """The ids of a fragment's items that may occur ``least`` times, as two hashes each."""

    def run(table: pa.Table) -> pa.Table:
        low, many = joined(table["low"], np.uint32), joined(table["many"], np.uint32)
        times = np.concatenate([np.ones(len(low), dtype=np.int64), joined(table["times"], np.int64)])
        items = np.concatenate([low, many])
        order = np.argsort(items, kind="stable")
        items, times = items[order], times[order]
        first, _ = runs_of(items)
        sums = np.add.reduceat(times, first) if len(first) else times
        found = items[first][sums >= least].astype(np.uint64)
        found |= np.uint64(table["fragment"][0].as_py()) << np.uint64(32)
        return pa.table({"h0": mix(found).view(np.int64), "h1": mix(found + STEP).view(np.int64)})

    return run


class Filter:
    """A bitmap of ids, tested on arrays. Ids of the set always pass."""

    def __init__(self, words: np.ndarray, bits: int, fragments: int):
        self.words, self.mask, self.fragments = words, np.uint64(bits - 1), fragments

    def __call__(self, items: np.ndarray) -> np.ndarray:
        ids = item_ids(items, self.fragments)
        hit = np.ones(len(ids), dtype=bool)
        for h in (mix(ids), mix(ids + STEP)):
            at = h & self.mask
            hit &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit


def frequent_filter(docs: DataFrame, scratch: Scratch, items, fragments: int, least: int):
    """A broadcast filter of the ``items`` of all packs that may occur ``least`` times."""
    packed = docs.mapInArrow(counters(items, fragments), "fragment bigint, low binary, many binary, times binary")
    found = scratch.keep(packed.groupBy("fragment").applyInArrow(frequent_items(least), "h0 bigint, h1 bigint"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, found.count() * BITS_PER_KEY) - 1).bit_length()))
    hits = found.select(F.explode(F.array(*(F.col(c).bitwiseAND(F.lit(bits - 1)) for c in ("h0", "h1")))).alias("position"))
    # bounded: at most MOST_BITS / 64 rows
    rows = words_of(hits.distinct()).toPandas()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64)
    scratch.drop(found)
    return docs.sparkSession.sparkContext.broadcast(Filter(words.view(np.uint64), bits, fragments))


def passed(sums: np.ndarray, follows: np.ndarray, test: Filter, width: int, before: np.ndarray | None = None, least: int = 1):
    """Where grams of ``width`` words start that pass the test with all their parts of
    ``least`` words and more; ``before`` tells where those of one word less do."""
    where = np.ones(len(follows), dtype=bool) if before is None else before
    for k in range(least, width + 1):
        where = where if k == 1 else extended_by(where, follows, k)
        at, grams = grams_at(sums, where, k)
        where = np.zeros(len(follows), dtype=bool)
        where[at[test(grams)]] = True
    return where


def pack_graph(pack: Words, short: Filter, long: Filter, width: int) -> Iterator[tuple[str, str | None, int]]:
    """(lang, words, weight): the compacted paths of a pack's graph; the grams where it ends,
    shorter than ``width``; and, without words, the number of words of each language."""
    hashes, starts, ends, follows, lang_of = pack.arrays()
    totals: dict[str, int] = {}
    for lang, n in zip(pack.langs, np.bincount(lang_of, minlength=len(pack.langs)).tolist()):
        totals[lang] = totals.get(lang, 0) + n
    for lang, n in totals.items():
        yield lang, None, n
    raw = b"".join(pack.raw)

    def text(i: int, j: int) -> str:
        return b" ".join(raw[starts[i] : ends[j - 1]].split()).decode() if j > i + 1 else raw[starts[i] : ends[i]].decode()

    # the longest gram that passes, at each word: an edge, or an end where it is shorter
    sums = gram_sums(hashes)
    where = passed(sums, follows, short, 1)
    for k in range(1, width):
        longer = passed(sums, follows, short if k < 2 else long, k + 1, where, k + 1)
        at, keys = grams_at(sums, where & ~longer, k)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        for i, n in zip(at[first].tolist(), counts.tolist()):
            yield pack.langs[lang_of[i]], text(i, i + k), n
        where = longer
    at, edge = grams_at(sums, where, width)
    if not len(at):
        return
    _, first, number, weight = np.unique(edge, return_index=True, return_inverse=True, return_counts=True)
    source, target = run_hashes(sums, at, at + width - 1), run_hashes(sums, at + 1, at + width)
    _, node = np.unique(np.concatenate([source, target]), return_inverse=True)
    source, target = node[: len(at)], node[len(at) :]
    out_degree = np.bincount(source[first], minlength=node.max() + 1)
    in_degree = np.bincount(target[first], minlength=node.max() + 1)
    unary = (out_degree == 1) & (in_degree == 1)
    goes_on = np.append(at[1:] == at[:-1] + 1, False)  # the next edge starts at the next word
    unary[source[np.concatenate([[True], ~goes_on[:-1]])]] = False
    unary[target[~goes_on]] = False
    shown = np.zeros(len(at), dtype=bool)
    shown[first] = True
    # the first showing of the edge behind a unary node follows the first showing before it
    bound = np.zeros(len(at), dtype=bool)
    bound[:-1] = goes_on[:-1] & shown[:-1] & shown[1:] & unary[target[:-1]]
    heads = np.flatnonzero(shown & ~np.concatenate([[False], bound[:-1]]))
    tails = np.flatnonzero(shown & ~bound)
    for i, j in zip(heads.tolist(), tails.tolist()):
        a, b = int(at[i]), int(at[j]) + width
        yield pack.langs[lang_of[a]], text(a, b), int(weight[number[i]])


PACKED = "fragment bigint, lang array<string>, words array<string>, n array<bigint>"


def graphs(short, long, width: int, fragments: int):
    """``pack_graph`` rows added up over a task's packs, ``MOST_HELD`` at a time: one row per
    fragment of the grams' hashes."""

    def packed(held: dict) -> pa.RecordBatch:
        parts: dict[int, list] = {}
        for key, n in held.items():
            parts.setdefault(xxhash.xxh64_intdigest("\n".join(map(str, key))) % fragments, []).append((*key, n))
        columns = [[[row[i] for row in rows] for rows in parts.values()] for i in range(3)]
        types = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
        arrays = [pa.array(list(parts), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))]
        return pa.RecordBatch.from_arrays(arrays, names=["fragment", "lang", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str | None], int] = {}
        for pack in packs(batches):
            for lang, words, n in pack_graph(pack, short.value, long.value, width):
                held[lang, words] = held.get((lang, words), 0) + n
                if len(held) >= MOST_HELD:
                    yield packed(held)
                    held.clear()
        yield packed(held)

    return run


def summed(table: pa.Table) -> pa.Table:
    """A fragment's grams, each with its weight over all packs."""
    names = ("lang", "words", "n")
    rows = pa.table({name: table[name].combine_chunks().flatten() for name in names})
    return rows.group_by(["lang", "words"]).aggregate([("n", "sum")]).rename_columns(list(names))


def gram_counts(docs: DataFrame, scratch: Scratch, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of the grams of up to ``width`` words that occur ``least`` times,
    and (lang, n) of all words. ``docs`` has lang and text, neither null."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = fragment_count(size // BYTES_PER_ITEM)
    short = frequent_filter(docs, scratch, words_and_pairs, fragments, least)
    long = frequent_filter(docs, scratch, longer_grams(short, width), fragments, least) if width > 2 else short
    packed = docs.mapInArrow(graphs(short, long, width, fragments), PACKED)
    rows = scratch.keep(packed.groupBy("fragment").applyInArrow(summed, "lang string, words string, n bigint"))
    totals = rows.where("words is null").groupBy("lang").agg(F.sum("n").alias("n"))
    split = F.split("words", " ")
    sized = rows.where("words is not null").withColumn("k", F.size(split))
    path = sized.where(F.col("k") >= width)
    steps = F.transform(
        F.sequence(F.lit(1), F.col("k") - (width - 1)), lambda i: F.array_join(F.slice(split, i, width), " ")
    )
    level = path.select("lang", F.explode(steps).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    levels = []
    for k in range(width, 0, -1):
        level = scratch.keep(level)
        levels.append(level.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n"))
        flow = level.select("lang", F.substring_index("phrase", " ", k - 1).alias("phrase"), "n")
        ends = sized.where(F.col("k") == k - 1).select("lang", F.col("words").alias("phrase"), "n")
        level = flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    grams = levels[0]
    for other in levels[1:]:
        grams = grams.unionByName(other)
    return scratch.keep(grams), totals


def undropped(grams: DataFrame) -> DataFrame:
    """The phrases of two words and more that no phrase longer by a word holds as often."""
    without_last = F.expr("substring_index(phrase, ' ', k - 1)")
    without_first = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    held = grams.where("k > 2").select(
        "lang", F.explode(F.array(without_last, without_first)).alias("phrase"), F.col("n").alias("longer")
    )
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return (
        grams.where("k > 1")
        .join(most, ["lang", "phrase"], "left")
        .where("longer is null or longer < n")
        .select("lang", "phrase", "k", F.col("n").alias("a"))
    )


def scored(phrases: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest score over the cuts of each phrase, with its l and r."""
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - k)").alias("right"),
    )
    side_l = grams.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    side_r = grams.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # one row per language
    met = cuts.join(side_l, ["lang", "left"]).join(side_r, ["lang", "right"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(18, 0)))")
    return (
        met.withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, ranked; chosen in parts first."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    chosen = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    chosen = chosen.where(F.col("rank") <= top).drop("part", "rank")
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    most_words: int = MOST_WORDS,
    least: int = LEAST,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to
    ``most_words`` words that occur ``least`` times."""
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"))
    grams, totals = gram_counts(rows, scratch, most_words, least)
    return best(scored(undropped(grams), grams, totals), top)
