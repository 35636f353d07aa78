"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles of ``SHINGLE`` words, A-Z lower-cased, hashed
to 64 bits. Two documents link at a similarity of ``PERCENT`` or more; linked ones form
components. Documents of equal sets are one class, and one per class is joined.

* **Screen.** A set that links shares at least ``PERCENT`` of itself with another one. So
  a document with more shingles than the rest of its size that occur nowhere else is
  left out. Shingles meet in fragments of the hash space (``fragments.py``), packed by
  task. A third of the space is enough to rule out most documents; short ones, whose
  share of that third varies, send all. Then classes are screened on their whole sets.
* **Order.** The shingles left are ordered by how many classes hold them, in powers of
  two, then by hash, rare ones first. The order is cut into fragments of about equal
  mass, and each set into segments by fragment.
* **Candidates.** Linked sets share one of the first shingles of each in the order, so
  many that what follows them cannot make up the overlap; shingles of one class alone
  come first and meet nobody. Pairs must agree in size and in a parity bitmap of
  ``PARITY_BITS``: the bits that differ are never more than the shingles that differ.
* **Count.** A pair's segments meet fragment by fragment, each giving a partial overlap;
  the sum per pair is the size of the intersection, and decides.

A shingle that n classes share never becomes n * n pairs of one group: each class meets
the most popular class of its shingles first; links make components; then only classes
outside the largest component of a shingle meet the others, by size range, one side dealt
to as many parts as the shingle's classes need. So every two classes with a common early
shingle are in one component or were compared.

Defined cases: a text of fewer words than a shingle has one shingle, all its words; a
null text, or one without words, has none and is linked with nothing. Equal rows and
copies share a class. A component's id is its smallest doc_id; null ids are passed over,
and a component of null ids only has a null id. Other columns do not matter. Empty
tables give empty results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import bitmap_bits, marked, set_bitmap, text_keys
from clientpulse.llm.common import Scratch, quoted, slices, text_of
from clientpulse.llm.components import connected
from clientpulse.llm.fragments import PACK_ITEMS, chunks_of, fragment_count, fragment_of, runs_of, slices_of
from clientpulse.llm.hashing import IS_SPACE, gram_hashes, mix, word_hashes

SHINGLE = 5
PERCENT = 80
#: Sets up to this size are screened on all their shingles.
SHORT = 80
#: One in so many parts of the hash space screens longer sets.
SCREEN = 3
PARITY_BITS = 1024
MOST_SLOTS = 60_000
NO_SLOT = 0xFFFF
#: Rows of a hot key that go to one part.
PART_ROWS = 2000
BYTES_PER_ITEM = 6


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower changes A-Z only."""
    words = [word_hashes(part.tobytes()) for _, part in chunks_of(text.encode().lower(), IS_SPACE)]
    return np.unique(gram_hashes(np.concatenate(words), width)) if words else np.zeros(0, dtype=np.uint64)


def in_screen(grams: np.ndarray) -> np.ndarray:
    return mix(grams) % np.uint64(SCREEN) == 0


class Pack:
    """Sets of one pack: what they send to the fragments and are judged by."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.items, self.judged, self.sizes = names, [], [], [], []
        self.n_items = 0

    def add(self, row: tuple, grams: np.ndarray, whole: bool, percent: int) -> None:
        n = len(grams)
        judged = np.ones(n, dtype=bool)
        if not whole and n > SHORT:
            judged = in_screen(grams)
            if n * percent > SHORT * 100:  # else a set that is judged whole may be near
                grams, judged = grams[judged], judged[judged]
        self.rows.append(row)
        self.items.append(grams)
        self.judged.append(judged)
        self.sizes.append(len(grams))
        self.n_items += len(grams)

    def full(self) -> bool:
        return self.n_items >= PACK_ITEMS // 2 or len(self.rows) >= MOST_SLOTS

    def batches(self, batch: int, fragments: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        items, judged = np.concatenate(self.items), np.concatenate(self.judged)
        slots = np.repeat(np.arange(len(self.rows)), self.sizes)
        order = np.argsort(items, kind="stable")
        items, judged, slots = items[order], judged[order], slots[order]
        first, counts = runs_of(items)
        again = np.repeat(counts > 1, counts)
        n = len(self.rows)
        columns = dict(zip(self.names, zip(*self.rows)))
        columns |= {
            "batch": [batch] * n,
            "slot": range(n),
            "judged": np.bincount(slots[judged], minlength=n),
            "met": np.bincount(slots[judged & again], minlength=n),
        }
        yield record(columns, n, schema)
        alone, more = first[counts == 1], first[counts > 1]
        slot_of = np.where(judged[alone], slots[alone], NO_SLOT).astype(np.uint16)
        parts: dict[int, list[bytes]] = {}
        for which, at in ((0, alone), (2, more)):
            for name, i, j in slices_of(fragment_of(items[at], fragments)):
                row = parts.setdefault(name, [b"", b"", b""])
                row[which] = items[at[i:j]].astype(np.uint32).tobytes()
                if which == 0:
                    row[1] = slot_of[i:j].tobytes()
        if parts:
            low, own, many = zip(*parts.values())
            columns = {"batch": [batch] * len(parts), "fragment": list(parts), "low": low, "slots": own, "many": many}
            yield record(columns, len(parts), schema)


def record(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


MESSAGE = "batch bigint, slot int, judged bigint, met bigint, fragment bigint, low binary, slots binary, many binary"


def packer(sets: Callable, names: list[str], fragments: int, whole: bool, percent: int):
    """``sets`` turns a batch into (row, set) pairs; ``names`` are the row's, the first one a
    column of the batch, the others numbers. A pack's number is that of the task and its
    turn in it, so a repeated task gives the same."""
    numbers = [(name, pa.int64()) for name in names[1:]]
    own = [("batch", pa.int64()), ("slot", pa.int32()), ("judged", pa.int64()), ("met", pa.int64()), ("fragment", pa.int64())]
    sent = [("low", pa.binary()), ("slots", pa.binary()), ("many", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        pack = schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(names[0]), *numbers, *own, *sent])
            for row, grams in sets(batch):
                pack = pack or Pack(names)
                pack.add(row, grams, whole, percent)
                if pack.full():
                    yield from pack.batches(number, fragments, schema)
                    number, pack = number + 1, None
        if pack:
            yield from pack.batches(number, fragments, schema)

    return run


def text_sets(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """From (doc_id, k0, k1, text): (doc_id, k0, k1, n, s0, s1) and the set."""
    for part in slices([batch]):
        ids, k0, k1, texts = (c.to_pylist() for c in part.columns)
        for i, text in enumerate(texts):
            grams = shingle_set(text)
            s0, s1 = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), dtype=np.int64).tolist()
            yield (ids[i], k0[i], k1[i], len(grams), s0, s1), grams


def class_sets(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """From (rid, n, grams): (rid, n) and the set."""
    for part in slices([batch]):
        grams = part.column(2)
        for rid, n, i in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), range(part.num_rows)):
            yield (rid, n), grams[i].values.to_numpy(zero_copy_only=False).view(np.uint64)


def met_elsewhere(table: pa.Table) -> pa.Table:
    """The slots of each pack whose item another pack has, too; a slot per item."""
    low = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
    slots = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint16)
    many = np.frombuffer(b"".join(table["many"].to_pylist()), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(x) for x in low])
    items = np.concatenate([*low, many])
    order = np.argsort(items, kind="stable")
    first, counts = runs_of(items[order])
    in_many = np.zeros(len(items), dtype=bool)
    in_many[len(row) :] = True
    hit = (counts > 1) | np.logical_or.reduceat(in_many[order], first) if len(first) else counts > 1
    met = np.zeros(len(items), dtype=bool)
    met[order] = np.repeat(hit, counts)
    met = met[: len(row)] & (slots != NO_SLOT)
    batches = table["batch"].to_pylist()
    found = [(batches[name], slots[met][i:j].tobytes()) for name, i, j in slices_of(row[met])]
    batch, own = zip(*found) if found else ((), ())
    return pa.table({"batch": pa.array(batch, pa.int64()), "slots": pa.array(own, pa.binary())})


def met_counts(table: pa.Table) -> pa.Table:
    counts = np.bincount(np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint16))
    slot = np.flatnonzero(counts)
    batch = np.full(len(slot), table["batch"][0].as_py())
    return pa.table({"batch": batch, "slot": slot.astype(np.int32), "more": counts[slot]})


def screened(sent: DataFrame, percent: int) -> DataFrame:
    """The rows of ``sent`` that may link: those whose judged shingles occur elsewhere, but
    for a part of the set that a link allows."""
    met = (
        sent.where("fragment is not null")
        .select("batch", "fragment", "low", "slots", "many")
        .groupBy("fragment")
        .applyInArrow(met_elsewhere, "batch bigint, slots binary")
        .groupBy("batch")
        .applyInArrow(met_counts, "batch bigint, slot int, more bigint")
    )
    rows = sent.where("fragment is null").drop("fragment", "low", "slots", "many")
    alone = F.col("judged") - F.col("met") - F.coalesce("more", F.lit(0))
    return (
        rows.join(met, ["batch", "slot"], "left")
        .where((F.col("n") > 0) & (alone * 100 <= F.col("n") * (100 - percent)))
        .drop("batch", "slot", "judged", "met", "more")
    )


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n, parity, grams) of (rid, text) rows."""
    for batch in slices(batches):
        sizes, parities, sets = [], [], []
        for text in batch.column(1).to_pylist():
            grams = shingle_set(text)
            bits = (np.bincount((mix(grams) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)
            sizes.append(len(grams))
            parities.append(np.packbits(bits).view(np.int64))
            sets.append(grams.view(np.int64))
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(parities, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["rid", "n", "parity", "grams"])


def near_enough(x: str, y: str, percent: int) -> Column:
    """Do sizes and parity bitmaps of two sides allow a link?"""
    n_x, n_y = F.col(f"n_{x}"), F.col(f"n_{y}")
    bits = F.zip_with(f"parity_{x}", f"parity_{y}", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    sizes = F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent
    return sizes & (differ * (100 + percent) <= (n_x + n_y) * (100 - percent))


class Join:
    """The classes of a table and their links."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int):
        self.percent = percent
        self.scratch = Scratch(docs.sparkSession, "ngram-join")
        self.texts = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        id_type = docs.schema[id_col].dataType.simpleString()
        k0, k1 = text_keys(F.col("text"))
        size = self.texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        names = ["doc_id", "k0", "k1", "n", "s0", "s1"]
        run = packer(text_sets, names, fragment_count(size // BYTES_PER_ITEM // SCREEN), False, percent)
        schema = f"doc_id {id_type}, k0 bigint, k1 bigint, n bigint, s0 bigint, s1 bigint, {MESSAGE}"
        self.sent = self.scratch.keep(self.texts.select("doc_id", k0.alias("k0"), k1.alias("k1"), "text").mapInArrow(run, schema))
        self.rows = self.sent.where("fragment is null").select("doc_id", "n", "s0", "s1")
        # numbers that writing fixes
        self.classes = self.scratch.keep(
            screened(self.sent, percent)
            .groupBy("s0", "s1")
            .agg(F.min("doc_id").alias("least_doc"), F.first(F.struct("k0", "k1")).alias("one"))
            .select(F.monotonically_increasing_id().alias("rid"), "s0", "s1", "least_doc", "one.*")
        )

    def sets(self) -> DataFrame:
        """(rid, n, parity, grams) of the classes that may link to another class."""
        keys = self.classes.select("rid", "k0", "k1")
        bits = bitmap_bits(keys.count())
        k0, k1 = text_keys(F.col("text"))
        bitmap = set_bitmap(keys, [F.col("k0"), F.col("k1")], bits)
        near = marked(self.texts.select("text"), [k0, k1], bitmap, bits, "maybe").where("maybe")
        one = near.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.first("text").alias("text"))
        texts = one.join(keys, ["k0", "k1"]).select("rid", "text")
        sets = self.scratch.keep(texts.mapInArrow(set_batches, "rid bigint, n bigint, parity array<bigint>, grams array<bigint>"))
        items = sets.agg(F.sum("n")).first()[0] or 0
        run = packer(class_sets, ["rid", "n"], fragment_count(items), True, self.percent)
        sent = self.scratch.keep(sets.select("rid", "n", "grams").mapInArrow(run, f"rid bigint, n bigint, {MESSAGE}"))
        alive = screened(sent, self.percent).select("rid")
        kept = self.scratch.keep(sets.join(alive, "rid"))
        self.scratch.drop(sets, sent)
        return kept

    def segments(self, sets: DataFrame) -> DataFrame:
        """(rid, n, level, part, grams): each set's shingles that others hold, by fragment of
        the global order; sorted within."""
        items = sets.select("rid", "n", F.explode("grams").alias("gram"))
        level = F.floor(F.log2(F.count("*"))).cast("int")
        held = self.scratch.keep(items.groupBy("gram").agg(F.count("*").alias("holders"), level.alias("level")).where("holders > 1"))
        # one row per power of two
        mass = held.groupBy("level").agg(F.sum("holders").alias("mass")).collect()
        parts = F.lit(1).cast("long")
        for row in mass:
            parts = F.when(F.col("level") == row.level, F.lit(fragment_count(row.mass)).cast("long")).otherwise(parts)
        part = F.shiftright((F.shiftright("gram", 32) + F.lit(1 << 31)) * parts, 32)
        cut = (
            items.join(held.select("gram", "level"), "gram")
            .withColumn("part", part)
            .groupBy("rid", "n", "level", "part")
            .agg(F.sort_array(F.collect_list("gram")).alias("grams"))
        )
        return self.scratch.keep(cut)

    def members(self, segments: DataFrame) -> DataFrame:
        """(gram, rid, holders): the early shingles of each set that more than one has early."""
        whole = Window.partitionBy("rid")
        before = whole.orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
        size = F.size("grams").cast("long")
        need = F.expr(f"(n * {self.percent} + 99) div 100")
        early = F.sum(size).over(whole) - need + 1 - F.coalesce(F.sum(size).over(before), F.lit(0))
        firsts = (
            segments.withColumn("early", early)
            .where("early > 0")
            .select("rid", F.explode(F.slice("grams", 1, F.least("early", size).cast("int"))).alias("gram"))
        )
        firsts = self.scratch.keep(firsts)
        shared = firsts.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1")
        return self.scratch.keep(firsts.join(shared, "gram"))

    def stars(self, members: DataFrame, info: DataFrame) -> DataFrame:
        """(x, y): each class with the most popular class of each of its early shingles."""
        popular = members.groupBy("rid").agg(F.sum("holders").alias("met"))
        centers = members.join(popular, "rid").groupBy("gram").agg(F.max_by("rid", F.struct("met", "rid")).alias("y"))
        pairs = members.join(centers, "gram").where("rid <> y").select(F.col("rid").alias("x"), "y").distinct()
        met = pairs.join(self.side(info, "x"), "x").join(self.side(info, "y"), "y")
        return self.scratch.keep(met.where(near_enough("x", "y", self.percent)).select("x", "y", "n_x", "n_y"))

    @staticmethod
    def side(info: DataFrame, name: str) -> DataFrame:
        return info.select(F.col("rid").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"parity_{name}"))

    def links(self, pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """The pairs that link, by the sum of their partial overlaps. The second class of many
        pairs is dealt to parts."""
        share = pairs.groupBy("y").agg(F.floor(F.count("*") / PART_ROWS).cast("int").alias("last"))
        dealt = pairs.join(share, "y").withColumn("deal", F.pmod(F.xxhash64("x"), F.col("last") + 1).cast("int"))
        seg_x = segments.select(F.col("rid").alias("x"), "level", "part", F.col("grams").alias("grams_x"))
        seg_y = segments.select(F.col("rid").alias("y"), "level", "part", F.col("grams").alias("grams_y"))
        seg_y = seg_y.join(share, "y").withColumn("deal", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
        met = dealt.drop("last").join(seg_x, "x").join(seg_y, ["y", "level", "part", "deal"])
        partial = F.size(F.array_intersect("grams_x", "grams_y"))
        total = met.select("x", "y", "n_x", "n_y", partial.alias("overlap")).groupBy("x", "y", "n_x", "n_y").agg(F.sum("overlap").alias("overlap"))
        similar = F.col("overlap") * (100 + self.percent) >= (F.col("n_x") + F.col("n_y")) * self.percent
        return self.scratch.keep(total.where(similar).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))

    def crossing(self, members: DataFrame, info: DataFrame, roots: DataFrame) -> DataFrame:
        """(x, y) of classes with a common early shingle, different components, and a chance."""
        placed = members.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        parts = placed.groupBy("gram", "root").agg(F.count("*").alias("n"))
        mixed = (
            parts.groupBy("gram")
            .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select("gram", "main")
        )
        span = F.floor(F.log(F.col("n")) / F.log(F.lit(101 / self.percent)))
        last = F.floor(F.col("holders") / PART_ROWS).cast("int")
        left = self.scratch.keep(
            placed.join(mixed, "gram").join(info, "rid").select("gram", "root", "main", "rid", "n", "parity", span.alias("span"), last.alias("last"))
        )
        few = left.where("root <> main").select(
            "gram",
            F.col("root").alias("root_x"),
            F.col("rid").alias("x"),
            F.col("n").alias("n_x"),
            F.col("parity").alias("parity_x"),
            F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"),
            "last",
        ).withColumn("deal", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
        every = left.select(
            "gram",
            F.col("root").alias("root_y"),
            "main",
            F.col("rid").alias("y"),
            F.col("n").alias("n_y"),
            F.col("parity").alias("parity_y"),
            "span",
            F.pmod(F.xxhash64("rid"), F.col("last") + 1).cast("int").alias("deal"),
        )
        one_way = (F.col("root_y") == F.col("main")) | (F.col("x") < F.col("y"))
        met = few.join(every, ["gram", "span", "deal"]).where(
            (F.col("root_x") != F.col("root_y")) & one_way & near_enough("x", "y", self.percent)
        )
        return met.select("x", "y", "n_x", "n_y").distinct()

    def roots(self) -> DataFrame:
        """(node, root) of the linked classes."""
        sets = self.sets()
        info = self.scratch.keep(sets.select("rid", "n", "parity"))
        segments = self.segments(sets)
        members = self.members(segments)
        first = self.stars(members, info)
        links = self.links(first, segments)
        roots = self.scratch.keep(connected(links, self.scratch))
        seen = first.select("x", "y").unionByName(first.select(F.col("y").alias("x"), F.col("x").alias("y")))
        rest = self.scratch.keep(self.crossing(members, info, roots).join(seen, ["x", "y"], "left_anti"))
        if rest.isEmpty():
            return roots
        return self.scratch.keep(connected(links.unionByName(self.links(rest, segments)), self.scratch))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    join = Join(docs, id_col, text_col, percent)
    roots = join.roots()
    placed = join.classes.select("rid", "s0", "s1", "least_doc").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rid"))
    least = placed.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    of_class = placed.join(least, "root").select("s0", "s1", "component_id", F.lit(True).alias("met"))
    return join.rows.join(of_class, ["s0", "s1"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
