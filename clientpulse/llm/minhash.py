"""MinHash near-dedup with odd sketches.

A document's set is its distinct shingles of ``SHINGLE`` words, A-Z lower-cased,
hashed to 64 bits. Documents of equal sets are one class, and only one per class
goes on. ``BANDS`` hashes of ``ROWS`` MinHash values each put classes of similar sets
into common buckets: two sets of similarity 0.75 miss each other in all bands in 5 of
a million cases. The smallest values of one more permutation, those below a limit
halved until at most ``MOST_SAMPLES`` are left (all of a small set), are folded into a
parity bitmap, the odd sketch. The population count of the XOR of two sketches tells
how many samples differ; a pair is dropped where that is more than ``SIGMAS`` standard
deviations above what a pair at the threshold shows (one such pair in millions). Pairs
with different limits are not tested. What is left is confirmed on the full sets.

A bucket never becomes pairs of all its classes. First each class is paired with the
most popular class of its buckets, the one that meets most others over all bands, as
an original does its edited copies; confirmed links are joined into components. Then
only buckets that still hold several components are looked at, and there only the
classes outside a bucket's largest component are compared with the others. So every
two classes of a bucket are in one component, or were refused.

Defined cases: a text of fewer words than a shingle has one shingle, all its words;
a null text, or one without words, has none and is linked with nothing. Equal rows
and copies share a class. A component's id is its smallest doc_id; null ids are
passed over, and a component of null ids only has a null id and stays. Rows that
agree in id and text stay or go together. Extra columns, whatever their names, come
along in ``drop_near_copies``. Empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.bitmap import bitmap_bits, marked, set_bitmap, text_keys
from clientpulse.llm.common import Scratch, fresh, quoted, slices, text_of
from clientpulse.llm.components import connected
from clientpulse.llm.hashing import STEP, gram_hashes, mix, word_hashes

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
MOST_SAMPLES = 2048
SKETCH_BITS = 4096
SIGMAS = 5.0
_rng = np.random.default_rng(10)
FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
BAND_FACTORS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower changes A-Z only."""
    return np.unique(gram_hashes(word_hashes(text.encode().lower()), SHINGLE))


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the sample functions over the set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        values = shingles[None, i : i + 2048] * FACTORS[:, None] + OFFSETS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_hashes(mins: np.ndarray) -> np.ndarray:
    parts = (mix(mins).reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mix(parts + np.arange(BANDS, dtype=np.uint64) * STEP)


def odd_sketch(shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Parities of the positions of the samples, as 64-bit words; the number of samples;
    and how often the limit was halved for it. The set is sorted, so the samples are its
    first values."""
    level = max(0, (len(shingles) - 1).bit_length() - MOST_SAMPLES.bit_length() + 1)
    if level:
        shingles = shingles[: np.searchsorted(shingles, np.uint64(1 << (64 - level)))]
    positions = mix(shingles + STEP) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(positions.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64), len(shingles), level


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add set size, set digest, band hashes and odd sketch to the rows; the last column
    is the text, which goes."""
    for batch in slices(batches):
        sizes, digests, bands, odds, counts, levels = [], [], [], [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            if len(found):
                odd, count, level = odd_sketch(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_hashes(samples(found)).view(np.int64))
                odds.append(odd)
                counts.append(count)
                levels.append(level)
            else:
                digests.append(None)
                bands.append(None)
                odds.append(None)
                counts.append(None)
                levels.append(None)
        arrays = [
            *batch.columns[:-1],
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array(bands, pa.list_(pa.int64())),
            pa.array(odds, pa.list_(pa.int64())),
            pa.array(counts, pa.int64()),
            pa.array(levels, pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k0", "k1", "n_shingles", "sid", "bands", "odd", "n_samples", "level"])


def confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the (a, b, text_a, text_b) rows whose full sets are similar."""
    for batch in slices(batches):
        a, b, text_a, text_b = batch.columns
        keep = np.zeros(batch.num_rows, dtype=bool)
        last, set_a = None, np.zeros(0, dtype=np.uint64)
        keys = a.to_pylist()
        for i in range(batch.num_rows):
            if keys[i] != last:
                last, set_a = keys[i], shingle_set(text_a[i].as_py())
            set_b = shingle_set(text_b[i].as_py())
            shared = len(np.intersect1d(set_a, set_b, assume_unique=True))
            keep[i] = 100 * shared >= THRESHOLD * (len(set_a) + len(set_b) - shared)
        yield batch.select([0, 1]).filter(pa.array(keep))


#: What the sketch test reads of a class.
SKETCH = ("odd", "n_samples", "level")


def alike(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """May two sketches stand for sets at the threshold? Of ``union`` samples such a pair
    shares that part, less the deviations of drawing samples and of parities."""
    part = THRESHOLD / 100
    differing = F.zip_with(a["odd"], b["odd"], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    z = F.aggregate(differing, F.lit(0), lambda total, n: total + n).cast("double")
    decay = F.greatest(1 - 2 * z / SKETCH_BITS, F.lit(1e-3))
    differ = -F.log(decay) * SKETCH_BITS / 2
    samples_of_both = a["n_samples"] + b["n_samples"]
    shared = (samples_of_both - differ) / 2
    # what a pair at the threshold would show
    union = samples_of_both / (1 + part)
    differ_there = 2 * samples_of_both * (1 - part) / (2 * (1 + part))
    decay_there = F.exp(-2 * differ_there / SKETCH_BITS)
    spread = SKETCH_BITS * (1 - decay_there * decay_there) / 4 - differ_there * decay_there * decay_there
    parities = F.greatest(spread, F.lit(0.0)) / (4 * decay_there * decay_there)
    drawing = union * part * (1 - part) * (1 - F.pow(F.lit(0.5), a["level"]))
    enough = shared >= part * union - SIGMAS * F.sqrt(drawing + parities) - 1
    return (a["level"] != b["level"]) | enough


def sketch_of(side: str) -> dict[str, Column]:
    return {c: F.col(f"{c}_{side}") for c in SKETCH}


class Classes:
    """The classes of equal sets of a table, and the links between them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.scratch = Scratch(docs.sparkSession, "minhash")
        self.texts = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        k0, k1 = text_keys(F.col("text"))
        id_type = docs.schema[id_col].dataType.simpleString()
        schema = f"doc_id {id_type}, k0 bigint, k1 bigint, n_shingles bigint, sid binary, bands array<bigint>, odd array<bigint>, n_samples bigint, level int"
        keyed = self.texts.select("doc_id", k0.alias("k0"), k1.alias("k1"), "text")
        self.rows = self.scratch.keep(keyed.mapInArrow(sketch_batches, schema))
        one = (
            self.rows.where(F.col("sid").isNotNull())
            .groupBy("sid")
            .agg(F.first(F.struct("k0", "k1", "bands", *SKETCH)).alias("one"), F.min("doc_id").alias("least_doc"))
        )
        # numbers that writing fixes
        self.reps = self.scratch.keep(
            one.select(F.monotonically_increasing_id().alias("rid"), "sid", "least_doc", "one.*")
        )

    def members(self) -> DataFrame:
        """(key, rid): the buckets of each class."""
        return self.reps.select("rid", F.explode("bands").alias("key"))

    def shared_members(self) -> DataFrame:
        """(key, rid, n) of buckets with ``n`` > 1 classes."""
        members = self.members()
        shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return members.join(shared, "key")

    def stars(self, shared: DataFrame) -> DataFrame:
        """Each class with the most popular class of each of its buckets."""
        met = shared.groupBy("rid").agg(F.sum("n").alias("met"))
        centers = shared.join(met, "rid").groupBy("key").agg(F.max_by("rid", F.struct("met", "rid")).alias("center"))
        pairs = shared.join(centers, "key").where("rid <> center")
        return pairs.select(F.least("center", "rid").alias("a"), F.greatest("center", "rid").alias("b")).distinct()

    def sketches(self, key: str, side: str) -> DataFrame:
        return self.reps.select(F.col("rid").alias(key), *(F.col(c).alias(f"{c}_{side}") for c in SKETCH))

    def pairs_alike(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs that pass the sketch test."""
        both = pairs.join(self.sketches("b", "b"), "b").join(self.sketches("a", "a"), "a")
        return both.where(alike(sketch_of("a"), sketch_of("b"))).select("a", "b")

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """(rid, text) of the classes in ``pairs``. A bitmap of their text keys keeps the
        other documents out of the shuffle."""
        wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        keys = self.scratch.keep(self.reps.select("rid", "k0", "k1").join(wanted, "rid"))
        bits = bitmap_bits(keys.count())
        bitmap = set_bitmap(keys, [F.col("k0"), F.col("k1")], bits)
        k0, k1 = text_keys(F.col("text"))
        near = marked(self.texts.select("text"), [k0, k1], bitmap, bits, "maybe").where("maybe")
        distinct = near.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.first("text").alias("text"))
        return self.scratch.keep(distinct.join(keys, ["k0", "k1"]).select("rid", "text"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs whose full sets are similar."""
        texts = self.texts_of(pairs)
        text_a = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
        text_b = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(text_b, "b").join(text_a, "a").select("a", "b", "text_a", "text_b")
        found = self.scratch.keep(both.mapInArrow(confirm_batches, "a bigint, b bigint"))
        self.scratch.drop(texts)
        return found

    def crossing(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of classes of one bucket and different components that may be similar."""
        placed = shared.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select(
            "key", "rid", F.coalesce("root", "rid").alias("root")
        )
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        mixed = (
            parts.groupBy("key")
            .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select("key", "main")
        )
        open_members = self.scratch.keep(placed.join(mixed, "key").join(self.reps.select("rid", *SKETCH), "rid"))
        few = open_members.where("root <> main").select(
            "key", F.col("rid").alias("x"), F.col("root").alias("root_x"), *(F.col(c).alias(f"{c}_x") for c in SKETCH)
        )
        every = open_members.select(
            "key", "main", F.col("rid").alias("y"), "root", *(F.col(c).alias(f"{c}_y") for c in SKETCH)
        )
        met = few.join(every, "key").where(
            (F.col("root_x") != F.col("root"))
            & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("y")))
            & alike(sketch_of("x"), sketch_of("y"))
        )
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def roots(self) -> DataFrame:
        """(node, root) of the linked classes."""
        keep = self.scratch.keep
        shared = keep(self.shared_members())
        first = keep(self.pairs_alike(self.stars(shared)))
        links = self.confirmed(first)
        roots = keep(connected(links, self.scratch))
        rest = keep(self.crossing(shared, roots).join(first, ["a", "b"], "left_anti"))
        self.scratch.drop(shared)
        if rest.isEmpty():
            return roots
        return keep(connected(links.unionByName(self.confirmed(rest)), self.scratch))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; and the text keys."""
    classes = Classes(docs, id_col, text_col)
    roots = classes.roots()
    placed = classes.reps.select("rid", "sid", "least_doc").join(
        roots.withColumnRenamed("node", "rid"), "rid", "left"
    ).withColumn("root", F.coalesce("root", "rid"))
    least = placed.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    of_class = placed.join(least, "root").select(F.col("sid").alias("class"), "component_id")
    rows = classes.rows.select("doc_id", "n_shingles", "sid", "k0", "k1")
    joined = rows.join(of_class, F.col("sid") == F.col("class"), "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "k0", "k1").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def near_table(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component. Documents that no bitmap of the
    dropped texts marks pass straight through; the others meet the dropped rows."""
    gone = Scratch(docs.sparkSession, "near-drops").keep(
        near_groups(docs, id_col, text_col).where("not kept").select("doc_id", "k0", "k1").distinct()
    )
    bits = bitmap_bits(gone.count())
    keys = text_keys(text_of(text_col))
    flag, g, g0, g1 = fresh(docs.columns, "maybe", "g", "g0", "g1")
    flagged = marked(docs, keys, set_bitmap(gone, [F.col("k0"), F.col("k1")], bits), bits, flag)
    side = gone.select(F.col("doc_id").alias(g), F.col("k0").alias(g0), F.col("k1").alias(g1))
    same = (keys[0] == F.col(g0)) & (keys[1] == F.col(g1)) & quoted(id_col).eqNullSafe(F.col(g))
    rest = flagged.where(quoted(flag)).join(side, same, "left_anti")
    columns = [quoted(c) for c in docs.columns]
    return flagged.where(~quoted(flag)).select(*columns).unionByName(rest.select(*columns))
