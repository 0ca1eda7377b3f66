"""Near-dedup of word shingle sets by HyperMinHash.

Every document's shingle hashes are dealt to registers by their upper bits. A
register keeps the least of its hashes in a compressed form, the number of
leading zeros and the mantissa bits after them: 15 bits in place of 64. A register
without a hash borrows that of another one, by a fixed order of places, so that
short documents have whole bands too. Bands of registers are the keys under which
documents become candidates; a pair's equal own registers, less those expected to
collide by chance, estimate its similarity; pairs that may reach the threshold
are confirmed on their full sets.

Documents of equal sets are one class, and its least id stands for it. Within a
band key no pairs are enumerated as long as a star may do: all members are
compared with one hub, the one that shares most keys with others (of a group of
edited copies, that with fewest edits), and components are made of these links.
Only members left outside the main component of their key are then compared with
all other members, so that no link between components is missed; their sets go
along, and only linked pairs leave that join. Before that, the
shingles that no other document left has are counted: they can be in no overlap,
so they bound a document's similarity to any other from above, without loss. A
copy edited too much to be linked, or a text that shares one passage with many
others, is found alone by this bound and is compared with nobody.

Keys are counted by partial sums; joins on keys and hubs are split by the
adaptive skew join. Full sets are made only for documents that are in candidates.
With 32 bands of 4 registers a pair at the threshold of 0.8 misses all bands with
a chance below 1e-7, one above it with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.llm.components import components
from docspark.operators.small import broadcast_if_small

REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
BAND = 4
BANDS = REGISTERS // BAND
MANTISSA_BITS = 9
PERCENT = 80
# Standard deviations that an estimate may lie below the threshold.
MARGIN = 5.0
# Shingles of a set that goes along with its document's keys, 4 bytes each.
MAX_CARRIED = 4096
# Ids, of 8 bytes each, that are broadcast at most.
MAX_IDS = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; fewer words are one shingle."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    made = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(made)


def _lenders() -> np.ndarray:
    """For every register the others in an order of its own, that it borrows from."""
    places = np.arange(REGISTERS, dtype=np.uint64)
    order = _mixed((places[:, None] << np.uint64(32)) + places[None, :] + np.uint64(1))
    return np.argsort(order, axis=1).T


_LENDERS = _lenders()


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed least hash of each register; negative where it is borrowed, 0 for an empty set."""
    found = np.zeros(REGISTERS, dtype=np.int16)
    if len(shingles) == 0:
        return found
    place = (shingles >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))  # the sorted hashes of a register follow each other
    rest = (shingles[first] << np.uint64(REGISTER_BITS)) | np.uint64(1)
    zeros = np.clip(64 - np.frexp(rest.astype(np.float64))[1], 0, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    found[place[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.int16)
    own, missing = found.copy(), np.flatnonzero(found == 0)
    for lenders in _LENDERS:
        if not len(missing):
            break
        found[missing] = -own[lenders[missing]]
        missing = missing[found[missing] == 0]
    return found


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_id` and the hashes of the words, A-Z in lower case."""
    lowered = F.translate(F.col(text_col), _UPPER, _LOWER)
    return docs.select(
        F.col(id_col).alias("_id"), F.transform(common.words(lowered), lambda w: F.xxhash64(w)).alias("_words")
    )


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    words = batch.column(1)
    flat, ends = words.values.to_numpy(zero_copy_only=False).view(np.uint64), words.offsets.to_numpy()
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        yield shingle_set(flat[start:end], size)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`_id`, `_n` distinct shingles, `_digest` of the set and its registers, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s)) for s in _sets(batch, size)]
            columns = [
                batch.column(0),
                pa.array([n for n, _, _ in sets], pa.int64()),
                pa.array([d for _, d, _ in sets], pa.binary()),
                pa.array([r for _, _, r in sets], pa.list_(pa.int16())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_n", "_digest", "_registers"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, _n long, _digest binary, _registers array<smallint>"
    return common.map_in_arrow(word_hashes(docs, id_col, text_col), run, schema)


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`_id` and the whole set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.view(np.int64) for s in _sets(batch, size)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["_id", "_set"])

    schema = f"_id {dict(docs.dtypes)[id_col]}, _set array<bigint>"
    return common.map_in_arrow(word_hashes(docs, id_col, text_col), run, schema)


def _collisions() -> float:
    """Chance that registers of different least hashes are equal: the zeros and the mantissa bits agree."""
    return sum(2.0 ** (-2 * z) for z in range(1, 63)) * 2.0**-MANTISSA_BITS


def _with_own(rows: DataFrame) -> DataFrame:
    """Adds the own registers as numbers of place and value, and their places."""
    own = F.transform("_registers", lambda r, i: F.when(r > 0, i * (1 << 16) + r))
    return rows.withColumn("_own", F.array_compact(own)).withColumn(
        "_places", F.transform("_own", lambda x: F.shiftright(x, 16))
    )


def _may_link(own: tuple[str, str], places: tuple[str, str], percent: int) -> Column:
    """Whether the estimate, corrected for chance collisions, is within MARGIN deviations of the threshold."""
    equal = F.size(F.array_intersect(*own))
    used = (F.size(places[0]) + F.size(places[1]) - F.size(F.array_intersect(*places))).cast("double")
    chance = _collisions()
    corrected = (equal - chance * used) / ((1 - chance) * used)
    share = percent / 100
    return corrected >= share - MARGIN * F.sqrt(F.lit(share * (1 - share)) / used)


def _band_keys(reps: DataFrame) -> DataFrame:
    """One row per band: `_key` and `_id`."""
    values = reps.select("_id", F.transform("_registers", lambda r: F.abs(r)).alias("_values"))
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.slice("_values", b * BAND + 1, BAND)),
    )
    return values.select("_id", F.explode(keys).alias("_key"))


def _renamed(n: str) -> list[Column]:
    return [F.col("_n").alias(f"n{n}"), F.col("_own").alias(f"o{n}"), F.col("_places").alias(f"p{n}")]


def _sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Full sets of the documents of some ids."""
    wanted = broadcast_if_small(common.stored(ids.distinct()), max_rows=MAX_IDS)
    involved = docs.join(wanted, docs[id_col] == wanted["_id"], "left_semi")
    return common.stored(full_sets(involved, id_col, text_col, size))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and estimate allow a link.

    Registers go through the joins as they are stored, in fewer bytes than their own ones
    with their places.
    """
    side = lambda n: reps.select(
        F.col("_id").alias(n), F.col("_n").alias(f"n{n}"), F.col("_registers").alias(f"r{n}")
    )
    close = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(close)
    for n in "ab":
        owned = _with_own(likely.withColumnRenamed(f"r{n}", "_registers"))
        likely = owned.withColumnsRenamed({"_own": f"o{n}", "_places": f"p{n}"}).drop("_registers")
    return common.stored(likely.filter(_may_link(("oa", "ob"), ("pa", "pb"), percent)).select("a", "b"))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id")))


def _verified(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`a`, `b` and `similarity` of the pairs that are linked by their full sets."""
    left, right = (sets.select(F.col("_id").alias(n), F.col("_set").alias(f"s{n}")) for n in "ab")
    common_size = F.size(F.array_intersect("sa", "sb"))
    exact = (
        candidates.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common_size.alias("i"))
    )
    union = F.col("na") + F.col("nb") - F.col("i")
    return common.stored(
        exact.filter(100 * F.col("i") >= percent * union).select("a", "b", (F.col("i") / union).alias("similarity"))
    )


def _labelled(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Key rows with the component of their document, for keys of more than one component."""
    named = keys.join(labels.select(F.col("u").alias("_id"), F.col("v").alias("_c")), "_id", "left")
    rows = named.withColumn("_c", F.coalesce("_c", "_id"))
    mixed = rows.groupBy("_key").agg(F.min("_c").alias("_least"), F.max("_c").alias("_most"))
    return rows.join(mixed.filter("_least < _most").select("_key"), "_key")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _shared_keys(reps: DataFrame) -> DataFrame:
    """`_key`, `_id` and `_degree` of keys that two documents or more have.

    The degree of a document is the number of members its keys have. Of a group
    of edited copies, the one with fewest edits shares most keys.
    """
    every = _band_keys(reps)
    shared = every.groupBy("_key").agg(F.count("*").alias("_members")).filter("_members > 1")
    rows = common.stored(every.join(shared, "_key"))
    degrees = rows.groupBy("_id").agg(F.sum("_members").alias("_degree"))
    return rows.select("_key", "_id").join(degrees, "_id")


def _to_hub(keys: DataFrame) -> DataFrame:
    """Pairs of the member of highest degree of each key with the others, the larger id as `a`."""
    hubs = keys.groupBy("_key").agg(F.max_by("_id", F.struct("_degree", "_id")).alias("_hub"))
    joined = keys.join(hubs, "_key").filter("_id != _hub")
    return _ordered(joined.select(F.col("_id").alias("a"), F.col("_hub").alias("b")))


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """`_id` and how many of its shingles another document of `sets` has too.

    A document of several texts counts all of them.
    """
    rows = sets.groupBy("_id").agg(F.count("*").alias("_texts"), F.max(F.size("_set")).alias("_size"))
    shingles = sets.select("_id", F.explode("_set").alias("_shingle"))
    lone = shingles.groupBy("_shingle").agg(F.count("*").alias("_documents"), F.min("_id").alias("_id"))
    private = lone.filter("_documents = 1").groupBy("_id").agg(F.count("*").alias("_private"))
    own = F.when(F.col("_texts") == 1, F.coalesce("_private", F.lit(0))).otherwise(F.lit(0))
    return rows.join(private, "_id", "left").select("_id", (F.col("_size") - own).alias("_shared"))


def _short(shingles: Column) -> Column:
    """The distinct upper halves of the hashes of a set."""
    return F.array_distinct(F.transform(shingles, lambda s: F.shiftright(s, 32).cast("int")))


def _outside(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member outside the main component of its key with the members of other components.

    Members that their private shingles keep from any link are left out. The
    bounds, the estimate and the sets are part of the join, so hardly a pair that is
    not linked is emitted. Rows carry sets of up to MAX_CARRIED shingles, by halves of
    their hashes: of the shingles that two sets share, no more fall together than of
    those of either set, so this many are added to what the halves share and no link is
    lost. All pairs are confirmed afterwards, those with a larger set by the estimate only
    so far.
    """
    bounded = reps.join(_shared_sizes(sets), "_id").filter(F.col("_shared") * 100 >= percent * F.col("_n"))
    # An id of several texts has several sets: its pairs are confirmed afterwards, too.
    one = (F.min("_set") == F.max("_set")) & (F.size(F.max("_set")) <= MAX_CARRIED)
    carried = sets.groupBy("_id").agg(F.when(one, _short(F.max("_set"))).alias("_carried"))
    bounded = common.stored(bounded.join(carried, "_id"))
    rows = rows.join(bounded.select("_id"), "_id", "left_semi")
    sizes = rows.groupBy("_key", "_c").agg(F.count("*").alias("_members"))
    main = sizes.groupBy("_key").agg(F.max_by("_c", F.struct("_members", "_c")).alias("_main"))
    full = rows.join(bounded, "_id")
    side = lambda rows, n: _with_own(rows).select(
        *("_key", F.col("_id").alias(n), F.col("_c").alias(f"c{n}"), F.col("_shared").alias(f"s{n}")),
        *(F.col("_carried").alias(f"f{n}"), *_renamed(n)),
    )
    left, right = side(full.join(main, "_key").filter("_c != _main"), "a"), side(full, "b")
    fallen = F.least(F.col("na") - F.size("fa"), F.col("nb") - F.size("fb"))
    both = F.size(F.array_intersect("fa", "fb")) + fallen
    known = F.col("fa").isNotNull() & F.col("fb").isNotNull()
    condition = (
        (left["_key"] == right["_key"])
        & (F.col("ca") != F.col("cb"))
        & (F.least("sa", "sb") * 100 >= percent * (F.col("na") + F.col("nb") - F.least("sa", "sb")))
        & _may_link(("oa", "ob"), ("pa", "pb"), percent)
        # Written so that the sets of a pair are intersected once.
        & (~known | ((100 + percent) * both >= percent * (F.col("na") + F.col("nb"))))
    )
    return _ordered(left.join(right, condition).select("a", "b"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per row of `docs`: shingles, component and whether it stays.

    Two documents are linked if 100 times their common shingles are at least
    `percent` times those of either. `component_id` is the least id reachable.
    A document without words, or with a null text, has no shingles and is linked
    with nothing; one of fewer words than `shingle` has its words as one shingle.
    Rows of one id are one document: repeated rows get the same result, and rows
    of different texts are linked through their id. A null id is linked with
    nothing, is its own (null) component and stays. Other columns are not read
    and may have any name. An empty table gives no rows.
    """
    rows = common.stored(sketches(docs, id_col, text_col, shingle))
    linkable = rows.filter("_n > 0 AND _id IS NOT NULL")
    classes = common.stored(linkable.groupBy("_digest").agg(F.min("_id").alias("_rep")))
    # A row per class; rows that are repeated are equal in all these columns.
    reps = common.stored(
        linkable.join(classes.select("_digest", F.col("_rep").alias("_id")), ["_digest", "_id"], "left_semi")
        .dropDuplicates(["_digest"])
        .select("_id", "_n", "_registers")
    )
    keys = common.stored(_shared_keys(reps))
    same_set = linkable.join(classes, "_digest").filter("_id > _rep").select(
        F.col("_id").alias("u"), F.col("_rep").alias("v")
    )
    # Every member with the most central one of its key.
    candidates = _likely(_to_hub(keys), reps, percent)
    links = _verified(candidates, _sets_of(_members(candidates), docs, id_col, text_col, shingle), percent)
    edges = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Members that are still in other components of their key, with all others.
    open_rows = common.stored(_labelled(keys.select("_key", "_id"), edges))
    sets = _sets_of(open_rows.select("_id"), docs, id_col, text_col, shingle)
    candidates = common.stored(_outside(open_rows, reps, sets, percent))
    links = _verified(candidates, sets, percent)
    found = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    everything = components(edges.union(found).union(same_set))
    named = rows.join(everything.select(F.col("u").alias("_id"), F.col("v").alias("_c")), "_id", "left")
    component = F.coalesce("_c", "_id")
    return named.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one id of each component, with all their columns."""
    dropped = near_groups(docs, id_col, text_col, **options).filter("NOT kept").select(id_col).distinct()
    dropped = broadcast_if_small(common.stored(dropped), max_rows=MAX_IDS)
    return docs.join(dropped, id_col, "left_anti")
