"""Divergence of the sources of a language: which other sources, and which terms, set a source apart.

Terms are counted in every task before they are shuffled. A term's divergence
grows with its count in the source and shrinks with its count in the language,
ties fall to the earlier term. So a term that `k` others beat in all three cannot be
among the first `k`, whatever the totals are: partitions keep the k-skyband of
their terms, the skybands are merged in parts of a source, and only what is
left is scored and ranked.

Distances of sources are sums over all kept terms. They are added up in dense
blocks of sources and terms, so neither the sources of a language nor its terms
come together in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import common

MIN_DOCUMENTS = 30
TOP = 50
SMOOTHING = 5
# Terms that a task counts before it hands them on, and bytes of a text that are split at a time.
HELD_TERMS = 500_000
PIECE = 1 << 22
# Rows of a source that a task gathers before it cuts them to their skyband.
GATHERED = 1 << 15
# Parts of a source in which skybands are merged.
SALTS = 16
# Sources and terms of a dense block.
BLOCK_SOURCES = 256
BLOCK_TERMS = 4096

# Term bytes: letters, in lower case, and all bytes beyond ASCII. All others separate terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


# --- counts ------------------------------------------------------------------


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded piece at a time, cut where a term ends."""
    plain, start = text.translate(_TERM_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE) if start + PIECE < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`lang`, `source`, `term`, `n` and `docs` of every term of a source, and a null term for every source.

    Nulls are read as ''. The same term comes in several rows, one per task.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang_col), empty).alias("lang"),
        F.coalesce(F.col(source_col), empty).alias("source"),
        F.coalesce(F.col(text_col), empty).cast("binary").alias("text"),
    )

    def emit(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs_) in counts.items():
            terms = [None, *uses]
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *uses.values()], pa.int64()),
                    pa.array([0, *(docs_[t] for t in uses)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0
        for batch in batches:
            texts = batch.column(2)
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                uses, docs_ = counts.setdefault(group, (Counter(), Counter()))
                before, seen = len(uses), set()
                for terms in _terms(texts[i].as_py()):
                    uses.update(terms)
                    seen.update(terms)
                docs_.update(seen)
                held += len(uses) - before
                if held > HELD_TERMS:
                    yield from emit(counts)
                    counts, held = {}, 0
        yield from emit(counts)

    return common.map_in_arrow(rows, run, "lang string, source string, term string, n long, docs long")


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Counts of the terms that enough documents of the language have, and a null term for every source.

    `lang_n` is the term's count in the language, `is_head` true in one row of each
    term. Rows of a term, one per source, share a partition; one exchange does all.
    """
    dealt = counts.repartition("lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = summed.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(term).alias("lang_n"),
        F.sum("docs").over(term).alias("lang_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("is_head"),
    )
    return whole.filter(F.col("term").isNull() | (F.col("lang_docs") >= min_documents)).drop("lang_docs")


def totals(kept: DataFrame) -> DataFrame:
    """Per source: `all` its count over kept terms, `lang_all` that of the language, `kept` terms of the language,
    `at` its number in the language, `sources` of the language."""
    is_term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    langs = kept.groupBy("lang").agg(
        F.count_if(is_term & F.col("is_head")).alias("kept"),
        F.coalesce(F.sum(F.when(is_term, F.col("n"))), F.lit(0)).alias("lang_all"),
    )
    lang = Window.partitionBy("lang")
    numbered = groups.withColumns(
        {"at": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)}
    )
    return numbered.join(langs, "lang")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + smoothing) / (total + smoothing kept)), exact in three steps of 1000."""
    divisor = total + SMOOTHING * kept
    value, rest = F.lit(1).cast("long"), count + SMOOTHING
    for weight in (1_000_000, 1_000, 1):
        step = rest * 1000
        value = value + F.call_function("div", step, divisor) * weight
        rest = step % divisor
    return value


# --- terms -------------------------------------------------------------------


def band(n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than `k` others dominate: as high in `n`, as low in `lang_n`, earlier in `terms`.

    Who dominates a point comes before it in this order, and of its dominators the
    first `k` are in the band themselves: counting those kept so far is enough.
    """
    order = np.lexsort((terms, lang_n, -n))
    place = np.empty(len(terms), np.int64)
    place[np.argsort(terms, kind="stable")] = np.arange(len(terms))
    kept_lang, kept_place, kept, size = np.empty(len(n), np.int64), np.empty(len(n), np.int64), [], 0
    for i in order:
        better = (kept_lang[:size] <= lang_n[i]) & (kept_place[:size] < place[i])
        if np.count_nonzero(better) < k:
            kept_lang[size], kept_place[size] = lang_n[i], place[i]
            kept.append(i)
            size += 1
    return np.array(kept, np.int64)


def skyband(rows: DataFrame, k: int = TOP) -> DataFrame:
    """Of the rows (`lang`, `source`, `term`, `n`, `lang_n`) in each partition, those in the k-skyband of their source."""
    names = ["lang", "source", "term", "n", "lang_n"]

    def cut(parts: list[tuple]) -> tuple:
        terms, n, lang_n = (np.concatenate(c) for c in zip(*parts, strict=True))
        at = band(n, lang_n, terms, k)
        return terms[at], n[at], lang_n[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[tuple, list[tuple]] = {}
        sizes: Counter = Counter()
        for batch in batches:
            for group, part in batch.to_pandas().groupby(["lang", "source"], sort=False):
                columns = (part["term"].to_numpy(object), part["n"].to_numpy(), part["lang_n"].to_numpy())
                gathered.setdefault(group, []).append(columns)
                sizes[group] += len(part)
                if sizes[group] > GATHERED:
                    gathered[group] = [cut(gathered[group])]
                    # What stays does not count towards the next cut.
                    sizes[group] = 0
        for (lang, source), parts in gathered.items():
            terms, n, lang_n = cut(parts)
            columns = [[lang] * len(terms), [source] * len(terms), terms.tolist(), n, lang_n]
            types = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return common.map_in_arrow(rows.select(*names), run, "lang string, source string, term string, n long, lang_n long")


def top_terms(kept: DataFrame, sums: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` terms of every source whose share there is above that in the language."""
    local = skyband(kept.filter("term IS NOT NULL"), top)
    part = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    merged = skyband(local.repartition("lang", "source", part), top)
    p = share(F.col("n"), F.col("all"), F.col("kept"))
    q = share(F.col("lang_n"), F.col("lang_all"), F.col("kept"))
    scored = merged.join(sums, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # The limit on the rank also cuts the rows of every task before they are dealt by source.
    return scored.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


# --- pairs of sources --------------------------------------------------------


def distances(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """`lang`, `source`, `item` (another source of the language) and `value`, the sum of their differences over all kept terms."""
    safe = F.greatest(F.col("kept"), F.lit(1))
    described = sums.select(
        "lang",
        "source",
        "all",
        "kept",
        "at",
        share(F.lit(0).cast("long"), F.col("all"), safe).alias("none"),
        F.ceil(safe / BLOCK_TERMS).cast("int").alias("chunks"),
        F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks"),
    )
    cells = kept.filter("term IS NOT NULL").join(described, ["lang", "source"])
    counted = cells.select(
        *("lang", "source", "at", "kept", "none", "blocks", "term"),
        F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"),
        share(F.col("n"), F.col("all"), F.col("kept")).alias("p"),
    )
    # Every block knows all its sources, those without a term too.
    known = described.select(
        *("lang", "source", "at", "kept", "none", "blocks"),
        F.lit(None).cast("string").alias("term"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.col("none").alias("p"),
    )
    own = F.floor(F.col("at") / BLOCK_SOURCES).cast("int")
    rows = counted.unionByName(known).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = rows.withColumns({"a": F.least(own, "other"), "b": F.greatest(own, "other")})
    found = placed.groupBy("lang", "a", "b", "chunk").applyInPandas(
        _block_distances(BLOCK_SOURCES), "lang string, one string, two string, value long"
    )
    summed = found.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                   F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    both = summed.select("lang", F.explode(ways).alias("way"), "value")
    return both.select("lang", "way.source", "way.item", "value")


def _block_distances(size: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Sums over the terms of a chunk, for the pairs of two blocks of `size` sources.

    Terms that neither source has differ by the shares of no use. They are counted
    once for all terms, in the first chunk, and taken off where a term is here.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, a, b, chunk = key
        sources = rows[rows["term"].isna()].sort_values("at")
        names, none, at = sources["source"].to_numpy(object), sources["none"].to_numpy(np.int64), sources["at"].to_numpy()
        used = rows[rows["term"].notna()]
        codes, terms = pd.factorize(used["term"])
        shares = np.repeat(none[None, :], len(terms), axis=0)
        shares[codes, np.searchsorted(at, used["at"].to_numpy())] = used["p"].to_numpy(np.int64)
        # The part of all kept terms in the first chunk, less those that are here.
        unseen = (int(sources["kept"].iloc[0]) if chunk == 0 else 0) - len(terms)
        block, ones, twos, values = at // size, [names[:0]], [names[:0]], [np.array([], np.int64)]
        for i in np.flatnonzero(block == a):
            others = np.flatnonzero((block == b) & (at > at[i]))
            apart = np.abs(shares[:, others] - shares[:, [i]]).sum(axis=0)
            ones.append(np.full(len(others), names[i], object))
            twos.append(names[others])
            values.append(apart + unseen * np.abs(none[others] - none[i]))
        one, two, value = map(np.concatenate, (ones, twos, values))
        text = lambda column: pd.Series(column, dtype=object)
        return pd.DataFrame({"lang": text([lang] * len(one)), "one": text(one), "two": text(two), "value": value})

    return run


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    top: int = TOP,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value` and `rank`.

    Part `pair` has all other sources of the language by distance, part `term` the
    first `top` terms by excess over the language. Null text, language and source
    are read as ''. Every row counts, repeated ones too; ids are not read. A language
    without kept terms has distances of 0 and no terms, one with a single source no
    pairs. An empty table gives no rows. Other columns may have any name.
    """
    kept = common.stored(kept_terms(term_counts(docs, lang_col, source_col, text_col), min_documents))
    sums = common.stored(totals(kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(kept, sums).withColumn("rank", F.row_number().over(order))
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return pairs.select(*columns("pair")).unionByName(top_terms(kept, sums, top).select(*columns("term")))
