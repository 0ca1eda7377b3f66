"""Mixing, sharding, training order and tool calls against plain Python versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import block_naming, feistel, histogram_sort, poisson_mix, tool_calls
from docspark.llm.common import table

DOCS = "doc_id bigint, text string, source string"


def mixed_rows(n=3000):
    rng = random.Random(8)
    sources = ["hot"] * 6 + ["a", "b", "c", None]
    return [(i, "x" * rng.randrange(0, 200), rng.choice(sources)) for i in range(n)]


def test_copies_are_poisson_by_hash(spark):
    rows = mixed_rows()
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = poisson_mix.replicated(frame, temperature=0.3).select("row.doc_id", "copies", "copy", "shuffle_key").collect()
    expected = brute.copies(rows, 0.3)
    assert Counter(r.doc_id for r in got) == +Counter(expected)
    assert {(r.doc_id, r.copy) for r in got} == {(d, k + 1) for d, n in expected.items() for k in range(n)}
    keys = np.array([r.shuffle_key for r in got])
    assert len(set(keys)) == len(keys) and abs(keys.mean() - 0.5) < 0.02


def test_sources_get_their_shares(spark):
    frame = spark.createDataFrame(mixed_rows(6000), DOCS)
    targets = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("b", 1.0)], "source string, weight double")
    mixed = poisson_mix.mixed(frame, targets=targets, epochs=3.0)
    size = F.octet_length("text") + 1
    sizes = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    total = frame.agg(F.sum(size)).first()[0] * 3
    for source, share in (("hot", 0.25), ("a", 0.5), ("b", 0.25)):
        assert abs(sizes[source] / total - share) < 0.1 * share
    assert set(sizes) == {"hot", "a", "b"}


def test_a_large_mean_is_drawn_in_parts(spark):
    frame = spark.createDataFrame([(i, "x" * 9, "a") for i in range(400)], DOCS)
    got = poisson_mix.replicated(frame, epochs=50.0).groupBy("row.doc_id").count()
    mean, deviation = got.agg(F.avg("count"), F.stddev("count")).first()
    assert abs(mean - 50) < 2 and abs(deviation - 50**0.5) < 1.5


def sharding_rows():
    rng = random.Random(9)
    rows = [(rng.randrange(-(2**62), 2**62), "x" * rng.randrange(300)) for _ in range(2000)]
    rows += [(77, f"text {i} under a hot key") for i in range(1500)]  # one id
    rows += [(78, "a repeated row")] * 700
    rows += [(None, None), (None, "no id"), (5, "y" * 20_000), (2**63 - 1, "last"), (-(2**63), "first")]
    return rows


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40])
def test_shards_are_near_equal_and_in_order(spark, rows_per_task):
    rows = sharding_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = histogram_sort.sharded(frame, shards=8, rows_per_task=rows_per_task, carry=["text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in got)
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    total, shards = sum(r["size"] for r in got), {s: [r for r in got if r.shard == s] for s in range(8)}
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        # Cuts are within the tolerance and one row of an eighth; the longest row is apart.
        longest = max(r["size"] for r in members)
        assert abs(sum(r["size"] for r in members) - total / 8) <= 2 * (total / 8 * 0.001 + max(longest, 400))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        numbers = np.arange(size)
        one, other = feistel.Permutation(size, 1), feistel.Permutation(size, 2)
        slots = one.slot(numbers)
        assert sorted(slots) == list(range(size))
        assert (one.number(slots) == numbers).all()
        if size > 100:
            assert (slots != other.slot(numbers)).mean() > 0.9
            assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.1


def test_shards_are_files_of_fixed_stride(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    where = str(tmp_path / "shards")
    index = feistel.materialised(docs, where, length=64, key=7, rows_per_shard=500).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(index) == sum(-(-len(t) // 64) for t in texts.values())
    by_shard = Counter(r.shard for r in index)
    files = {p.parent.name: p.read_bytes() for p in (tmp_path / "shards").glob("shard=*/part-*")}
    assert {n: len(b) for n, b in files.items()} == {f"shard={s}": n * 65 for s, n in by_shard.items()}
    for row in index:
        assert row.slot == row.shard * 500 + row.offset // 65
        record = files[f"shard={row.shard}"][row.offset : row.offset + 64]
        assert record == texts[row.doc_id][row.part * 64 : (row.part + 1) * 64].ljust(64, b"\xff")
        assert row.record_crc32 == zlib.crc32(record) and row.n_bytes == len(record.rstrip(b"\xff"))
    again = feistel.materialised(docs.repartition(7), str(tmp_path / "again"), length=64, key=7, rows_per_shard=500)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index))
    rest = feistel.read_shards(spark, where, 64, first=700, rows_per_shard=500).collect()
    assert sorted(r.slot for r in rest) == list(range(700, len(index)))


def test_token_ids_as_records(spark):
    docs = spark.createDataFrame([(1, [1, 70000, 3]), (2, []), (3, None), (4, [9] * 5)], "doc_id bigint, ids array<int>")
    rows, total = feistel.ordered(feistel.id_sequences(docs, length=4), 16, 0, 1)
    got = {(r._id, r._part): np.frombuffer(bytes(r._record), "<u4").tolist() for r in rows.collect()}
    assert total == 3 and got == {(1, 0): [1, 70000, 3, 0], (4, 0): [9] * 4, (4, 1): [9, 0, 0, 0]}


def spread(frame, key):
    """Rows of all tasks and of the largest."""
    counts = [r["count"] for r in frame.filter(key).groupBy(F.spark_partition_id()).count().collect()]
    return sum(counts), max(counts)


def test_copies_of_one_row_are_spread(spark):
    """Numbers and pieces of many copies are made by many tasks, each copy once."""
    rows = [(None, "one text of thirty-two bytes ...")] * 9000 + [(i, "other " * i) for i in range(50)] + [(7, "twice")] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got, total = feistel.ordered(feistel.byte_sequences(frame, length=8), 8, 0xFF, 3)
    assert total == sum(-(-len(t) // 8) for _, t in rows)
    assert sorted(r._slot for r in got.select("_slot").collect()) == list(range(total))
    n, most = spread(got, F.col("_id").isNull())
    assert n == 4 * 9000 and most <= n / 2
    parts = got.filter("_id IS NULL").groupBy("_part", F.col("_record").cast("string").alias("r")).count().collect()
    assert sorted((r["_part"], r["r"], r["count"]) for r in parts) == [(k, rows[0][1][8 * k : 8 * k + 8], 9000) for k in range(4)]
    groups = block_naming.exact_groups(frame)
    n, most = spread(groups, F.col("doc_id").isNull())
    assert n == 9000 and most <= n / 2
    assert groups.filter("doc_id IS NULL AND kept").count() == 1 and groups.count() == len(rows)


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "list": {"of": ("array", True)}}
CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def linked(spark, calls, results):
    frame = tool_calls.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in frame.collect()}


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 2.50, "a": 1}', None),
        (1, 1, "y", "add", '{"a": "1", "c": 0}', ["x", "unknown"]),
        (1, 2, "z", "list", '{"of": [3, {"q": 1, "p": null}]}', ["w"]),  # waits for a later one
        (1, 3, "w", "gone", "{}", ["y"]),
        (1, 4, "x", "add", "{}", []),  # a repeated id
        (2, 0, "p", "add", "[1]", ["q"]),
        (2, 1, "q", "add", "no", ["p"]),
        (2, 2, "r", "add", None, ["q"]),
        (2, 3, "s", "list", '{"of": 1}', ["s2"]),
    ]
    results = [(1, 1, "x", 'say "é"\n'), (1, 2, "x", "late"), (2, 5, "x", "of another conversation"), (2, 6, "s", None)]
    got = linked(spark, calls, results)
    assert {k: r.status for k, r in got.items()} == {
        (1, "x"): "linked", (1, "y"): "unanswered", (1, "z"): "unanswered", (1, "w"): "unanswered",
        (2, "p"): "circular", (2, "q"): "circular", (2, "r"): "circular", (2, "s"): "linked", (2, "x"): "orphan",
    }
    assert {k: (r.level, r.position) for k, r in got.items() if r.level is not None} == {
        (1, "x"): (0, 0), (1, "y"): (1, 1), (1, "w"): (2, 2), (1, "z"): (3, 3), (2, "s"): (0, 0),
    }
    assert {k: r.errors for k, r in got.items()} == {
        (1, "x"): "", (1, "y"): "a is no integer; missing b; unknown c", (1, "z"): "", (1, "w"): "unknown tool",
        (2, "p"): "no object", (2, "q"): "no JSON", (2, "r"): "no JSON", (2, "s"): "of is no array", (2, "x"): None,
    }
    assert got[1, "x"].message == '{"arguments":{"a":1,"b":2.5},"call_id":"x","content":"say \\"é\\"\\n","name":"add"}'
    assert got[1, "z"].message == '{"arguments":{"of":[3,{"p":null,"q":1}]},"call_id":"z","content":null,"name":"list"}'
    assert (got[1, "x"].n_calls, got[1, "x"].n_results, got[2, "x"].n_calls) == (2, 2, 0)


def test_positions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "BLOCK", 4)
    rng = random.Random(3)
    calls = [(c, t, f"c{t}", "add", "{}", [f"c{rng.randrange(t)}"] if t % 3 else []) for c in (1, 2) for t in range(40)]
    got = linked(spark, calls, [])
    for conv in (1, 2):
        mine = [(got[c, i], t, after) for c, t, i, _, _, after in calls if c == conv]
        assert sorted(r.position for r, _, _ in mine) == list(range(40))
        by_order = sorted(mine, key=lambda m: (m[0].level, m[1]))
        assert [r.position for r, _, _ in by_order] == list(range(40))
        assert all(got[conv, a].position < r.position for r, _, after in mine for a in after)
