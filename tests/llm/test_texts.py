"""Quality rules, dedup and tokens against plain Python versions."""

from __future__ import annotations

import hashlib
import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docspark.llm import block_naming, bpe, hyperminhash, line_frequency
from docspark.llm.common import table

DOCS = "doc_id bigint, text string, source string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def near_copies(rng, base, n, edits):
    for i in range(n):
        words = base.split()
        for _ in range(edits[i % len(edits)]):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    """Groups of copies from two to hundreds, a passage that many texts share, and texts of few words."""
    rng = random.Random(4)
    texts = []
    for size, words, edits in ((300, 120, [0, 1, 3, 6, 9, 14, 20]), (40, 400, [5, 20, 60]), (12, 14, [0, 1]), (2, 60, [2])):
        texts += near_copies(rng, sentence(rng, words), size, edits)
    passage = sentence(rng, 40)
    texts += [f"{sentence(rng, rng.randrange(20, 90))} {passage}" for _ in range(200)]
    texts += ["", "one", "One", "one two", "one two three", "ONE TWO", " \n", "a b c d e", "a b c d e f"]
    texts += [sentence(rng, 30) for _ in range(100)]
    texts += [texts[0]] * 20
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_are_the_components(spark, near_rows, size):
    frame = spark.createDataFrame(near_rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in hyperminhash.near_groups(frame, shingle=size).collect()}
    expected = brute.near_components(near_rows, size)
    assert {d: r.component_id for d, r in got.items()} == expected
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(brute.shingles(t, size)) for d, t in near_rows}
    assert all(r.kept == (d == expected[d]) for d, r in got.items())


def test_register_estimates(spark):
    """The share of equal registers is the similarity, within its deviation."""
    rng = random.Random(1)
    import numpy as np

    for share in (0.3, 0.6, 0.9):
        equal = used = 0
        for _ in range(40):
            whole = np.array([rng.getrandbits(64) for _ in range(1000)], dtype=np.uint64)
            cut = int(1000 * (1 - share) / 2)
            a, b = (hyperminhash.registers(np.unique(x)) for x in (whole[cut:], whole[: 1000 - cut]))
            own = (a > 0) | (b > 0)
            equal, used = equal + ((a == b) & (a > 0)).sum(), used + own.sum()
        assert abs(equal / used - share) < 0.03


def test_repeated_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["x " * 500, "", "a b c d", "a b c d e a b c d e", "a\tb\nc\x0bd e f " * 3]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    for row in line_frequency.base_metrics(frame, "doc_id", "text").select("_row.text", "*").collect():
        words = brute.WORD.findall(row.text)
        assert (row.n_words, row.n_repeat_words) == (len(words), brute.repeated_words(words)), row.text
        assert row.word_chars == sum(map(len, words))
        lines = [x for x in row.text.split("\n") if x.strip(brute.SPACES)]
        assert row.n_dup_lines == len(lines) - len(set(lines))


def test_frequent_lines_go_and_copies_stay(spark):
    rng = random.Random(3)
    notice, rows = "All rights reserved to the owner of 2024", []
    for i in range(60):
        lines = [sentence(rng) for _ in range(4)]
        lines.insert(rng.randrange(5), notice.replace("2024", str(2000 + i)).upper() if i % 2 else f"  {notice} ")
        rows.append((i, "\n".join(lines), "a"))
    copied = "\n".join(sentence(rng) for _ in range(6))
    rows += [(100 + i, copied, "a") for i in range(50)]  # exact copies
    edited = copied.split("\n")
    rows += [(200 + i, "\n".join([*edited[:5], sentence(rng)]), "a") for i in range(9)]  # near copies
    rows += [(300 + i, f"{notice}\nshort own text here", "a") for i in range(12)]  # little else
    rows += [(400, f"{notice}\n{sentence(rng)}", "b"), (401, None, "b"), (402, "", None)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in line_frequency.line_frequency(frame).collect()}
    limits = (line_frequency.MIN_DOCUMENTS, line_frequency.MAX_SHARE, line_frequency.MIN_KEPT_SHARE)
    expected = brute.line_frequency(rows, *limits)
    assert {d: (r.kept, r.clean_text) for d, r in got.items()} == expected
    assert all(got[i].kept and notice.lower() not in got[i].clean_text.lower() for i in range(60))
    assert all(got[d].kept and got[d].n_removed_lines == 0 for d in got if 100 <= d < 300)
    assert got[400].n_removed_lines == 0  # no frequent line of its host
    cleaned = line_frequency.cleaned(frame.withColumn("row", F.lit(1)))
    assert cleaned.columns == [*frame.columns, "row"]
    assert {r.doc_id for r in cleaned.collect()} == {d for d, (kept, _) in expected.items() if kept}


@pytest.mark.parametrize("block", [1, 3, 4096])
@pytest.mark.parametrize("hashes", [None, 3])
def test_names_are_free_of_collisions(spark, block, hashes):
    """Also where many different blocks have one hash."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 12))) for _ in range(120)] + ["é漢😀" * 5, "é漢😀" * 4]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = None if hashes is None else F.pmod(F.xxhash64("_block"), F.lit(hashes)).cast("long")
    got = {r.doc_id: r for r in block_naming.exact_groups(frame, block=block, key=key).collect()}
    expected = brute.exact_groups(rows)
    assert {d: r.keep_id for d, r in got.items()} == expected
    sizes = {d: list(expected.values()).count(k) for d, k in expected.items()}
    assert {d: r.group_size for d, r in got.items()} == sizes
    staying = block_naming.deduplicated(frame)
    assert sorted(r.doc_id for r in staying.collect()) == sorted(set(expected.values()))


def test_tokens_are_those_of_the_tokenizer(spark, sf_dir):
    tokens = bpe.read_ranks(PATH)
    reference = brute.tokenizer(tokens, public_tokenizers.PATTERN)
    rng = random.Random(6)
    letters = "ab 'stredmlvS\n\t .,!?é漢😀1²٣\xa0 \x85"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    made += ["", None, "a" * 3000, " " * 500, "don't we'll 'tis I'VE", "퟿"]
    texts = made + [r.text for r in table(spark, sf_dir, "documents").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    whole = bpe.decoded(bpe.encoded(frame, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    digests = bpe.token_digests(whole, PATH, public_tokenizers.PATTERN)
    for row in digests.collect():
        ids = reference.encode_ordinary(row.text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    tokens = bpe.read_ranks(PATH)
    encoder = bpe.Encoder(tokens, public_tokenizers.PATTERN, limit=50)
    text = " ".join(f"word{i} and more" for i in range(2000))
    whole = encoder.encode(text), encoder.digests(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PIECES_AT_A_TIME", 7)
    assert (encoder.encode(text), encoder.digests(text)) == whole
    assert len(encoder.pieces) <= 50


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)] + [b""]
    found = bpe.PerfectHash(keys)
    assert sorted(found.slots) == list(range(len(keys)))
    assert all(found(key) == n for n, key in enumerate(keys))


def test_sets_go_along_by_halves_and_lose_no_link(spark):
    """Shingles whose halves are all equal leave nothing to compare: the pair is emitted, to be confirmed."""
    rows = [("k", 1, 1), ("k", 2, 2), ("k", 3, 2)]
    keys = spark.createDataFrame(rows, "_key string, _id long, _c long")
    sets = [(1, [(7 << 32) + i for i in range(100)]), (2, [(7 << 32) + i for i in range(95)])]
    sets.append((3, [(i << 32) + 1 for i in range(-50, 50)]))
    shingles = spark.createDataFrame(sets, "_id long, _set array<bigint>")
    reps = shingles.select("_id", F.size("_set").cast("long").alias("_n"), F.expr("array(1S, 2S) AS _registers"))
    halves = shingles.select(hyperminhash._short(F.col("_set")).alias("s"))
    assert dict(halves.dtypes)["s"] == "array<int>" and [len(r.s) for r in halves.collect()] == [1, 1, 100]
    found = hyperminhash._outside(keys, reps, shingles.union(shingles.filter("_id = 3")), 80)
    assert [tuple(r) for r in found.collect()] == [(2, 1)]
