"""The pipeline against the plain versions of its stages, one after the other."""

from __future__ import annotations

import hashlib
from collections import Counter

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from docspark.llm import bpe, line_frequency, poisson_mix
from docspark.llm.common import release, stored, table
from odd_tables import write

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows: list[dict]) -> dict[str, list[dict]]:
    """Rows after each stage, for rows of distinct ids."""
    after = {}
    limits = (line_frequency.MIN_DOCUMENTS, line_frequency.MAX_SHARE, line_frequency.MIN_KEPT_SHARE)
    judged = brute.line_frequency([(r["doc_id"], r["text"], r["source"]) for r in rows], *limits)
    rows = [{**r, "text": judged[r["doc_id"]][1]} for r in rows if judged[r["doc_id"]][0]]
    rows = [{**r, "n_chars": len(r["text"])} for r in rows]
    after["quality_rules"] = rows
    groups = brute.exact_groups([(r["doc_id"], r["text"]) for r in rows])
    rows = after["exact_dedup"] = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    components = brute.near_components([(r["doc_id"], r["text"]) for r in rows], 5)
    rows = after["near_dedup"] = [r for r in rows if components[r["doc_id"]] == r["doc_id"]]
    copies = brute.copies([(r["doc_id"], r["text"], r["source"]) for r in rows], poisson_mix.TEMPERATURE)
    rows = after["mix_sources"] = [r for r in rows for _ in range(copies[r["doc_id"]])]
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer, last = brute.tokenizer(tokens, public_tokenizers.PATTERN), []
    for r in rows:
        ids = tokenizer.encode_ordinary(r["text"])
        written = " ".join(map(str, ids)).encode()
        digests = (hashlib.sha256(written).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        last.append({"doc_id": r["doc_id"], "source": r["source"], "n_tokens": len(ids), "ids_sha256": digests[0], "decoded_sha256": digests[1]})
    after["tokenize"] = last
    return after


def test_stages_are_the_plain_ones(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    expected = plain([r.asDict() for r in docs.collect()])
    assert [name for name, _ in corpus_pipeline.STAGES] == list(expected)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        got = [r.asDict() for r in docs.collect()]
        as_counted = lambda rows: Counter(tuple(sorted(r.items())) for r in rows)
        assert as_counted(got) == as_counted(expected[name]), name
        if name != "tokenize":
            assert sorted(docs.columns) == sorted(COLUMNS)
    assert Counter(r["doc_id"] for r in expected["tokenize"]) == Counter(
        r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()
    )


@pytest.mark.parametrize("rows", [True, False])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    where = write(tmp_path / "tables", rows=rows)
    docs = table(spark, where, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, where))
        if name != "tokenize":
            assert docs.columns == columns
    assert (docs.count() > 0) == rows


def test_release_deletes_what_was_stored(spark):
    kept = stored(spark.range(3))
    path = kept.inputFiles()[0]
    release(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
