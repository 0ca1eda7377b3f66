"""Every query on tables with nulls, empty and long texts, repeated rows, clashing names, and on empty ones."""

from __future__ import annotations

from collections import Counter

import pytest

from docspark.llm.queries import QUERIES
from odd_tables import CONVERSATIONS, DOCUMENTS, PAGES, write

PER_DOCUMENT = ["op1_line_frequency", "op2_hyperminhash", "op4_nbsvm", "op6_histogram_sort", "op9_two_tier_bpe", "op10_block_naming"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), rows=False)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in DOCUMENTS)
    required = [c for c in rows[0].asDict() if c not in ("doc_id", "keep_id", "component_id", "grown_shard")]
    assert all(r[c] is not None for r in rows for c in required)


def test_pages(spark, odd):
    rows = QUERIES["op3_line_blocks"](spark, odd).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in PAGES)
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts == {1: "Title\nSome & text.", 2: "", None: "", 3: "", 4: "plain text only", 5: "", 6: "deep", 7: ""}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_mix_takes_copies_of_rows_as_they_are(spark, odd):
    rows = QUERIES["op5_poisson_mix"](spark, odd).collect()
    known = {(d[0], d[1], d[3]) for d in DOCUMENTS}
    assert rows and {(r["doc_id"], r["text"], r["source"]) for r in rows} <= known
    assert rows[0].asDict().keys() >= {"a.b", "copies", "copy", "shuffle_key"}


def test_conversations(spark, odd):
    rows = QUERIES["op7_tool_calls"](spark, odd).collect()
    status = Counter(r["status"] for r in rows)
    users = [c for c in CONVERSATIONS if c[2] == "user"]
    assert sum(status[s] for s in ("linked", "unanswered", "circular")) == len(users)
    assert status["orphan"] == 1
    linked = [r for r in rows if r["status"] == "linked"]
    assert [(r["call_id"], r["n_results"]) for r in linked] == [("c1-0", 2)]


def test_sequences(spark, odd):
    rows = QUERIES["op8_feistel_order"](spark, odd).collect()
    sequences = Counter()
    for doc_id, text, _, _ in DOCUMENTS:
        sequences[doc_id] += -(-len((text or "").encode("utf-8", "surrogatepass")) // 512)
    assert Counter(r["doc_id"] for r in rows) == +sequences
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_equal_texts_keep_one_row(spark, odd):
    rows = QUERIES["op10_block_naming"](spark, odd).collect()
    groups = Counter(r["text_sha256"] for r in rows)
    assert all(r["group_size"] == groups[r["text_sha256"]] for r in rows)
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter(list(groups))
    # Ids 1, 2, 2, a null id and 10, which only differs in its blanks and is shorter.
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2, 10)} == {1}
