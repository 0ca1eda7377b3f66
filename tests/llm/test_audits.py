"""Divergence of sources and interaction of filters against plain Python versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from brute import LOWER, WORD

from docspark.llm import filter_lattice, skyband
from docspark.llm.queries import QUERIES
from odd_tables import DOCUMENTS, LABELS, write

DOCS = "doc_id bigint, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence(rows, top=50, min_documents=30):
    uses, documents, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        uses[lang, source].update(terms)
        documents[lang].update(set(terms))
    found = set()
    for lang, sources in langs.items():
        kept = [t for t, n in documents[lang].items() if n >= min_documents]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(uses[lang, s]) for s in sources}
        q = shares(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))
                ranked = ranked[:top] if part == "term" else ranked
                found |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return found


def audited_rows(n=4000):
    rng = random.Random(12)
    vocabulary = [rng.choice("aéZß漢") + "".join(rng.choice("abcXYZ") for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", "ü", None])
        words = [vocabulary[int(rng.paretovariate(0.6)) * (len(source or "") + 1) % 600] for _ in range(rng.randrange(0, 60))]
        rows.append((i, rng.choice([" ", "1", "_", "-\n"]).join(words), rng.choice(["en", "en", "de", None]), source))
    rows += [(-1, None, "xx", "one"), (-2, "alone", "yy", "a"), (-3, "", "yy", "b"), (-3, "", "yy", "b")]
    return rows


def as_set(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("blocks", "chunk"), [(256, 4096), (2, 50)])
def test_divergence_is_the_plain_one(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(skyband, "BLOCK_SOURCES", blocks)
    monkeypatch.setattr(skyband, "BLOCK_TERMS", chunk)
    rows = audited_rows()
    frame = spark.createDataFrame(rows, DOCS).repartition(9)
    assert as_set(skyband.divergence(frame)) == divergence(rows)
    assert as_set(skyband.divergence(frame, top=3, min_documents=5)) == divergence(rows, 3, 5)


def test_the_band_holds_the_first_of_every_score():
    rng = np.random.default_rng(3)
    for size in (1, 40, 400):
        n, lang_n = rng.integers(0, 12, size), rng.integers(0, 30, size)
        terms = np.array([f"t{i:03}" for i in rng.permutation(size)], object)
        for k in (1, 5, 50):
            kept = set(skyband.band(n, lang_n, terms, k).tolist())
            for i in range(size):
                beaten = np.count_nonzero((n >= n[i]) & (lang_n <= lang_n[i]) & (terms < terms[i]))
                assert (i in kept) == (beaten < k)


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(10**14 + 7, 3 * 10**14 + 11, 10**6 + 3), (0, 0, 1), (0, 10**15, 7), (10**15, 10**15, 1)]
    frame = spark.createDataFrame(cases, "n bigint, total bigint, kept bigint")
    got = [r[0] for r in frame.select(skyband.share(frame.n, frame.total, frame.kept)).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * kept) for n, total, kept in cases]


def test_terms_of_a_text_in_pieces(monkeypatch):
    text = ("Über ALL_die9Wörter, " * 50).encode()
    whole = [t for terms in skyband._terms(text) for t in terms]
    monkeypatch.setattr(skyband, "PIECE", 7)
    assert [t for terms in skyband._terms(text) for t in terms] == whole
    assert [t.decode() for t in whole] == TERM.findall(text.decode().translate(LOWER))


def test_few_terms_are_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(skyband, "HELD_TERMS", 10)
    monkeypatch.setattr(skyband, "GATHERED", 20)
    rows = audited_rows(600)
    assert as_set(skyband.divergence(spark.createDataFrame(rows, DOCS))) == divergence(rows)


def test_divergence_of_odd_tables(spark, tmp_path):
    assert as_set(QUERIES["op12_skyband"](spark, write(tmp_path / "odd"))) == divergence(DOCUMENTS)


# --- filters -----------------------------------------------------------------


def fails(text):
    words = WORD.findall(text)
    checks = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }
    return {name for name, failed in checks.items() if failed}


def interactions(rows, labels):
    """The filters run one after the other, in every order."""
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, is_toxic in labels if is_toxic == 1 and d is not None}
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    documents = defaultdict(list)
    for doc_id, text, _, source in rows:
        failed, text = fails(text or ""), text or ""
        if text in least and (doc_id is None or doc_id > least[text]):
            failed.add("E")
        documents[source or ""].append((doc_id, failed))
    found, removals = {}, Counter()
    for part, docs in documents.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                redundant = sum(name in d[1] for d in docs) - len(gone)
                left = [d for d in left if name not in d[1]]
                removals[part, name] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(d[1] == {name} for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
    return {(*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def filtered_rows(n=3000):
    rng = random.Random(13)
    bases = []
    for _ in range(60):
        words = [rng.choice(["a", "bb", "Ccc", "DDD", f"w{rng.randrange(999)}"]) for _ in range(rng.randrange(0, 120))]
        bases.append(rng.choice([" ", "\t\n"]).join(words) + rng.choice(["", "", " 50 %", "\xa0", "É"]))
    rows = [(i, rng.choice(bases[:3] if i % 3 == 0 else bases), "en", rng.choice(["hot", "hot", "b", None, "c"])) for i in range(n)]
    rows += [(7, rows[7][1], "en", "hot")] * 5 + [(None, bases[0], "en", "b"), (None, "only null", "en", "b")] * 2
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n, 2)]
    return rows, labels + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]


def test_interactions_are_those_of_running_the_filters(spark):
    rows, labels = filtered_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert as_set(filter_lattice.audit(docs, marks)) == interactions(rows, labels)


def test_paths_are_factorials():
    forward, backward = filter_lattice.paths(5)
    sizes = [bin(state).count("1") for state in range(32)]
    assert forward == [factorial(s) for s in sizes]
    assert backward == [factorial(5 - s) for s in sizes]


def test_shares_add_up_to_all_removals(spark):
    rows, labels = filtered_rows(500)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_lattice.audit(spark.createDataFrame(rows, DOCS), marks).filter("filter_order = 'ABCDE'").collect()
    documents = Counter(r[3] or "" for r in rows)
    for part in documents:
        steps = sorted((r for r in found if r.part == part), key=lambda r: r.step)
        assert sum(r.shapley for r in steps) == 120 * (documents[part] - steps[-1].kept)


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, False, False, 5), ("p", 3, True, False, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    rows = {(r.filter_order, r.step): r for r in filter_lattice.interactions(counts, "XY").collect()}
    assert len(rows) == 4 and rows["XY", 1].removed == 2 and rows["XY", 2].redundant == 2 and rows["YX", 2].kept == 5
    assert {r.shapley for r in rows.values()} == {2}
    with pytest.raises(ValueError, match="filters"):
        filter_lattice.interactions(counts, "ABCDEFGH")


def test_interactions_of_odd_tables(spark, tmp_path):
    assert as_set(QUERIES["op13_filter_lattice"](spark, write(tmp_path / "odd"))) == interactions(DOCUMENTS, LABELS)
