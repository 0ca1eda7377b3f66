"""Plain Python versions of the operators, by definition and without their methods."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import tiktoken

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(words: list[str], window: int = 5) -> int:
    starts = defaultdict(list)
    for i in range(len(words) - window + 1):
        starts[tuple(words[i : i + window])].append(i)
    return len({i + k for s in starts.values() if len(s) > 1 for i in s for k in range(window)})


def normal_line(line: str) -> str:
    plain = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    return plain.translate(str.maketrans("123456789", "0" * 9))


def _hash(line: str) -> int:
    return int(hashlib.md5(line.encode()).hexdigest()[:15], 16)


def line_frequency(rows: list[tuple], min_documents: int, max_share: float, min_kept: float) -> dict:
    """doc_id: (kept, clean text) of rows (doc_id, text, host)."""
    companions, hosts, lines = defaultdict(set), Counter(), {}
    for doc_id, text, host in rows:
        hosts[host or ""] += 1
        hashes = [_hash(normal_line(x)) if normal_line(x) else None for x in (text or "").split("\n")]
        lines[doc_id] = hashes
        known = sorted({h for h in hashes if h is not None})
        for h in known:
            companions[host or "", h].add(next((k for k in known if k != h), h))
    result = {}
    for doc_id, text, host in rows:
        frequent = lambda h: len(companions[host or "", h]) >= max(min_documents, max_share * hosts[host or ""])  # noqa: B023, E731
        gone = [h is not None and frequent(h) for h in lines[doc_id]]
        words = WORD.findall(text or "")
        left = " ".join(x for x, g in zip((text or "").split("\n"), gone, strict=True) if not g)
        failed = len(words) < 10 or 100 * repeated_words(words) > 20 * len(words)
        kept = not failed and len(WORD.findall(left)) >= min_kept * len(words)
        clean = "\n".join(x for x, g in zip((text or "").split("\n"), gone, strict=True) if not g)
        result[doc_id] = (kept, None if text is None else clean)
    return result


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_components(rows: list[tuple], size: int, percent: int = 80) -> dict:
    """doc_id: least doc_id reachable, by comparing all that share a shingle."""
    sets = {doc_id: shingles(text, size) for doc_id, text in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(other for s in sets[d] for other in holders[s])
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in sets}


def exact_groups(rows: list[tuple]) -> dict:
    """doc_id: id that stays, of rows (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(str.maketrans("", "", SPACES))].append((-len(text or ""), doc_id))
    return {d: min(g)[1] for g in groups.values() for _, d in g}


def uniform(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson(u: float, mean: float) -> int:
    """Least k whose cumulative probability is above u."""
    k, term = 0, math.exp(-mean)
    total = term
    while total <= u and k < 400:
        k += 1
        term *= mean / k
        total += term
    return k


def copies(rows: list[tuple], temperature: float, seed: int = 0) -> dict:
    """doc_id: number of copies, of rows (doc_id, text, source), for means up to 16."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode()) + 1
    weights = {s: n**temperature for s, n in sizes.items()}
    mean = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s in sizes}
    assert all(m <= 16 for m in mean.values())
    return {d: poisson(uniform(f"{seed}|draw|{d}|1"), mean[source]) for d, _, source in rows}


def tokenizer(tokens: list[bytes], pattern: str) -> tiktoken.Encoding:
    ranks = {t: n for n, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
