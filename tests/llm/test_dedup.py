"""Exact, near and passage duplicates against plain implementations."""

import hashlib
import re
from collections import Counter, defaultdict

import brute
import pytest
from conftest import SF

from tessera.llm import decontaminate, exact_dedup, near_dedup, queries, suffix_dedup


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is not None, i or 0, i))
    out, stays = Counter(), set()
    for i, t in rows:
        best = min(groups[norm(t)])
        kept = (-len(t or ""), i is not None, i or 0, i) == best and norm(t) not in stays  # one of rows that repeat
        stays |= {norm(t)} if kept else set()
        out[(i, best[3], len(groups[norm(t)]), kept, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    return out


def found_exact(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha256).hex()) for r in df.collect())


@pytest.mark.parametrize("bits", [4, 22])
def test_exact_dedup(tricky_docs, tricky, bits):
    want = plain_exact([(i, t) for i, t, _ in tricky])
    assert found_exact(exact_dedup.exact_dedup(tricky_docs, digest=True, bits=bits)) == want


def test_exact_dedup_hashes_survivors_only(spark):
    """Lengths and prefixes decide where they can; equal prefixes of equal length with other ends are told apart."""
    rows = [(1, "a" * 200), (2, "a" * 199 + "b"), (3, " " + "a" * 200), (4, "short"), (5, "tests"), (6, None), (7, ""), (7, " "), (8, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = Counter((i, k, n, kept) for (i, k, n, kept, _), c in plain_exact(rows).items() for _ in range(c))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()) == want


def test_exact_dedup_empty(empty_docs):
    assert exact_dedup.exact_dedup(empty_docs).collect() == []


def test_near_dedup_is_brute_force(spark, tricky_docs, tricky):
    rows = [(i, t) for i, t, _ in tricky]
    for k in (2, 5):
        by_id = {i: t for i, t in rows if i is not None}
        want = brute.near(list(by_id.items()), k)
        got = near_dedup.near_dedup(tricky_docs, words=k).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_near_dedup_on_documents(spark, documents):
    want = brute.near(documents, 2)
    got = queries.QUERIES["op10_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_dedup_second_round(spark):
    """Texts that resemble a bucket's other texts, but not its smallest one, are linked too."""
    import random

    rng = random.Random(3)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(200):  # a star of two far arms: arms are alike within, not across
        w = [*base]
        arm = i % 2
        for j in range(12):
            w[rng.randrange(75) + 75 * arm] = f"arm{arm}_{j}"
        rows.append((1000 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, words=2).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows, 2).items()}


def test_near_dedup_empty(empty_docs):
    assert near_dedup.near_dedup(empty_docs).collect() == []


def found_suffix(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_dedup_is_brute_force(tricky_docs, tricky):
    rows = [(i, t) for i, t, _ in tricky if t is None or len(t) < 100_000]
    docs = tricky_docs.where("text is null or length(text) < 100000")
    assert found_suffix(suffix_dedup.suffix_dedup(docs)) == brute.suffix(rows, 50)


def test_suffix_dedup_shallow(spark):
    rows = [(3, "abcabcabcabcabcabc"), (1, "xxabcabcabcx"), (2, "aaaaaaaaaaaaaaaaaaaa"), (4, "aaaaaaaaaaaaaaaaaaab"), (5, None), (6, "é" * 20), (7, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_suffix(suffix_dedup.suffix_dedup(docs, depth=9, k=8)) == brute.suffix(rows, 9)


def test_suffix_dedup_on_documents(spark, documents):
    some = documents[:400]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").repartition(6)
    got = found_suffix(suffix_dedup.suffix_dedup(docs))
    assert got == brute.suffix(some, 50)
    assert sum(n for (_, _, n, _, _), c in got.items() for _ in range(c)) > 1000


def test_suffix_dedup_returns_contents(spark):
    text = "The quick brown fox jumps over the lazy dog, again and again and again."
    docs = spark.createDataFrame([(1, text), (2, f"<<{text}>>")], "doc_id bigint, text string")
    two = next(r for r in suffix_dedup.suffix_dedup(docs).collect() if r.doc_id == 2)
    assert bytes(two.kept) == b"<<>>" and two.edges == [2, 2 + len(text)]


def test_suffix_dedup_empty(empty_docs):
    assert suffix_dedup.suffix_dedup(empty_docs).collect() == []


def test_near_dedup_refuses_what_its_sieves_lose(empty_docs):
    with pytest.raises(ValueError, match="79"):
        near_dedup.near_dedup(empty_docs, percent=79)


def plain_leaks(docs, items, k=5):
    split = lambda t: [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    def grams(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    found = {}
    for d, text in docs:
        w = split(text)
        for item, t in items:
            v = split(t)
            n = min(k, len(v))
            if not v or not set(grams(w, n)) & set(grams(v, n)):
                continue
            want = grams(v, n)
            best = 0.0
            for a in range(len(w) - len(v) + 1):
                mine = grams(w[a : a + len(v)], n)
                both = sum((mine & want).values())
                either = sum((mine | want).values())
                if 100 * both >= 80 * either:
                    best = max(best, both / either)
            if best:
                found[d, item] = best
    return found


def test_leaks_are_brute_force(spark, documents):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/benchmark.parquet")
    items = list(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist(), strict=True))
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.QUERIES["op2_decontaminate"](spark, SF).collect()}
    want = plain_leaks(documents, items)
    assert got == pytest.approx(want) and len(want) > 5


def test_items_without_an_id_leave_no_passage(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of it is here at all"), (3, "eleven"), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, passage), (None, "eleven"), (None, None), (5, "never seen")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {2, 4}
    assert decontaminate.leaks(docs, bench).collect() == []


def test_leaks_of_awkward_items(spark, tricky_docs, empty_docs, tricky):
    items = [(1, None), (2, ""), (3, "one"), (4, tricky[0][1]), (5, "never seen here at all"), (None, "one"), (6, tricky[12][1]), (6, tricky[12][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(tricky_docs, bench).collect()}
    want = set(plain_leaks([(i, t) for i, t, _ in tricky if t is None or len(t) < 300_000 and i != 9], [x for x in items if x[0] is not None]))
    assert {x for x in got if x[0] != 9} == want
    left = decontaminate.without_leaks(tricky_docs, bench)
    assert left.columns == tricky_docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in tricky} - {d for d, _ in got} | {None}
    assert decontaminate.leaks(empty_docs, bench).collect() == []
    assert decontaminate.without_leaks(empty_docs, bench).collect() == []
    assert decontaminate.leaks(tricky_docs, bench.limit(0)).collect() == []
    assert decontaminate.without_leaks(tricky_docs, bench.limit(0)).count() == len(tricky)


def test_hamming_index_is_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index, asked = decontaminate.HammingIndex(codes), codes[:200].copy()
    for i in range(200):
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(b)
    want = [(i, j) for i, code in enumerate(asked) for j in np.flatnonzero(np.bitwise_count(codes ^ code) <= decontaminate.RADIUS)]
    assert list(zip(*index.within(asked), strict=True)) == want


def test_near_dedup_beyond_a_block(spark, monkeypatch):
    """Buckets on either side of the size at which they are refined and cut into blocks lose no link."""
    import random

    rng = random.Random(6)
    rows, base = [], [f"w{rng.randrange(400)}" for _ in range(90)]
    for i in range(120):
        w = [*base] if i % 3 else [f"w{rng.randrange(400)}" for _ in range(90)]
        for j in rng.sample(range(90), 7):
            w[j] = f"x{i}_{j}"
        rows.append((500 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = {i: c for i, (_, c) in brute.near(rows, 2).items()}
    for block in (3, 512):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, words=2).collect()} == want


def test_components_of_paths_and_stars(spark):
    import random

    rng = random.Random(1)
    links, want = [], {}
    for start, n in ((0, 40), (1000, 3), (2000, 2)):
        ids = rng.sample(range(start, start + 500), n)
        links += list(zip(ids, ids[1:], strict=False))
        want |= {i: min(ids) for i in ids}
    links += [(5000, 5000 + i) for i in range(1, 60)] + [(5000, 5001), (7, 7)]
    want |= {5000 + i: 5000 for i in range(60)}
    rng.shuffle(links)
    got = {r.v: r.c for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: c for i, c in want.items() if i != c}
