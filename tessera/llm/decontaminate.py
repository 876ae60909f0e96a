"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, materialize, small_batches, table, tidy, trimmed
from tessera.llm.license_scan import license_words

SHINGLE, PERCENT = 5, 80
#: Fingerprints of similar windows (0.8 or more) differ in 10 of 64 bits on average, with a deviation of 2.9.
RADIUS, BLOCKS = 23, 8
#: Items are held by every task; beyond so many characters they are searched in several passes.
PASS_CHARS = 8 << 20


def shingles(w, k: int = SHINGLE):
    """64-bit hashes of the k-word shingles at each place of an array of word hashes; a shorter text is one shingle."""
    import numpy as np

    k = min(k, len(w))
    s = np.full(max(len(w) - k + 1, 0), k, dtype=np.uint64)
    for j in range(k):
        s = (s ^ w[j : j + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return s


def word_hashes(words: list[bytes], hashes: WordHashes):
    import numpy as np

    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def window_fingerprints(s, n: int):
    """SimHash of each run of n shingles; a shingle weighs as often as it occurs, so sums over places give it."""
    import numpy as np

    bits = ((s[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
    total = np.zeros((len(s) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    votes = (total[n:] - total[:-n]) > 0
    return (votes.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Finds all fingerprints within RADIUS: one of BLOCKS bytes then differs in RADIUS // BLOCKS bits at most.

    A table per byte lists, for each of its 256 values, the fingerprints whose byte is so near, so a search is
    one lookup a byte and a comparison of what it lists.
    """

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.packbits(np.bitwise_count(values[:, None] ^ part) <= RADIUS // BLOCKS, axis=1) for part in codes.astype("<u8").view(np.uint8).reshape(-1, BLOCKS).T]

    def within(self, codes):
        """Pairs of a code's place and a fingerprint's, for many codes at once."""
        import numpy as np

        parts = codes.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        found = self.near[0][parts[:, 0]]
        for b in range(1, BLOCKS):
            found |= self.near[b][parts[:, b]]
        at, of = np.nonzero(np.unpackbits(found, axis=1, count=len(self.codes)))
        hit = np.bitwise_count(self.codes[of] ^ codes[at]) <= RADIUS
        return at[hit].tolist(), of[hit].tolist()


class Items:
    """Benchmark items by their number of shingles."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import numpy as np

        hashes = WordHashes()
        self.ids, self.counts, self.sizes = [], [], defaultdict(list)
        postings: dict[int, set[int]] = defaultdict(set)
        self.single: dict[tuple[int, int], list[int]] = defaultdict(list)  # items of one shingle, by words and shingle
        codes = []
        for item_id, text in items:
            words = license_words(text)
            if not words:
                continue
            s = shingles(word_hashes(words, hashes))
            k = min(SHINGLE, len(words))
            size = (k, len(s))
            at = len(self.ids)
            self.ids.append(item_id)
            self.counts.append(Counter(s.tolist()))
            self.sizes[size].append(at)
            codes.append(window_fingerprints(s, len(s))[0])
            if len(s) == 1:
                self.single[k, int(s[0])].append(at)
            for x in self.counts[-1]:
                postings[x].add(size)
        self.postings = dict(postings)
        self.known = {k: np.array(sorted(x for x, sizes in postings.items() if any(z[0] == k for z in sizes)), dtype=np.uint64) for k in {k for k, _ in self.sizes}}
        self.index = {size: HammingIndex(np.array([codes[i] for i in of], dtype=np.uint64)) for size, of in self.sizes.items() if size[1] > 1}

    def search(self, words: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) for each item with a similar window, its best one (then first)."""
        import numpy as np

        w, best = word_hashes(words, hashes), {}
        for k, known in self.known.items():
            if len(w) < k:
                continue
            s = shingles(w, k)
            # a window that shares no shingle with any item is similar to none
            at = np.searchsorted(known, s)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == s)
            wanted: dict[tuple[int, int], list[int]] = defaultdict(list)
            for h in hits.tolist():
                for size in self.postings[int(s[h])]:
                    if size[0] == k:
                        wanted[size].append(h)
            for size, places in wanted.items():
                self._windows(s, size, places, best)
        return [(self.ids[i], start, n, sim) for i, (sim, start, n) in sorted(best.items())]

    def _windows(self, s, size, places, best) -> None:
        k, n = size
        if n == 1:  # alike only if equal
            for h in places:
                for item in self.single.get((k, int(s[h])), []):
                    if item not in best:
                        best[item] = (1.0, h, k)
            return
        if len(s) < n:
            return
        runs, at = [], 0  # window starts that hold a hit, as runs
        for h in places:
            a, b = max(0, h - n + 1, at), min(h, len(s) - n)
            if a <= b:
                if runs and runs[-1][1] >= a - 1:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
                at = b + 1
        for first, last in runs:
            step = max(1, min(4096, (1 << 22) // len(self.sizes[size])))
            for a in range(first, last + 1, step):
                b = min(last, a + step - 1)
                now, mine = -1, Counter()
                for j, c in zip(*self.index[size].within(window_fingerprints(s[a : b + n], n)), strict=True):
                    if j != now:
                        now, mine = j, Counter(s[a + j : a + j + n].tolist())
                    item = self.sizes[size][c]
                    both = sum((mine & self.counts[item]).values())
                    either = 2 * n - both
                    if 100 * both >= PERCENT * either and (item not in best or both / either > best[item][0]):
                        best[item] = (both / either, a + j, n + k - 1)


def _passes(benchmark: DataFrame, id_col: str, text_col: str, nameless: bool = False) -> Iterator[list[tuple[int | None, str]]]:
    """Items in passes of bounded size, each collected alone; those with a null id only if `nameless`."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = items if nameless else items.where("item_id is not null")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // PASS_CHARS))
    for i in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r.item_id, r.text) for r in some.collect()), key=lambda x: (x[0] is not None, x))


def _search(items: list[tuple[int | None, str]], id_at: int, text_at: int, drop: bool):
    def run(batches):
        import pyarrow as pa

        found, hashes = Items(items), WordHashes()
        for batch in batches:
            hits = [found.search(license_words(t), hashes) for t in batch.column(text_at).to_pylist()]
            if drop:
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))
                continue
            rows = [(d, *h) for d, hs in zip(batch.column(id_at).to_pylist(), hits, strict=True) for h in hs]
            cols, types = list(zip(*rows, strict=True)) or [[]] * 5, [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


@small_batches
@tidy
def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, first_word, n_words, similarity; a row for each pair.

    Words are digits, letters (A-Z lower-cased) and all beyond ASCII. Every window of an item's length in every text is
    considered: one without any of the benchmark's shingles can't be similar; of the others a SimHash over their
    5-word shingles, weighted by occurrence, is looked up among the items of that length, and all within the radius
    are verified by weighted Jaccard similarity (sum of least over sum of largest counts) of 0.8 or more. The best
    window of an item is returned. Items shorter than five words are one shingle. Null or empty texts and items
    match nothing, and items with a null item_id have no rows here (without_leaks searches them). Ids are whole
    numbers (cast to bigint; others become null). A pair of similarity 0.8 lies outside the radius with a chance of about 1e-5, exact ones never.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _passes(benchmark, item_col, "text"):
        some = materialize(rows.mapInArrow(trimmed(_search(items, 0, 1, False)), "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double"))
        out = some if out is None else out.unionByName(some)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark item, whatever its item_id, with all their columns. Nothing is shuffled."""
    for items in _passes(benchmark, item_col, "text", nameless=True):
        docs = docs.mapInArrow(trimmed(_search(items, docs.columns.index(id_col), docs.columns.index(text_col), True)), docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of `benchmark` in all documents: doc_id, item_id, first_word, n_words, similarity."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
