"""Removing long byte strings that an earlier document holds: depth-limited radix sorting of suffixes.

A suffix matters only through its first DEPTH bytes, its window. Most-significant-digit passes order windows
digit by digit and drop every group that can't hold a repeat, so deeper digits are read for few of them:

1. Digit one is the window's anchor, the K-byte string in it with the smallest hash (leftmost on ties). Equal windows
   have equal anchors at equal places. A run of windows with one anchor occurrence is a stretch; digit two is the
   stretch's content. One entry per distinct (anchor, stretch) of a pack of documents is sorted, about one for
   14 bytes of text. Equal stretches hold equal windows, so their first document owns all of them.
2. Only where stretches of different content share an anchor, at the edges of repeated passages mostly, windows
   are sorted to full depth, one entry per distinct window of a pack. Equal groups are exactly the repeated windows.

Entries are pre-aggregated by pack, so a passage that a third of all documents hold sends one entry per pack.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, partitions_for, small_batches, table, tidy

DEPTH, K = 50, 24
#: Documents are packed to about so many bytes; a longer document is a pack of its own.
PACK = 2 << 20
POS_BITS = 26


def _pack(batches):
    """Packs of documents: ids, lengths and the texts end to end, compressed."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def row():
        nonlocal n, ids, texts, size
        order = np.array([-(1 << 63) if x is None else x for x in ids], dtype=np.int64)
        blob = zlib.compress(b"".join(texts), 1)
        out = pa.RecordBatch.from_arrays(
            [pa.array([task * (1 << 32) + n], pa.int64()), pa.array([order.tobytes()], pa.binary()), pa.array([bytes(x is None for x in ids)], pa.binary()), pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()], pa.binary()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())],
            names=["pack", "ids", "none", "lengths", "blob", "size"],
        )
        n, ids, texts, size = n + 1, [], [], 0
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = (text or "").encode("utf-8", "surrogatepass")
            if size + len(b) > PACK and size:
                yield row()
            ids.append(doc_id), texts.append(b)
            size += len(b)
    if ids:
        yield row()


class Pack:
    """A pack's bytes with its windows' anchors, all as arrays."""

    def __init__(self, ids: bytes, lengths: bytes, blob: bytes, depth: int):
        import numpy as np

        self.np, self.depth = np, depth
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.lengths = np.frombuffer(lengths, dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.bytes = zlib.decompress(blob)
        self.data = np.frombuffer(self.bytes + bytes(8), dtype=np.uint8)
        self.x8 = np.ndarray(shape=(len(self.bytes) + 1,), dtype="<u8", buffer=self.data, strides=(1,))

    def window_hash(self, at, salt: int = 0):
        """64-bit hashes of the windows that start at the positions."""
        np, h = self.np, None
        places = [*range(0, self.depth - 7, 8)]
        if places[-1] != self.depth - 8:
            places.append(self.depth - 8)
        for j, p in enumerate(places):
            x = (self.x8[at + p] ^ np.uint64((0x243F6A8885A308D3 * (2 * j + 1 + 64 * salt)) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            h = x if h is None else (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h

    def stretches(self, k: int):
        """Of each stretch: first and last window start, document index, anchor hash and content hash.

        A stretch is a longest run of windows of one document that select one anchor occurrence.
        """
        np, n, depth = self.np, len(self.bytes), self.depth
        starts = self.ends - self.lengths
        m = n - depth + 1
        if m <= 0:
            return [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        assert n < 1 << POS_BITS or len(self.ids) == 1, "a pack is too large"
        pos_bits = max(POS_BITS, int(n).bit_length())
        g = n - k + 1
        x = self.x8[:g] * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        for p in sorted({*range(8, k - 7, 8), k - 8} - {0}):
            x = (x ^ self.x8[p : p + g]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        low = x & ~np.uint64((1 << pos_bits) - 1)
        low |= np.arange(g, dtype=np.uint64)
        w, span = depth - k + 1, 1  # sliding minimum over w keys by doubling
        while span * 2 <= w:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        anchor = (low[:m] & np.uint64((1 << pos_bits) - 1)).view(np.int64)
        del low
        inside = np.zeros(m + 1, dtype=np.int8)  # 1 where a window lies within its document
        ok = self.lengths >= depth
        np.add.at(inside, starts[ok], 1)
        np.add.at(inside, self.ends[ok] - depth + 1, -1)
        inside = np.cumsum(inside[:m], dtype=np.int8) > 0
        first = np.ones(m, dtype=bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        first[starts[(starts < m)]] = True
        first &= inside
        lo = np.flatnonzero(first)
        if not len(lo):
            return [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
        doc = np.searchsorted(self.ends, lo, side="right")
        hi = np.empty(len(lo), dtype=np.int64)
        hi[:-1] = lo[1:] - 1
        hi[-1] = m - 1
        hi = np.minimum(hi, self.ends[doc] - depth)
        # contents: the first and the last window cover a stretch, as they overlap
        content = (self.window_hash(lo) * np.uint64(0xBF58476D1CE4E5B9)) ^ self.window_hash(hi, 1) ^ (hi - lo).astype(np.uint64)
        content = (content ^ (content >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        # anchors have the smallest hashes of their windows, so they are hashed again to spread evenly
        digit = (x[anchor[lo]] ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xBF58476D1CE4E5B9)
        digit = (digit ^ (digit >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return lo, hi, doc, digit ^ (digit >> np.uint64(32)), content ^ (content >> np.uint64(31))

    def least_ids(self, keys: list, doc):
        """Distinct keys in sorted order, each row's number among them, and the least id of each."""
        np = self.np
        order = np.lexsort([*keys[::-1]])
        new = np.zeros(len(order), dtype=bool)
        if len(order):
            new[0] = True
        for x in keys:
            y = x[order]
            new[1:] |= y[1:] != y[:-1]
        at = np.flatnonzero(new)
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[doc[order]], at) if len(at) else np.empty(0, dtype=np.int64)
        return [x[order][at] for x in keys], of, least


def _sent(np, pack: int, keys: list, owner, n_parts: int):
    """One row per target partition: the entries' keys, and their owners as places in a list of ids."""
    # the first key's high bits are its digit; entries are sorted by it, so a partition's are adjacent
    part = (((keys[0] >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(n_parts + 1))
    for p in range(n_parts):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            ids, place = np.unique(owner[a:b], return_inverse=True)
            width = np.uint16 if len(ids) < 1 << 16 else np.uint32
            yield p, pack, b"".join(_cut(np, k[a:b]) for k in keys), ids.tobytes() + place.astype(width).tobytes(), int(b - a), len(ids)


def _cut(np, key) -> bytes:
    """The top 48 bits of each key."""
    return key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _uncut(np, data: bytes, n: int):
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(n, 6)
    return out.view(">u8").reshape(n).astype(np.uint64)


SENT = "part int, pack bigint, entries binary, owners binary, n int, n_ids int"
ANSWER = "pack bigint, part int, least binary, flags binary"


def _to_batch(rows, schema):
    import pyarrow as pa

    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _stretch_entries(depth: int, k: int, n_parts: int):
    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids, lengths, blob = (batch.column(c)[i].as_py() for c in ("pack", "ids", "lengths", "blob"))
                p = Pack(ids, lengths, blob, depth)
                _, _, doc, anchor, content = p.stretches(k)
                keys, _, least = p.least_ids([anchor, content], doc)
                yield _to_batch(list(_sent(np, pack, keys, least, n_parts)), SENT)

    return run


def _sorted_groups(two_keys: bool):
    """The reducer of a pass: sorts a partition's entries and answers each pack.

    Per entry it answers the group's least id, and whether its anchor's group needs the next digit: it has
    different contents and more than one document.
    """

    def run(batches):
        import numpy as np

        packs, parts, keys, own, sizes = [], [], [[], []], [], []
        for batch in batches:
            for part, pack, entries, owners, n, n_ids in zip(*[batch.column(c).to_pylist() for c in ("part", "pack", "entries", "owners", "n", "n_ids")], strict=True):
                packs.append(pack), parts.append(part), sizes.append(n)
                keys[0].append(_uncut(np, entries[: 6 * n], n))
                if two_keys:
                    keys[1].append(_uncut(np, entries[6 * n :], n))
                ids = np.frombuffer(owners[: 8 * n_ids], dtype=np.int64)
                own.append(ids[np.frombuffer(owners[8 * n_ids :], dtype=np.uint16 if n_ids < 1 << 16 else np.uint32)])
        if not packs:
            return
        owner, first = np.concatenate(own), np.concatenate(keys[0])
        second = np.concatenate(keys[1]) if two_keys else None
        del own, keys
        order = np.lexsort([second, first]) if two_keys else np.argsort(first, kind="stable")
        a = first[order]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new = new_a.copy()
        if two_keys:
            s = second[order]
            new[1:] |= s[1:] != s[:-1]
        at = np.flatnonzero(new)
        lows = np.minimum.reduceat(owner[order], at)
        least = np.empty(len(order), dtype=np.int64)
        least[order] = np.repeat(lows, np.diff(np.r_[at, len(order)]))
        flags = np.zeros(len(order), dtype=np.uint8)
        if two_keys:
            starts = np.flatnonzero(new_a)
            contents = np.add.reduceat(new.astype(np.int64), starts)
            # contents of one anchor that all belong to one document still hold no repeat between documents
            lo, hi = (f.reduceat(owner[order], starts) for f in (np.minimum, np.maximum))
            deeper = (contents > 1) & (lo != hi)
            flags[order] = np.repeat(deeper, np.diff(np.r_[starts, len(order)]))
        at = 0
        rows = []
        for pack, part, n in zip(packs, parts, sizes, strict=True):
            mine, low, flag = owner[at : at + n], least[at : at + n], flags[at : at + n]
            at += n
            ids, place = np.unique(np.where(low < mine, low, mine), return_inverse=True)
            # owners as the list of ids, its length first, and the places, compressed
            width = np.uint16 if len(ids) < 1 << 16 else np.uint32
            rows.append((pack, part, zlib.compress(np.int64(len(ids)).tobytes() + ids.tobytes() + place.astype(width).tobytes(), 1), zlib.compress(np.packbits(flag).tobytes(), 1)))
            if len(rows) == 256:
                yield _to_batch(rows, ANSWER)
                rows = []
        yield _to_batch(rows, ANSWER)

    return run


def _answers(np, answers, n_entries: int):
    """A pack's answers in the order of its sorted entries: least ids and flags."""
    least, flags = [], []
    for a in sorted(answers or [], key=lambda a: a["part"]):
        raw = zlib.decompress(a["least"])
        n_ids = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
        ids = np.frombuffer(raw[8 : 8 + 8 * n_ids], dtype=np.int64)
        place = np.frombuffer(raw[8 + 8 * n_ids :], dtype=np.uint16 if n_ids < 1 << 16 else np.uint32)
        least.append(ids[place])
        flags.append(np.unpackbits(np.frombuffer(zlib.decompress(a["flags"]), dtype=np.uint8))[: len(place)])
    least = np.concatenate(least) if least else np.empty(0, dtype=np.int64)
    assert len(least) == n_entries, "answers are missing"
    return least, np.concatenate(flags).astype(bool) if flags else np.empty(0, dtype=bool)


def _deep_windows(p: Pack, k: int, answers):
    """The stretches of a pack with their owners, and the windows that need full depth."""
    np = p.np
    lo, hi, doc, anchor, content = p.stretches(k)
    keys, of, mine = p.least_ids([anchor, content], doc)
    least, deep = _answers(np, answers, len(keys[0]))
    owner, deep = least[of], deep[of]
    # a stretch that is in an earlier document as a whole is decided
    ask = np.flatnonzero(deep & (owner >= p.ids[doc]))
    n = hi[ask] - lo[ask] + 1
    at = np.repeat(lo[ask] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    return lo, hi, doc, owner, at, np.repeat(doc[ask], n)


def _window_entries(depth: int, k: int, n_parts: int):
    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids, lengths, blob, answers = (batch.column(c)[i].as_py() for c in ("pack", "ids", "lengths", "blob", "answers"))
                p = Pack(ids, lengths, blob, depth)
                *_, at, doc = _deep_windows(p, k, answers)
                keys, _, least = p.least_ids([p.window_hash(at), p.window_hash(at, 2)], doc)
                yield _to_batch(list(_sent(np, pack, keys, least, n_parts)), SENT)

    return run


def _removed(depth: int, k: int):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids, none, lengths, blob, answers, deeper = (batch.column(c)[i].as_py() for c in ("ids", "none", "lengths", "blob", "answers", "deeper"))
                p = Pack(ids, lengths, blob, depth)
                lo, hi, doc, owner, at, at_doc = _deep_windows(p, k, answers)
                n = len(p.bytes)
                cover = np.zeros(n + 1, dtype=np.int32)
                gone = owner < p.ids[doc]
                cover[lo[gone]] += 1
                cover[hi[gone] + depth] -= 1  # starts are distinct, and so are ends
                keys, of, _ = p.least_ids([p.window_hash(at), p.window_hash(at, 2)], at_doc)
                least, _ = _answers(np, deeper, len(keys[0]))
                hit = at[least[of] < p.ids[at_doc]]
                cover[hit] += 1
                cover[hit + depth] -= 1
                cover = np.cumsum(cover[:n]) > 0
                rows = []
                for end, size, doc_id, null in zip(p.ends.tolist(), p.lengths.tolist(), p.ids.tolist(), none, strict=True):
                    c = cover[end - size : end]
                    kept = p.data[end - size : end][~c].tobytes()
                    edge = np.flatnonzero(np.diff(np.r_[False, c, False].astype(np.int8)))
                    rows.append((None if null else doc_id, size, size - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype(np.int64), kept))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges", "kept"])

    return run


@small_batches
@tidy
def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH, k: int = K, contents: bool = True) -> DataFrame:
    """Remove every byte covered by a `depth`-byte string that also starts in a document with a smaller id.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (longest removed runs), kept_sha256, and with
    contents=True edges (starts and ends of the runs, in bytes) and kept (the remaining bytes). Texts are UTF-8
    bytes, null counts as empty, matches don't cross documents, strings are judged on the input. Rows with one
    doc_id don't remove each other; a null id is smaller than all others. Hashes of 96 bits stand for contents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packs = materialize(docs.mapInArrow(_pack, "pack bigint, ids binary, none binary, lengths binary, blob binary, size bigint"), "uncompressed")
    # about 16 MB of text, some 15 MB of entries, for each sorting task
    n_parts = partitions_for(spark, max(8, (packs.agg(F.sum("size")).first()[0] or 0) >> 24))
    one_pack = packs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:

        def answered(entries: DataFrame, two_keys: bool) -> DataFrame:
            dealt = entries.repartition(n_parts, "part")
            found = materialize(dealt.mapInArrow(_sorted_groups(two_keys), ANSWER), "uncompressed")
            return found.groupBy("pack").agg(F.collect_list(F.struct("part", "least", "flags")).alias("answers"))

        columns = ["pack", "ids", "lengths", "blob"]
        first = answered(packs.select(*columns).mapInArrow(_stretch_entries(depth, k, n_parts), SENT), True)
        asked = packs.select(*columns).join(first, "pack", "left")
        second = answered(asked.mapInArrow(_window_entries(depth, k, n_parts), SENT), True).withColumnRenamed("answers", "deeper")
        whole = packs.join(first, "pack", "left").join(second, "pack", "left")
        out = whole.mapInArrow(_removed(depth, k), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, edges array<bigint>, kept binary")
        return materialize(out if contents else out.drop("edges", "kept"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", one_pack)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that an earlier one holds too: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(table(spark, sf_dir, "documents"), contents=False)


#: Every string of 50 bytes with its first document; starts at most 50 apart make one removed run.
OP4_SQL = """
WITH g AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 610) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 256)) AS base FROM g WHERE n >= 50)),
w AS (SELECT doc_id, base + q AS p, substr(part, 2 * q + 1, 100) AS s FROM (SELECT doc_id, base, part, unnest(range(least(256, n - 49 - base))) AS q FROM c)),
o AS (SELECT s, min(doc_id) AS own FROM w GROUP BY s),
x AS (SELECT doc_id, p FROM w JOIN o USING (s) WHERE own < doc_id),
y AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM y),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM z GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS gone, count(*) AS spans FROM t JOIN g USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM g LEFT JOIN k USING (doc_id)
"""
