"""Token ids in wavelet-matrix files: encode, write shards in id order, read back, and query without decoding.

A shard file holds the ids of consecutive documents as a wavelet matrix over the shard's own alphabet, its sorted
distinct ids: for each bit of an id's rank in it, from the highest on, a plane with that bit of every id, ids
being stably parted by bit from plane to plane. With ranks sampled every
RANK_BLOCK bits this gives, from the compressed file alone, any token (access), how often an id occurs before
a place (rank) and where its j-th occurrence is (select).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import give_back, materialize, partitions_for, shared_dir, small_batches, table, trimmed

MAGIC = b"WMTX2\0"
RANK_BLOCK = 4096
#: A shard is closed once it has so many ids; one longer document is a shard of its own.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Built from ids, or opened from bytes; planes decompress on first use."""

    def __init__(self, n: int, bits: int, alphabet, zeros: list[int], planes: list, ranks: list):
        self.n, self.bits, self.alphabet, self.zeros, self._planes, self._ranks = n, bits, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids) -> WaveletMatrix:
        import numpy as np

        ids = np.asarray(ids, dtype=np.uint32)
        seen = np.bincount(ids) if len(ids) and ids.max() < 1 << 24 else None
        alphabet = (np.unique(ids) if seen is None else np.flatnonzero(seen)).astype("<u4")
        if seen is None:
            x = np.searchsorted(alphabet, ids).astype(np.uint32)
        else:
            rank = np.zeros(len(seen), dtype=np.uint32)
            rank[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            x = rank[ids]
        bits = max(1, (len(alphabet) - 1).bit_length())
        x = x.astype(np.uint16) if bits <= 16 else x
        zeros, planes, ranks = [], [], []
        n_blocks = -(-max(len(x), 1) // RANK_BLOCK)
        for b in range(bits - 1, -1, -1):
            bit = (x & x.dtype.type(1 << b)) != 0
            packed = np.packbits(bit)
            low = x.take(np.flatnonzero(~bit))  # places rather than a mask: bits are hard to predict
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(bit))])
            planes.append(packed)
            blocks = np.zeros(n_blocks * RANK_BLOCK // 8, dtype=np.uint8)
            blocks[: len(packed)] = packed
            ones = np.bitwise_count(blocks.view(np.uint64)).reshape(n_blocks, -1).sum(axis=1, dtype=np.uint32)
            ranks.append(np.r_[0, np.cumsum(ones)].astype(np.uint32))
        return cls(len(ids), bits, alphabet, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        import struct

        press = zstandard.ZstdCompressor(level=1).compress
        body = [press(p.tobytes()) for p in self._planes] + [press(r.astype("<u4").tobytes()) for r in self._ranks] + [press(self.alphabet.tobytes())]
        head = struct.pack("<QI", self.n, self.bits) + struct.pack(f"<{self.bits}Q", *self.zeros) + struct.pack(f"<{2 * self.bits + 1}Q", *map(len, body))
        return MAGIC + head + b"".join(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import struct

        import numpy as np

        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)
        n, bits = struct.unpack_from("<QI", data, at)
        at += 12
        zeros = list(struct.unpack_from(f"<{bits}Q", data, at))
        sizes = struct.unpack_from(f"<{2 * bits + 1}Q", data, at + 8 * bits)
        at += 24 * bits + 8
        parts = []
        for s in sizes:
            parts.append(data[at : at + s])
            at += s
        alphabet = np.frombuffer(zstandard.decompress(parts[-1]) if n else b"", dtype="<u4")
        return cls(n, bits, alphabet, zeros, parts[:bits], parts[bits:-1])

    def _plane(self, b: int):
        import numpy as np

        if isinstance(self._planes[b], bytes):
            self._planes[b] = np.frombuffer(zstandard.decompress(self._planes[b]), dtype=np.uint8)
        if isinstance(self._ranks[b], bytes):
            self._ranks[b] = np.frombuffer(zstandard.decompress(self._ranks[b]), dtype="<u4")
        return self._planes[b], self._ranks[b]

    def _ones(self, b: int, i: int) -> int:
        """Ones among the first i bits of plane b."""
        import numpy as np

        plane, ranks = self._plane(b)
        block = i // RANK_BLOCK
        rest = np.unpackbits(plane[block * RANK_BLOCK // 8 : (i + 7) // 8])[: i - block * RANK_BLOCK]
        return int(ranks[block]) + int(rest.sum())

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for b in range(self.bits):
            bit = (int(self._plane(b)[0][i >> 3]) >> (7 - (i & 7))) & 1
            value = value << 1 | bit
            ones = self._ones(b, i)
            i = self.zeros[b] + ones if bit else i - ones
        return int(self.alphabet[value])

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i."""
        import numpy as np

        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0
        lo, hi = 0, i
        for b in range(self.bits):
            one_lo, one_hi = self._ones(b, lo), self._ones(b, hi)
            if code >> (self.bits - 1 - b) & 1:
                lo, hi = self.zeros[b] + one_lo, self.zeros[b] + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The place of the id's j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        lo, hi = 0, self.n  # the smallest place with j + 1 occurrences up to it
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(token, mid + 1) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self):
        """All ids, by undoing the stable parting plane by plane, the last one first."""
        import numpy as np

        value = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._plane(b)[0])[: self.n].view(bool)
            before = np.empty_like(value)
            before[np.flatnonzero(~bit)] = value[: self.zeros[b]]
            before[np.flatnonzero(bit)] = value[self.zeros[b] :] | value.dtype.type(1 << (self.bits - 1 - b))
            value = before
        return self.alphabet[value].astype(np.uint32) if self.n else value.astype(np.uint32)


class Encoder:
    """Encodes texts with a tokenizers file, each distinct piece of a call at most once.

    A byte-level pattern that starts a new piece at every space before a visible character allows texts to be cut
    there; equal pieces have equal ids wherever they stand. New pieces go through the library joined again by spaces:
    a piece holds no other space than the one before it, so its ids are those from a token with that space to the
    next. Texts' first pieces go through the library alone. Added tokens are found in both; these hold no space.
    Pieces and their ids stay known to the worker's next tasks as two Arrow arrays, some 30 MB; once they are
    more than LIMIT, those that fewer calls used go, half of LIMIT at least.
    """

    LIMIT, JOIN, BATCH = 1 << 20, 64, 16
    #: Spaces before one of these can't be cut at; such texts go through the library whole.
    ODD = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    _loaded: dict[tuple, Encoder] = {}

    def __init__(self, path: str):
        import re

        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.lib, self.odd = Tokenizer.from_file(path), re.compile(self.ODD)
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values(), default=0) + 1
        self.kind, self.opens = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # tokens that begin with a space
        self.names, self.codes, self.uses = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int32)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for a file as it is now; the worker keeps one."""
        import os

        key = (path, os.stat(path).st_mtime_ns, os.stat(path).st_size)
        if key not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[key] = cls(path)
        return cls._loaded[key]

    def _batch(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, dtype=self.kind) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, ids: list, sizes: list):
        """Arrays of ids end to end and of pieces' sizes as an Arrow array of bytes."""
        import numpy as np
        import pyarrow as pa

        offsets = np.zeros(sum(map(len, sizes)) + 1, dtype=np.int64)
        np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]) * self.kind.itemsize, out=offsets[1:])
        data = np.concatenate([np.zeros(0, dtype=self.kind), *ids])
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def _learn(self, pieces: list[str]):
        """What a space and each of these distinct pieces give; an empty piece, which texts begin with, gives nothing."""
        import numpy as np

        some, found = [p for p in pieces if p], []
        groups = [some[i : i + self.JOIN] for i in range(0, len(some), self.JOIN)]
        for i in range(0, len(groups), self.BATCH):
            found += self._batch([f" {' '.join(g)}" for g in groups[i : i + self.BATCH]])
        ids, ends = np.concatenate([np.zeros(0, dtype=self.kind), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        at = np.flatnonzero(self.opens[ids])
        opened = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(groups))
        if opened.tolist() == [len(g) for g in groups] and self.opens[ids[np.append(0, ends[:-1])[: len(groups)]]].all():
            sizes = np.diff(at, append=len(ids))
        else:  # not a byte-level file's ids
            found = self._batch([f" {p}" for p in some])
            ids, sizes = np.concatenate([np.zeros(0, dtype=self.kind), *found]), np.array([len(x) for x in found], dtype=np.int64)
        return self._coded([ids], [np.insert(sizes, pieces.index(""), 0) if len(some) < len(pieces) else sizes])

    def encode(self, texts: list[str]):
        """All texts' ids end to end, and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [not (t[-1:] == " " or "  " in t or " \n" in t or self.odd.search(t)) for t in texts]
        lists = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.string()), " ")
        heads = self._batch([t.split(" ", 1)[0] if p else t for t, p in zip(texts, plain, strict=True)])
        first = lists.offsets.to_numpy()[:-1]
        split = lists.flatten().dictionary_encode()
        pieces = split.dictionary
        # known pieces are looked up among the call's, which are fewer: the hash table is of these
        known = pc.index_in(self.names, value_set=pieces)
        held = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        place = np.full(len(pieces), -1, dtype=np.int32)
        place[known.drop_null().to_numpy()] = held
        fresh = place < 0
        new = pieces.filter(pa.array(fresh))
        place[fresh] = len(self.names) + np.arange(len(new), dtype=np.int32)
        at = place[split.indices.to_numpy()]
        at[first] = len(self.names) + len(new) + np.arange(len(texts), dtype=np.int32)
        # texts' first pieces come after all known ones, and go with the next call's copy
        codes = pa.concat_arrays([self.codes, self._learn(new.to_pylist()), self._coded(heads, [np.array([len(h) for h in heads], dtype=np.int64)])])
        self.names, self.codes = pa.concat_arrays([self.names, new]), codes.slice(0, len(self.names) + len(new))
        out = codes.take(pa.array(at))
        self.uses = np.append(self.uses, np.zeros(len(new), dtype=np.int32))
        self.uses[place] += 1
        if len(self.names) > self.LIMIT:
            keep = self.uses > np.partition(self.uses, -(self.LIMIT // 2))[-(self.LIMIT // 2)]
            some, self.uses = pa.array(keep), self.uses[keep] // 2
            self.names, self.codes = self.names.filter(some), self.codes.filter(some)
        _, offsets, data = out.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=len(out) + 1) // self.kind.itemsize
        ids = np.frombuffer(data, dtype=self.kind, count=int(offsets[-1])) if offsets[-1] else np.zeros(0, dtype=self.kind)
        return ids, np.diff(offsets[np.append(first, len(out))])


#: Texts are encoded in calls of about so many characters.
CALL_CHARS = 3 << 20


def _write(folder: str, path: str, end_id: int, shard_ids: int):
    """Encode sorted documents and write shard files; one row per shard."""

    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, where = Encoder.of(path), fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, shard = context.partitionId(), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list = []

        def flush():
            nonlocal docs, ids, lengths, shard
            matrix = WaveletMatrix.build(np.concatenate(ids))
            file = f"part-{part:06d}-{shard:05d}.wm"
            attempt = f"{where[1]}/{file}.{context.taskAttemptId()}"
            with where[0].open_output_stream(attempt) as f:
                f.write(matrix.to_bytes())
            where[0].move(attempt, f"{where[1]}/{file}")  # a second attempt replaces the file by the same content
            row = pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([matrix.n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))],
                names=["file", "part", "shard", "n", "doc_ids", "lengths"],
            )
            docs, ids, lengths, shard = [], [], [], shard + 1
            return row

        def encoded(some, texts):
            found, counts = encoder.encode(texts)
            give_back()  # of what a call takes, little is left; a worker's peak is then that of one call
            ends = np.cumsum(counts + 1)
            out = np.full(len(found) + len(texts), end_id, dtype="<u4")
            mask = np.ones(len(out), dtype=bool)
            mask[ends - 1] = False
            out[mask] = found
            size, at = sum(lengths), 0
            for doc_id, n, end in zip(some, (counts + 1).tolist(), ends.tolist(), strict=True):
                docs.append(doc_id), lengths.append(n)
                size += n
                if size >= shard_ids:
                    ids.append(out[at:end])
                    yield flush()
                    size, at = 0, end
            if at < len(out):
                ids.append(out[at:])

        some, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some.append(doc_id), texts.append(text or "")
                chars += len(texts[-1])
                if chars >= CALL_CHARS:
                    yield from encoded(some, texts)
                    some, texts, chars = [], [], 0
        if some:
            yield from encoded(some, texts)
        if docs:
            yield flush()

    return run


def open_shard(folder: str, name: str) -> WaveletMatrix:
    from pyarrow import fs

    where, top = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{top}/{name}") as f:
        return WaveletMatrix.from_bytes(f.read())


def _read(folder: str):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, first, docs, lengths in zip(*[batch.column(c).to_pylist() for c in ("file", "first", "doc_ids", "lengths")], strict=True):
                ids = open_shard(folder, file).decode().astype("<u4")
                ends = np.cumsum(lengths)
                rows = [(d, first + int(e) - n, n, zlib.crc32(ids[int(e) - n : int(e)].tobytes())) for d, n, e in zip(docs, lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


@small_batches
def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write wavelet-matrix shards of the documents' ids to a shared folder, in ascending id order.

    Returns the manifest, one row per shard: file, part, shard, n, first (ids in all shards before it), doc_ids, lengths.
    A null text is empty and has the end id alone; a null doc_id comes first. Texts are parted by ranges of
    doc_id; each task sorts its range and closes a file at `shard_ids` ids, so memory depends on neither the input nor
    a range's size. A file is renamed to its name when complete; a repeated attempt writes the same bytes.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text"), "text")
    manifest = materialize(dealt.mapInArrow(trimmed(_write(folder, path, end_id, shard_ids)), "file string, part int, shard int, n bigint, doc_ids array<bigint>, lengths array<bigint>"))
    # one row for each writing task is summed in order, then the shards within each
    parts = manifest.groupBy("part").agg(F.sum("n").alias("_all"))
    parts = parts.select("part", (F.sum("_all").over(W.orderBy("part")) - F.col("_all")).alias("_before"))
    within = F.sum("n").over(W.partitionBy("part").orderBy("shard")) - F.col("n")
    return manifest.withColumn("_within", within).join(parts, "part").withColumn("first", F.col("_before") + F.col("_within")).drop("_before", "_within")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Digests from the files: doc_id, start, n_tokens, ids_crc32. Files are dealt to as many tasks as the session has partitions."""
    return manifest.select("file", "first", "doc_ids", "lengths").repartition(partitions_for(manifest.sparkSession), F.xxhash64("file")).mapInArrow(trimmed(_read(folder)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """write_tokens to a folder below spark.checkpoint.dir, then read_tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, str(path), **options), folder)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to shards and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(table(spark, sf_dir, "documents"))
