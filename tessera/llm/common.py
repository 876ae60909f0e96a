"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in the digests: tab to carriage return, and space.
SPACES = " \t\n\x0b\x0c\r"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


#: Folders that the running operators have made, innermost last.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; it goes when the operator that made it is done, or else the driver's JVM.

    A local session (tests) that names no such folder gets one on this machine; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/tessera-shared"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{top}/tessera-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    uri = fs.makeQualified(path).toString()
    uri = uri if "://" in uri else uri.replace(":/", ":///", 1)
    if _made:
        _made[-1].append(uri)
    return uri


def discard(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(f):
    """Write what f returns, unless it is a written table already, and delete the other tables that f wrote."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        _made.append([])
        try:
            out = f(*args, **kwargs)
            if isinstance(out, DataFrame) and not hasattr(out, "_written"):
                out = materialize(out)
        finally:
            folders = _made.pop()
        keep = getattr(out, "_written", None) if isinstance(out, DataFrame) else None
        for folder in folders:
            if folder != keep:
                discard(SparkSession.getActiveSession(), folder)
            elif _made:
                _made[-1].append(folder)
        return out

    return wrapped


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads files instead of running Python again,
    and several readers see one and the same content.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.option("compression", codec).parquet(f"{folder}/t")
    out = spark.read.schema(df.schema).parquet(f"{folder}/t")
    out._written = folder
    return out


def small_batches(f):
    """Run f with Arrow batches of few rows, as texts can be long; the caller's setting returns afterwards.

    f must materialize whatever runs Python, or its caller must.
    """
    return _with_settings(f, {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"})


def give_back() -> None:
    """Hand memory that Arrow and the C library keep for later use back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def trimmed(run):
    """A function on batches whose worker holds no more memory after a task than what is in use.

    Workers stay for the tasks of later stages; what a task had at its peak would stay with each of them.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def checked_broadcasts(f):
    """Run f with joins that broadcast a side only once its rows are there and take under 8 MB.

    Written tables are compressed, so the size of their files says little; the size of shuffled rows is measured.
    f must materialize what it returns.
    """
    return _with_settings(f, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8m"})


def _with_settings(f, settings: dict[str, str]):
    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        spark = SparkSession.getActiveSession()
        old = {key: spark.conf.get(key, None) for key in settings}
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            return f(*args, **kwargs)
        finally:
            for key, value in old.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return wrapped


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions for data that must be dealt out by hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bit_slots(column: Column, bits: int) -> Column:
    """A position from 1 to 2**bits for a hash."""
    return F.pmod(column, F.lit(1 << bits)) + 1


def bitmap_of(slots: DataFrame, slot: str) -> DataFrame:
    """Pack the positions in a column into rows of 4 KB; there are at most 2**bits / 32768 rows."""
    return slots.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bitmap"))


def in_bitmap(slot: str) -> Column:
    """Whether the position is set in the row's _bitmap (null: it isn't)."""
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position({0}) div 8 as int) + 1, 1)".format(slot))), 16, 10).cast("int")
    bit = F.expr("cast(bitmap_bit_position({0}) % 8 as int)".format(slot))
    return F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)) & at.isNotNull()


def runs(batches, key_cols: list[str]):
    """Cut sorted Arrow batches into runs of equal keys, holding one run at a time; yields tables."""
    import numpy as np
    import pyarrow as pa

    def keys_differ(t):
        change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for k in key_cols:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held and any(held[-1].column(k)[-1] != t.column(k)[0] for k in key_cols):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        cuts = [0, *keys_differ(t).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and held:
                yield pa.concat_tables(held).combine_chunks() if len(held) > 1 else held[0]
                held = []
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before by one task; emptied beyond 2**18 of them, some 40 MB."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(words: list[bytes], k: int, hashes: WordHashes):
    """Sorted distinct 64-bit hashes of a text's k-word shingles; fewer words than k count as one shingle."""
    import numpy as np

    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(w) < k:
        s = np.full(1, len(w), dtype=np.uint64)
        for x in w:
            s = _mix(s, x)
        return s
    n = len(w) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        s = _mix(s, w[j : j + n])
    return np.unique(s)


def _mix(s, w):
    import numpy as np

    s = (s ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return s ^ (s >> np.uint64(29))


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
