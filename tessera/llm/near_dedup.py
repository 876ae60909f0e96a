"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

Two collections of BANDS small keys, each from WIDTH minhashes, are computed per text. A table's key is a pair,
one key from either collection, so 2 * BANDS * WIDTH = 84 minhashes serve BANDS**2 = 196 tables of 6 minhashes
(plain banding would need 1176). Two texts with Jaccard similarity 0.8 share no table with a chance of about 9e-5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import (
    WordHashes,
    ascii_words,
    bit_slots,
    bitmap_of,
    checked_broadcasts,
    in_bitmap,
    materialize,
    partitions_for,
    runs,
    shingle_set,
    small_batches,
    table,
    tidy,
    trimmed,
)

BANDS, WIDTH = 14, 3
#: Signatures of two texts that are similar enough agree in at least so many of the 84 places, but for a chance of
#: about 1e-7 (mean less five and a half standard deviations at similarity 0.8).
AGREE = 47
#: Members are compared in blocks of about so many, or so many times 2048 shingles, so that a block pair's sets fit in
#: memory. Buckets in which those outside the largest component make several blocks are refined by the second key.
BLOCK = 512


def _features(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        rng = np.random.default_rng(11)
        n_hash = 2 * BANDS * WIDTH
        mul = rng.integers(1, 1 << 63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, n_hash, dtype=np.uint64)
        hashes = WordHashes()
        for batch in batches:
            ids, ns, fps, ones, twos, sigs = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(ascii_words(text), k, hashes)
                ids.append(doc_id)
                ns.append(len(s))
                if not len(s):
                    fps.append(None), ones.append(None), twos.append(None), sigs.append(None)
                    continue
                low = np.full(n_hash, np.iinfo(np.uint64).max, dtype=np.uint64)
                step = max(1, (1 << 17) // n_hash)
                for at in range(0, len(s), step):
                    np.minimum(low, ((s[at : at + step, None] ^ add) * mul).min(axis=0), out=low)
                keys = np.zeros((2, BANDS), dtype=np.uint64)
                parts = low.reshape(2, BANDS, WIDTH)
                for j in range(WIDTH):
                    keys = (keys ^ parts[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
                    keys ^= keys >> np.uint64(32)
                keys = keys.view(np.int64)
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                ones.append(keys[0]), twos.append(keys[1])
                sigs.append((low >> np.uint64(40)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(ones, pa.list_(pa.int64())), pa.array(twos, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "fp", "one", "two", "sig"],
            )

    return run


def _verifier(k: int, percent: int):
    """Compares each member with its hub; a hub's rows come before its members' rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes, now, of_hub = WordHashes(), None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hub, salt, member, text in zip(*[batch.column(c).to_pylist() for c in ("hub", "salt", "member", "text")], strict=True):
                s = shingle_set(ascii_words(text), k, hashes)
                if now != (hub, salt):
                    now, of_hub = (hub, salt), []
                if member is None:
                    of_hub.append(s)
                    continue
                for h in of_hub:
                    both = len(np.intersect1d(s, h, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(h) - both):
                        out.append((member, hub))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) whose full shingle sets are similar enough. Texts stream past their hub's; hubs of many are salted."""
    # a hub with few members goes to one task, a hub with many to several, each with a copy of its text
    hubs = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("n_salts")))
    members = pairs.join(hubs, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a", "b"), "n_salts").cast("int").alias("salt"), F.col("a").alias("member"))
    copies = hubs.select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("member"))
    wanted = materialize(members.unionByName(copies))
    rows = wanted.join(texts_of(docs, wanted), "doc_id").select("hub", "salt", "member", "text")
    rows = rows.repartition(partitions_for(docs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(trimmed(_verifier(k, percent)), "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): v, c with c the smallest node that v reaches.

    Edges point from the larger node u to the smaller v. A round gives each u its least v, and that the others
    (small star), then replaces every v by its own least v (large star); it is one job that writes a table. Rounds end
    when one changes nothing; their number grows as the square of the logarithm of the longest path at most. Only
    a node's smaller neighbours meet in a task: a node with many larger ones is the right end of a join.
    """
    edges, before = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        low = edges.withColumn("m", F.min("v").over(W.partitionBy("u")))
        low = materialize(low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(low.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("p")))
        edges = materialize(low.join(least, "v", "left").select("u", F.coalesce("p", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("c"))
        before = now


def _blocks():
    """Of each pair of blocks, the members that may be similar to one with another label, as a task for _exact."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        width = 2 * BANDS * WIDTH
        for t in runs(batches, ["bucket", "p", "q"]):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, width)
            rep, label, block, n = (t.column(c).to_numpy() for c in ("rep", "label", "block", "n_shingles"))
            p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
            first, second = np.flatnonzero(block == p), np.flatnonzero(block == q)
            may = np.zeros(len(rep), dtype=bool)
            for i in first:
                other = second[(label[second] != label[i]) & (5 * np.minimum(n[second], n[i]) >= 4 * np.maximum(n[second], n[i]))]
                if p == q:
                    other = other[other > i]
                if len(other):
                    hit = other[(sig[other] == sig[i]).sum(axis=1) >= AGREE]
                    may[hit] = True
                    may[i] |= len(hit) > 0
            if may.any():
                task = xxhash.xxh3_64_intdigest(np.array([t.column("bucket")[0].as_py(), p, q], dtype=np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(may.sum(), task, dtype=np.uint64).view(np.int64)), pa.array(rep[may]), pa.array(label[may])], names=["task", "rep", "label"])

    return run


def _exact(k: int, percent: int):
    """Links between labels within a task, on full sets: at most one for each two labels that are already joined by none."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for t in runs(batches, ["task"]):
            rep, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
            sets = [shingle_set(ascii_words(x), k, hashes) for x in t.column("text").to_pylist()]
            size = np.array([len(s) for s in sets])
            flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            labels, counts = np.unique(label, return_counts=True)
            most, joined, out = labels[np.argmax(counts)], {x: x for x in labels.tolist()}, []

            def root(x, joined=joined):
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            for i in np.flatnonzero(label != most):
                lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(of[at], minlength=len(sets))
                for j in np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (label != label[i])):
                    x, y = root(int(label[i])), root(int(label[j]))
                    if x != y:
                        joined[x] = y
                        out.append((max(int(rep[i]), int(rep[j])), min(int(rep[i]), int(rep[j]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _multi(rows: DataFrame) -> DataFrame:
    """Members of buckets that still hold several labels: whether theirs is the bucket's most frequent one, and how many
    blocks that label's members (km) and the others (ko) make."""
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, w / (BLOCK << 11)))).cast("int")
    each = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    groups = each.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    groups = groups.select("bucket", F.col("m.label").alias("most"), blocks(F.col("m.n"), F.col("m.w")).alias("km"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("ko"))
    return rows.join(materialize(groups), "bucket").select("bucket", "rep", "label", "n_shingles", (F.col("label") == F.col("most")).alias("main"), "km", "ko")


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that the first round left out: between members of one bucket in different components.

    Members with a bucket's most frequent label are not compared with one another: their blocks meet the blocks of
    all other members only, and these also each other.
    """
    rows = members.join(labels, members.rep == labels.v, "left").select("bucket", "rep", F.coalesce("c", "rep").alias("label"))
    rows = materialize(_multi(materialize(rows.join(sets.select("rep", "n_shingles"), "rep"))))
    # where the others make several blocks, buckets are refined to tables by the second key
    many = rows.where("ko > 1").select("bucket", "rep", "label", "n_shingles").join(sets.select("rep", "two"), "rep")
    many = _multi(many.select("rep", "label", "n_shingles", "bucket", F.posexplode("two").alias("j", "two")).withColumn("bucket", F.xxhash64("bucket", "j", "two")).select("bucket", "rep", "label", "n_shingles"))
    rows = rows.where("ko = 1").unionByName(many)
    # blocks of the most frequent label have numbers from 0 on, those of the others from -1 down
    own = F.when(F.col("main"), F.pmod(F.xxhash64("rep"), "km")).otherwise(-1 - F.pmod(F.xxhash64("rep"), "ko")).cast("int")
    others = F.sequence(-F.col("ko"), F.lit(-1))
    mates = F.when(F.col("main"), others).otherwise(F.concat(others, F.sequence(F.lit(0), F.col("km") - 1)))
    rows = rows.withColumn("block", own).withColumn("mate", F.explode(mates)).join(sets.select("rep", "sig"), "rep")
    rows = rows.select("bucket", "rep", "label", "n_shingles", "sig", "block", F.greatest("block", "mate").alias("p"), F.least("block", "mate").alias("q"))
    parts = partitions_for(rows.sparkSession)
    rows = rows.repartition(parts, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    tasks = materialize(rows.mapInArrow(trimmed(_blocks()), "task bigint, rep bigint, label bigint"))
    texts = texts_of(docs, tasks.select(F.col("rep").alias("doc_id")))
    dealt = tasks.join(texts, tasks.rep == texts.doc_id).select("task", "rep", "label", "text").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(trimmed(_exact(k, percent)), "a bigint, b bigint").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows that may be wanted: a bitmap of 2 MB at most thins them before any shuffle."""
    slot = bit_slots(F.xxhash64("doc_id"), 24)
    bits = bitmap_of(ids.select(slot.alias("_slot")), "_slot")
    texts = docs.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    return texts.join(F.broadcast(bits), "_bucket").where(in_bitmap("_slot")).select("doc_id", "text")


@small_batches
@checked_broadcasts
@tidy
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept; one row per input row.

    A text's set holds its distinct `words`-word shingles (A-Z lower-cased, words between ASCII white space);
    fewer words make one shingle, none an empty set, which links with nothing. Texts link when
    100 * intersection >= percent * union, confirmed on full sets.

    1. Texts with equal sets collapse to the smallest id. 2. First keys with one text drop out; the rest pair
    with second keys to table keys. Each table's texts become candidates with the smallest id in it, and verified
    ones link. 3. In buckets that still hold different components, a sieve (sizes and signatures, in blocks) finds the
    texts that may be similar to one of another component; full sets of a block pair's texts then meet in one
    task: what is similar to a table's other members but not to its smallest one is found there. So no link is lost in a hot group, and a group that linked costs no pairs.

    Ids are whole numbers (cast to bigint; others become null). Rows with a null id are kept and linked with nothing.
    Repeated rows are copies of one another. Rows that share an id but not a text are in their own texts' groups;
    two sets whose smallest id is the same count as linked. The sieves are made for 80, so a smaller percent, at
    which they would lose links, is refused.
    """
    if percent < 80:
        raise ValueError(f"near_dedup finds pairs of a similarity of 80 % and more, not {percent}")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    feats = materialize(docs.mapInArrow(trimmed(_features(words)), "doc_id bigint, n_shingles bigint, fp binary, one array<bigint>, two array<bigint>, sig binary"), "lz4")
    usable = feats.where("fp is not null and doc_id is not null")
    # one row per set; copies of a set are pre-aggregated by each task
    sets = usable.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "one", "two", "sig")).alias("s"))
    sets = materialize(sets.select("fp", F.col("s.doc_id").alias("rep"), "s.n_shingles", "s.one", "s.two", "s.sig"), "lz4")

    ones = sets.select("rep", F.posexplode("one").alias("i", "key")).select("rep", F.xxhash64("i", "key").alias("bucket"))
    shared = materialize(ones.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    members = materialize(ones.join(shared, "bucket", "left_semi"))
    tables = members.join(sets.select("rep", "two"), "rep").select("rep", "bucket", F.posexplode("two").alias("j", "key")).select("rep", F.xxhash64("bucket", "j", "key").alias("bucket"))
    hubs = materialize(tables.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("bucket", "hub"))
    pairs = tables.join(hubs, "bucket").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(verified(materialize(pairs), docs, words, percent))
    labels = components(links)

    found = materialize(_rest(members, labels, sets, docs, words, percent))
    if not found.isEmpty():
        labels = components(labels.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(found))

    ends = materialize(sets.select("fp", "rep").join(labels, F.col("rep") == F.col("v"), "left").select("fp", F.coalesce("c", "rep").alias("component_id")))
    rows = usable.select("doc_id", "n_shingles", "fp").join(ends, "fp").select("doc_id", "n_shingles", "component_id")
    rest = feats.where("fp is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents by 2-word shingles at 80 %: doc_id, n_shingles, component_id, kept."""
    return near_dedup(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, counted; then the smallest document that a chain of links reaches.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * b.n >= 80 * (p.n + q.n - b.n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
