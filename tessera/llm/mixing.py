"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, checked_broadcasts, fresh, materialize, table, text_of, tidy

#: Rows of a source are joined with its totals in so many parts.
SALTS = 64
#: Once so few rows in all may still be taken, each source's walk ends in one task.
FOLD = 1 << 17


def appeal(size: Column) -> Column:
    """What inclusion probabilities are proportional to: the root of a document's words, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(size.cast("double")))).cast("bigint")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Water-filling over one row per source: adds target.

    Sources in code-point order, null last, take the weights in turn and share `share` times the whole.
    A target stops at `most` times its source's size; the excess is shared again by weight. Sorted by
    size over weight, the sources that stop come first, so one running sum finds the final level.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    t = totals.withColumn("_w", turn).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("_fill", F.col("_cap") / F.col("_w"))
    by_fill = W.orderBy("_fill", F.col("source").isNull(), "source")
    whole = W.partitionBy()
    t = t.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing)),
        "_all": F.sum("source_size").over(whole) * F.lit(float(share)),
    })
    t = t.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    t = t.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level"))).over(whole)["_level"])
    return t.withColumn("target", F.coalesce(F.least("_cap", F.col("_final") * F.col("_w")), F.col("_cap")))


def inclusion(totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds to a row per source: _c and _sure, so that documents of appeal w are included with min(1, _c * w).

    These probabilities times the sizes sum up to _left. Appeals over _sure are certain. Sorted by falling appeal,
    certain ones come first, and one running sum over the appeals of a source (root of the longest text at most)
    finds where they end. _room: the words left once certain documents are taken.
    """
    w = sizes.groupBy("source", appeal(F.col("size")).alias("_w")).agg(F.sum("size").alias("_words"))
    w = w.join(totals.select(F.col("source").alias("_s"), "_left"), F.col("source").eqNullSafe(F.col("_s")))
    falling = W.partitionBy("source").orderBy(F.desc("_w"))
    w = w.withColumns({
        "_taken": F.coalesce(F.sum("_words").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum(F.col("_w") * F.col("_words")).over(falling.rowsBetween(0, W.unboundedFollowing)),
    })
    w = w.withColumn("_c", (F.col("_left") - F.col("_taken")) / F.col("_rest")).where("_rest > 0 and _c * _w <= 1")
    ends = w.groupBy("source").agg(F.max(F.struct("_w", "_c", "_taken")).alias("_e"))
    ends = ends.select(F.col("source").alias("_s"), F.col("_e._c").alias("_c"), F.col("_e._w").alias("_sure"), F.col("_e._taken").alias("_certain"))
    t = totals.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return t.withColumn("_room", F.greatest(F.floor(F.col("_left") - F.coalesce("_certain", F.lit(0))), F.lit(0)).cast("bigint")).drop("_certain")


def _rated(docs: DataFrame, id_col: str, source_col: str, size: Column | None, weights: Sequence[float], share: float, most: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's totals, rank and bucket; and one row per source.

    Ranks are cut into about sqrt(n) buckets per source, each summed alone, so neither a source with a
    third of all rows nor the running sums meet in one task; the source's totals are joined by salted keys.
    """
    size = F.regexp_count(text_of("text"), F.lit(WORDS)).cast("bigint") if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = materialize(rows)  # ids, sources and sizes: texts are read once
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"), F.max("size").alias("_largest"))
    t = source_targets(totals, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.select("source", "source_size", "target", "_largest", F.floor(rate).alias("_whole"), (rate - F.floor(rate)).alias("_p"), F.ceil(F.sqrt("_rows")).alias("_buckets"))
    t = materialize(t.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")))
    t = inclusion(t, rows)
    t = materialize(t.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull()).drop("source"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 48))
    rows = rows.withColumns({"_u": u, "_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull(), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}).drop("source")
    rows = rows.join(_salted(t.drop("_largest", "_room")), ["_source", "_none", "_salt"])
    w = appeal(F.col("size"))
    rows = rows.withColumns({"_certain": F.coalesce((F.col("_p") > 0) & (w > F.col("_sure")), F.lit(False)), "_pi": F.least(F.lit(1.0), F.coalesce("_c", F.lit(0.0)) * w)})
    rows = rows.withColumn("_q", (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_pi")) / F.greatest("_pi", F.lit(1e-300))))
    # against the odds of the source's mean rate, ranks spread over all buckets, and evenly if odds are equal
    level = F.col("_q") * (F.col("_p") / (1 - F.col("_p")))
    bucket = F.least(F.floor(level / (1 + level) * F.col("_buckets")), F.col("_buckets") - 1)
    return rows.withColumn("_bucket", F.when(F.col("_certain"), F.lit(0)).otherwise(bucket).cast("bigint")), t


def _salted(sources: DataFrame) -> DataFrame:
    return sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _copies(rows: DataFrame, take: Column) -> DataFrame:
    copies = F.col("_whole") + take.cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


@checked_broadcasts
@tidy
def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How many copies of each document a mix takes: doc_id, size, source_size, target, copies, taken.

    Each source's rate is its target over its size. The rate's whole part gives every document that many
    certain copies. One more copy goes to a Pareto order sample of fixed size, counted in words. A document is
    included with a probability pi proportional to its `appeal`, the root of its words, at most 1, set so that the
    expected words are those that are left; long texts are repeated rather than fragments. With a uniform u from the
    document's id, documents are ranked by (u/(1-u)) / (pi/(1-pi)); certain ones are taken, and then from the lowest
    rank to the highest each that fits the words that are left. So of the documents not taken none fits what is
    left at the end.

    Null text: size 0, target of its source, 0 words. A null source is a source of its own. Rows that
    repeat a doc_id have equal u. The result depends on ids and sizes alone, so reruns agree. Sizes are
    whole numbers. Targets are found in one task over a row per source.
    """
    rows, sources = _rated(docs, id_col, source_col, size, weights, share, most, seed)
    in_cell = W.partitionBy("_source", "_none", "_bucket").orderBy("_q", "doc_id", "size")
    kept = rows.select("doc_id", "size", "source_size", "target", "_source", "_none", "_whole", "_salt", "_certain", "_bucket", "_q")
    sure = kept.where("_certain").withColumn("_at", F.lit(-1).cast("bigint"))
    rest = kept.where("not _certain").withColumn("_at", F.shiftleft(F.col("_bucket"), 32) + F.row_number().over(in_cell))
    rows = materialize(sure.unionByName(rest).drop("_q"))
    state = sources.where("_p > 0").select("_source", "_none", "_room", F.lit(0).cast("bigint").alias("_from"), F.lit(True).alias("_open"), F.col("_largest").cast("bigint").alias("_largest"), F.expr("cast(array() as array<struct<after: bigint, last: bigint, below: bigint>>)").alias("_legs"))
    state = materialize(state)
    while (left := _may_fit(rows, state).count()) > FOLD:
        state = materialize(_leg(rows, state))
    if left:
        state = materialize(_walked(rows, state))
    rows = rows.join(_salted(state.select("_source", "_none", "_legs")), ["_source", "_none", "_salt"], "left")
    at = F.col("_at")
    took = F.exists("_legs", lambda x: (at > x["after"]) & (((at < x["last"]) & (F.col("size") < x["below"])) | (at == x["last"])))
    empty = (F.col("size") == 0) & F.col("_legs").isNotNull()  # always fits
    return _copies(rows, F.col("_certain") | empty | F.coalesce(took, F.lit(False)))


def _bit(c: Column) -> Column:
    """The largest power of two that isn't larger, 1 for 0."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.greatest(c, F.lit(1).cast("bigint")))) - 1)


def _may_fit(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that an open source has not passed yet and that fit its room."""
    now = _salted(state.where("_open").select("_source", "_none", "_room", "_from"))
    r = rows.where("not _certain and size > 0").select("_source", "_none", "_salt", "_at", F.col("size").cast("bigint").alias("size"))
    return r.join(now, ["_source", "_none", "_salt"]).where("_at > _from AND size <= _room")


def _walked(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Walk each open source's rows that may fit, FOLD in all at most, one by one; the legs are those that _leg would find."""
    each = _may_fit(rows, state).groupBy("_source", "_none").agg(F.array_sort(F.collect_list(F.struct("_at", "size"))).alias("_rows"))
    top = F.lit((1 << 63) - 1)
    legs = "array<struct<after: bigint, last: bigint, below: bigint>>"
    most = 2 * _bit(F.col("_largest"))
    start = F.struct(F.col("_room").alias("room"), F.col("_from").alias("after"), F.least(_bit(F.col("_room")), most).alias("below"), F.col("_legs").cast(legs).alias("legs"))

    def step(acc: Column, x: Column) -> Column:
        fits, left = x["size"] <= acc["room"], acc["room"] - x["size"]
        ends = fits & ((x["size"] >= acc["below"]) | (left < acc["below"]))
        leg = F.struct(acc["after"].alias("after"), x["_at"].alias("last"), acc["below"].alias("below"))
        return F.struct(
            F.when(fits, left).otherwise(acc["room"]).alias("room"), F.when(ends, x["_at"]).otherwise(acc["after"]).alias("after"),
            F.when(ends, F.least(_bit(left), most)).otherwise(acc["below"]).alias("below"), F.when(ends, F.array_append(acc["legs"], leg)).otherwise(acc["legs"]).cast(legs).alias("legs"),
        )

    s = state.join(each, ["_source", "_none"], "left").withColumn("_end", F.aggregate(F.coalesce("_rows", F.array().cast("array<struct<_at: bigint, size: bigint>>")), start, step))
    last = F.struct(F.col("_end.after").alias("after"), top.alias("last"), F.col("_end.below").alias("below"))
    return s.select("_source", "_none", F.when(F.col("_open"), F.array_append("_end.legs", last)).otherwise(F.col("_legs")).cast(legs).alias("_legs"))


def _leg(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Go on in each open source until its room falls below a power of two that it held.

    Until then all smaller documents fit, so running sums of these alone tell the room before each document.
    The leg's last document is the first smaller one that brings the room below, or the first other one that
    fits. So a source has at most one leg for each bit of its largest size, and two more. A source without a
    last document is at its end.
    """
    state = state.withColumn("_below", F.least(_bit(F.col("_room")), 2 * _bit(F.col("_largest"))))
    now = _salted(state.where("_open").select("_source", "_none", "_room", "_from", "_below"))
    r = rows.where("not _certain").select("_source", "_none", "_salt", "_bucket", "_at", F.col("size").cast("bigint").alias("size")).join(now, ["_source", "_none", "_salt"])
    r = r.where("_at > _from AND size <= _room").withColumn("_small", F.when(F.col("size") < F.col("_below"), F.col("size")).otherwise(0))
    sums = r.groupBy("_source", "_none", "_bucket").agg(F.sum("_small").alias("_words"))
    before = W.partitionBy("_source", "_none").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_source", "_none", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    r = r.join(sums, ["_source", "_none", "_bucket"])
    run = F.coalesce(F.sum("_small").over(W.partitionBy("_source", "_none", "_bucket").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("_after", F.col("_room") - F.col("_before") - run - F.col("size"))
    last = r.where("size > 0 AND _after >= 0 AND (size >= _below OR _after < _below)").groupBy("_source", "_none").agg(F.min(F.struct("_at", "_after")).alias("_last"))
    s = state.join(last, ["_source", "_none"], "left")
    leg = F.struct(F.col("_from").alias("after"), F.coalesce(F.col("_last._at"), F.lit((1 << 63) - 1)).alias("last"), F.col("_below").alias("below"))
    return s.select(
        "_source", "_none", F.coalesce("_last._after", "_room").alias("_room"), F.coalesce("_last._at", "_from").alias("_from"),
        F.col("_last").isNotNull().alias("_open"), "_largest", F.when(F.col("_open"), F.array_append("_legs", leg)).otherwise(F.col("_legs")).alias("_legs"),
    )


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of a mix, with all their columns; a document with two copies is there twice.

    Where rows repeat a doc_id, each gets the largest number of copies among them.
    """
    key, n, copy = (fresh(docs, x) for x in ("_mixed_id", "_mixed_copies", "_mixed_copy"))
    copies = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(n))
    # compressed files of ids say nothing of their size, so they are merged, not broadcast by it
    out = docs.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 5, 2, 1 to 150 % of their words: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The walk by rank is one fold over a source's sizes: the room before each document, and after the last.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM g),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / wt AS fill FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(wt) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
z AS (SELECT level AS final FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT final FROM z) * wt), cap) AS target FROM l),
v AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size AS remain FROM t),
b AS (SELECT doc_id, size, d.source, source_size, target, floor(rate) AS whole, rate - floor(rate) AS p, remain, greatest(1, CAST(floor(sqrt(size)) AS BIGINT)) AS a,
        (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
e AS (SELECT source, a, any_value(remain) AS remain, CAST(sum(size) AS BIGINT) AS words FROM b GROUP BY source, a),
h AS (SELECT source, a, before, (remain - before) / rest AS c FROM (SELECT *,
        coalesce(sum(words) OVER (PARTITION BY source ORDER BY a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(a * words) OVER (PARTITION BY source ORDER BY a DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM e) WHERE rest > 0 AND (remain - before) / rest * a <= 1),
i AS (SELECT source, max(a) AS sure, arg_max(c, a) AS c, arg_max(before, a) AS before FROM h GROUP BY source),
q AS (SELECT b.*, i.sure, i.before, least(1.0::DOUBLE, coalesce(i.c, 0) * a) AS pi FROM b LEFT JOIN i ON b.source IS NOT DISTINCT FROM i.source),
k AS (SELECT *, p > 0 AND coalesce(a > sure, FALSE) AS certain, (u / (1 - u)) * ((1 - pi) / greatest(pi, 1e-300)) AS rank FROM q),
o AS (SELECT source, list(doc_id ORDER BY rank, doc_id, size) AS ids, list(size ORDER BY rank, doc_id, size) AS sizes,
        CAST(greatest(floor(any_value(remain) - coalesce(any_value(before), 0)), 0) AS BIGINT) AS room FROM k WHERE p > 0 AND NOT certain GROUP BY source),
r AS (SELECT source, ids, sizes, list_reduce(sizes, lambda rooms, x: list_append(rooms, CASE WHEN x <= rooms[-1] THEN rooms[-1] - x ELSE rooms[-1] END), [room]) AS rooms FROM o),
n AS (SELECT source, unnest(ids) AS doc_id, unnest(list_transform(sizes, lambda x, j: x <= rooms[j])) AS fits FROM r)
SELECT k.doc_id, size, source_size, target, CAST((whole + CASE WHEN certain OR coalesce(fits, FALSE) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k LEFT JOIN n ON k.doc_id = n.doc_id AND k.source IS NOT DISTINCT FROM n.source AND NOT k.certain
"""
