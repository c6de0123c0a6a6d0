"""Mixing sources to target weights with hash-threshold histograms.

A document's place in its source is a hash of its id. For each source a histogram of words
over hash buckets shows which bucket the word budget ends in; only that bucket is split
again, until it holds one hash value. The result is one threshold per source, and a filter
on it takes the documents: nothing is sorted and no documents are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, global_rank, stored, table

#: Bits of a document's hash, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Parts to which the documents of a source are dealt where the sources are too many to broadcast.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: Column) -> Column:
    """A hash of 60 bits of the id; null counts as an empty id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _joined(rows: DataFrame, sources: DataFrame, many: int) -> DataFrame:
    """rows with the columns of their source in `sources`, a row per key, of which there are `many`.

    A key is of fixed width, so a broadcast is bounded by its rows. Beyond that a source's rows are
    dealt to SALTS parts, each with a copy of its row, as one source may hold a third of all."""
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sources), "key")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    each = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, ["key", "_salt"]).drop("_salt")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Add `target` (double) to a table (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all
    sizes by weight. A target stops at max_repeat times its source's size, and what is over
    is shared by weight among the others, until no target is above. A pass over the sources
    fixes those that are above; only sums come to the driver."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    t = stored(global_rank(sizes, F.col("source").asc_nulls_last()).withColumn("w", w).withColumn("most", F.col("source_size") * max_repeat), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    rest, weight, fixed = total, t.agg(F.sum("w")).first()[0] or 0, -1
    while True:
        above = F.lit(rest).cast("decimal(38,0)") * F.col("w") > F.col("most").cast("decimal(30,0)") * F.lit(weight).cast("decimal(20,0)")
        n, capped, capped_w = t.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(above, F.col("w")))).first()
        if n == fixed or not weight:
            break
        all_w = t.agg(F.sum("w")).first()[0]
        rest, weight, fixed = total - (capped or 0), all_w - (capped_w or 0), n
        if not weight:
            break
    share = F.lit(rest).cast("long") * F.col("w") / F.lit(float(max(weight, 1)))
    return t.select("source", "source_size", F.when(above, F.col("most").cast("double")).otherwise(share).alias("target"))


def thresholds(base: DataFrame, targets: DataFrame, many: int) -> DataFrame:
    """Of each source, by key: `times`, how often all its documents are taken, and `thr`: those
    with a place up to it once more. base: key, size, place; targets: key, source_size, target."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select("key", times.alias("times"), (F.col("target") - times * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("thr"))
    state = stored(state.withColumn("thr", F.when(F.col("need") <= 0, F.lit(-1).cast("long"))), "mix-state")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        open_ = state.where("thr is null").select("key", "prefix", "below", "need")
        inside = _joined(base, open_, many).where(F.shiftright("place", shift + LEVEL_BITS) == F.col("prefix"))
        histogram = inside.groupBy("key", "below", "need", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        over = W.partitionBy("key").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.col("below") + F.sum("words").over(over)).withColumn("from", F.col("upto") - F.col("words"))
        edge = histogram.where((F.col("upto") > F.col("need")) & (F.col("from") <= F.col("need")))
        one = (F.col("lo") == F.col("hi")) | F.lit(level == HASH_BITS // LEVEL_BITS)
        closer = F.col("upto") - F.col("need") < F.col("need") - F.col("from")
        edge = edge.select("key", F.col("bucket").alias("_bucket"), F.col("from").alias("_from"), F.when(one, F.when(closer, F.col("hi")).otherwise(F.shiftleft("bucket", shift) - 1)).alias("_thr"))
        # a source whose words all fit has no edge: it ends with every place taken
        state = stored(
            state.join(edge, "key", "left").select("key", "times", "need", F.coalesce("_bucket", "prefix").alias("prefix"), F.coalesce("_from", "below").alias("below"), F.coalesce("thr", "_thr", F.when(F.col("_bucket").isNull(), F.lit((1 << HASH_BITS) - 1))).alias("thr")),
            "mix-state",
        )
        if not state.where("thr is null").limit(1).count():
            break
    return state.select("key", "times", "thr")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    taken is how many words the mix takes of a document: its size, times how often its source
    is taken whole, once more where its place is within its source's threshold. A source's
    taken words differ from its target by less than the size of the documents at the
    threshold. Null texts are of size 0 and null sources one source; rows with equal ids share
    a place and are taken alike. An empty table gives an empty result; other columns don't matter."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    key = F.coalesce(F.sha2("source", 256), F.lit("null"))
    base = stored(base.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_repeat).withColumn("key", key), "mix-targets")
    many = targets.count()
    plan = targets.join(thresholds(base, targets, many), "key").select("key", "source_size", "target", "times", "thr")
    taken = F.col("size") * (F.col("times") + (F.col("place") <= F.col("thr")).cast("long"))
    return _joined(base, plan, many).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same mix over a table d(doc_id, text, source): sources by ratio of cap to weight, and running sums by place.
MIX_SQL = r"""
with b as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as bigint) as place
  from {docs}),
s as (select source, sum(size)::bigint as source_size from b group by source),
w as (select source, source_size, 1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 as w from s),
f as (
  select *, sum(source_size) over ()::bigint as total, sum(w) over ()::bigint as all_w,
    coalesce(sum(3 * source_size) over (order by 3.0 * source_size / w, w, source rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
    coalesce(sum(w) over (order by 3.0 * source_size / w, w, source rows between unbounded preceding and 1 preceding), 0)::bigint as capped_w
  from w),
c as (select *, (total - capped)::hugeint * w > (3 * source_size)::hugeint * (all_w - capped_w) as above from f),
k as (select total - coalesce(sum(3 * source_size) filter (above), 0)::bigint as rest, all_w - coalesce(sum(w) filter (above), 0)::bigint as weight from c group by total, all_w),
t as (select source, source_size, case when above then (3 * source_size)::double else (rest * w)::double / weight::double end as target from c, k),
u as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from t),
n as (select *, target - times * source_size as need from u),
p as (
  select b.*, source_size, target, times, need,
    sum(size) over (partition by b.source order by place)::double as upto,
    sum(size) over (partition by b.source, place)::double as own
  from b join n on b.source is not distinct from n.source)
select doc_id, size, source_size, target,
  (size * (times + case when need > 0 and (upto <= need or upto - own <= need and upto - need < need - (upto - own)) then 1 else 0 end))::bigint as taken
from p
"""
OP3_SQL = MIX_SQL.format(docs="documents")
