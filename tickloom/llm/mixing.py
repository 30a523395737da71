"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per source. Sources in order of their code points (null last) weigh ``WEIGHTS``,
repeating, and share the words of the whole corpus by weight; a target stops at ``MOST`` times its
source's words, and what is above is shared again by weight until no target is above. That is a level:
every target is the lesser of its limit and level x weight. Sorted by limit / weight, the sources at
their limit come first, so running sums of limits and weights give the level.

A source's rate is target / words. Each document is taken floor(rate) times, and once more if a
hash of the seed, its id and its text, as a number from 0 to 1, is below the rest: independent of
partitions, so reruns agree.

Sources may be many: they are ranked and summed within ranges of about ``RANGE`` sources, each carried
on from the ranges before (a row each). Rates go to the documents by broadcast when their sources' names
are few and short (counted first), else only those of sources that hold over 1 / ``HOT`` of all documents,
of which there are fewer than HOT, and the rest by a join; a hot source is never brought together.

Defined results: a null text has no words; documents without words are taken as often as their
source's rate says; a source without words has target 0 and its documents are never taken; a
corpus without words takes none; rows with equal ids and texts fare alike; null ids are told apart
by their texts; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, saved, table

#: Weights of the sources in order, repeating; the most times that a source's words are taken; what the draws depend on.
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
#: Sources ranked together, most sources and bytes of their names that are broadcast, hot sources (at most).
RANGE, MOST_BROADCAST, MOST_BYTES, HOT = 100_000, 100_000, 8 << 20, 1000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], n: int) -> DataFrame:
    """The n rows with running sums (new name: column), the row's own value left out, in an order over all rows.

    Rows are dealt to ranges of the order, summed within each, and each range is carried on from those before it."""
    ranges = max(1, -(-n // RANGE))
    dealt = saved(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "dealt-ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = dealt.groupBy("_range").agg(*[F.sum(c).alias(out) for out, c in sums.items()]).select("_range", *[F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"_{out}") for out in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(out) for out, c in sums.items()])
    done = saved(d.join(F.broadcast(carried), "_range").select(*rows.columns, *[(F.col(out) + F.col(f"_{out}")).alias(out) for out in sums]), "running")
    forget(dealt)
    return done


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, docs, source_size, target) of each source of docs (source, text)."""
    sizes = saved(docs.select(F.col("source").cast("string").alias("source"), n_words().alias("size")).groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "source-sizes")
    n = sizes.count()
    ranked = running(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"rank": "one"}, n)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limits = ranked.select("source", "docs", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    limits = saved(limits.withColumn("level", F.col("limit") / F.col("weight")), "source-limits")
    total = limits.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    steps = running(limits, [F.col("level"), F.col("source").isNull(), F.col("source")], {"limits_before": "limit", "weights_before": "weight"}, n).crossJoin(F.broadcast(total))  # one row
    share = (F.col("words") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before"))
    # the first source below its limit, which has the greatest share, sets the level; without one, every source is at its limit
    level = steps.where(share < F.col("level")).agg(F.max(share).alias("shared"))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("shared") * F.col("weight"), F.col("limit").cast("double")))
    done = saved(limits.crossJoin(F.broadcast(level)).select("source", "docs", "source_size", target.alias("target")), "source-targets")  # one row
    forget(sizes, ranked, limits)
    return done


def draw(seed: str) -> Column:
    """A number from 0 to 1 of the seed and the row's id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("row.doc_id").cast("string"), F.col("row.text").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, ...) with their source's targets."""
    size = targets.agg(F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("bytes"), F.sum("docs").alias("docs")).first()
    right = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if size["n"] <= MOST_BROADCAST and (size["bytes"] or 0) <= MOST_BYTES:
        return rows.join(F.broadcast(right), same).drop("_source")
    is_hot = F.col("docs") > size["docs"] / HOT
    hot = F.broadcast(right.where(is_hot))
    return rows.join(hot, same).drop("_source").unionByName(rows.join(hot, same, "left_anti").join(right.where(~is_hot), same).drop("_source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): every row of docs (doc_id, text, source and any others) as a struct, with how often it is taken."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = with_targets(docs.select(F.col("source").cast("string").alias("source"), every, n_words().alias("size")), plan(docs, weights, most))
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    copies = F.floor("rate") + F.when(draw(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.withColumn("rate", rate).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with docs as (
  select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), sizes as (
  select source, sum(size)::bigint as source_size from docs group by source
), ranked as (
  select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint as weight from sizes
), limits as (
  select *, 3 * source_size as most, 3 * source_size / weight as level from ranked
), steps as (
  select *, (sum(source_size) over () - coalesce(sum(most) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as share from limits
  window before as (order by level, source is null, encode(source) rows between unbounded preceding and 1 preceding)
), shared as (
  select max(share) as share from steps where share < level
), targets as (
  select source, source_size, least(most::double, coalesce(share * weight, most::double)) as target from limits, shared
), rates as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size = 0 then 0.0 else least(t.target / t.source_size::double, 3.0) end as rate,
    ('0x' || substr(md5(concat_ws(':', 'mix-1', d.doc_id::varchar, d.text)), 1, 13))::bigint::double / 4503599627370496.0 as draw
  from docs d join targets t on d.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from rates
"""
