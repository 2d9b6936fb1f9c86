"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources take the weights in turn, by code point, null last, and share a budget in proportion; no source
takes more than MOST_EPOCHS times its size, and what it would take beyond that goes to the others by weight.
A source's target is met by complete epochs of all its documents and then by a weighted sample without
replacement: documents are ordered by exponential keys, -ln(u) / quality weight (Efraimidis and Spirakis 2006),
and taken while the sum of their sizes stays within what is left; the document on the border is taken if that
comes nearer to the target.  u is a hash of the document, so reruns agree.

No source is sorted in one task.  What the sample takes is a prefix in the order of (key, doc_id, row), so all that a
document needs is its source's cut.  It is found by narrowing an interval of keys: sums by source and bucket of the
interval tell in which bucket the target falls, which is cut into buckets again until it has few rows; only those
are sorted.  Documents are then decided row by row, without a shuffle of texts.

Defined cases: null text has size 0; null source is a source of its own, last in order; sources of size 0 have
target 0; a null doc_id comes first among equal keys; rows that are equal in doc_id, text and source have one key and
are taken or left singly, whichever of them; very long texts count whole; other columns, whatever their names and types, pass
the stage unchanged and are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import join_small, kept_columns, materialize

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
MOST_EPOCHS = 2.0
#: Documents of a source that are sorted in one task at most, but for equal ones, which needn't be sorted.
BUCKET_ROWS = 2_000
#: Buckets into which an interval of keys is cut.
BUCKETS = 1024
SEED = "mix-1"
#: Characters that speak against a text when its quality weight is taken (fixed values).
SYMBOLS = "#*$%&|<>!"
LEAST_WEIGHT = 0.1


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain text, down to LEAST_WEIGHT as symbols grow to a tenth of the characters."""
    chars = F.coalesce(F.length(text), F.lit(0))
    symbols = chars - F.coalesce(F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(10.0) * symbols / F.greatest(chars, F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), by a hash of the document."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return (F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source_key, source, source_size, target) from (source_key, source, source_size), one row for each source.

    Sources fill up in the order of cap / weight, so those that reach their cap are the first ones: source k does if its
    cap / weight is at most the level that the budget left by the ones before gives to all from k on.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) == i, F.lit(x)).otherwise(w)
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most_epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    all_rows, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(all_rows) * F.lit(budget_share)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return s.withColumn("final", level).select("source_key", "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("final")), F.col("cap")).alias("target"))


def _keyed(doc_id: Column, text: Column, source: Column, weight: Column | None, seed: str) -> dict[str, Column]:
    """The columns by which a document is decided."""
    key = -F.log(uniform(doc_id, text, seed)) / (weight if weight is not None else quality_weight(text))
    least = F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
    return {"__gl_source": F.coalesce(F.concat(F.lit("="), source), F.lit("-")), "__gl_place": F.struct(key.alias("key"), least.alias("id"), F.xxhash64(text).alias("row"))}


def _spread(key: Column) -> Column:
    """A growing function from keys to (0, 1), under which most sources' keys are dealt about evenly."""
    return key / (F.lit(1.0) + key)


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state (__gl_source, rest, before, low, high, n) with each interval of keys narrowed to the bucket in which `rest` falls, if there is one."""
    held = join_small(rows.select("__gl_source", "size", F.col("__gl_place.key").alias("key")), state, "__gl_source", "inner").filter("key >= low and key <= high")
    part = F.try_divide(_spread(F.col("key")) - _spread(F.col("low")), _spread(F.col("high")) - _spread(F.col("low")))
    bucket = F.coalesce(F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int"), F.lit(0))
    sums = held.groupBy("__gl_source", bucket.alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    upto = F.sum("s").over(Window.partitionBy("__gl_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(sums.withColumn("upto", upto), "mix-sums")  # at most BUCKETS rows for each source
    placed = join_small(placed, state.select("__gl_source", "rest", F.col("before").alias("start")), "__gl_source", "inner")
    first = F.min_by(F.struct("n", "low", "high", (F.col("start") + F.col("upto") - F.col("s")).alias("before")), "bucket").alias("b")
    border = placed.filter(F.col("start") + F.col("upto") > F.col("rest")).groupBy("__gl_source", "rest").agg(first)
    return materialize(border.select("__gl_source", "rest", "b.before", "b.low", "b.high", "b.n"), "mix-borders")


def _cuts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(__gl_source, cut, cut_take, cut_of): the place of the last row that a source's sample takes, and how many of the rows at that place."""
    open_ = (F.col("n") > BUCKET_ROWS) & (_spread(F.col("low")) < _spread(F.col("high")))
    done = None
    while True:
        small = state.filter(~open_)
        done = small if done is None else done.unionByName(small)
        state = state.filter(open_)
        if not state.head(1):
            break
        state = _narrowed(rows, state)
    done = materialize(done, "mix-borders")
    held = join_small(rows.select("__gl_source", "size", "__gl_place"), done.select("__gl_source", "rest", "before", "low", "high"), "__gl_source", "inner")
    held = held.filter("__gl_place.key >= low and __gl_place.key <= high")
    # equal rows are one, with their number
    places = held.groupBy("__gl_source", "rest", "before", "__gl_place").agg(F.first("size").alias("size"), F.count("*").alias("of"))
    total = F.col("size") * F.col("of")
    sofar = F.sum(total).over(Window.partitionBy("__gl_source").orderBy("__gl_place").rowsBetween(Window.unboundedPreceding, 0)) - total
    # a row is taken if its middle lies within what is left
    room = F.col("rest") - F.col("before") - sofar
    take = F.when(F.col("size") == 0, F.when(room >= 0, F.col("of")).otherwise(0)).otherwise(F.greatest(F.least(F.floor(room / F.greatest(F.col("size"), F.lit(1)) + 0.5), F.col("of")), F.lit(0)))
    last = F.max(F.struct("__gl_place", "take", "of")).alias("c")
    inside = places.withColumn("take", take.cast("long")).filter("take > 0").groupBy("__gl_source").agg(last)
    inside = inside.select("__gl_source", F.col("c.__gl_place").alias("cut"), F.col("c.take").alias("cut_take"), F.col("c.of").alias("cut_of"))
    # sources whose border takes no row are cut before it
    none = F.struct(F.col("low").alias("key"), F.lit(-(1 << 63)).alias("id"), F.lit(-(1 << 63)).alias("row"))
    before = done.join(inside.select("__gl_source"), "__gl_source", "left_anti").select("__gl_source", none.alias("cut"), F.lit(0).cast("long").alias("cut_take"), F.lit(1).cast("long").alias("cut_of"))
    return inside.unionByName(before)


def mix_plan(rows: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, epochs and the cut of its sample, from materialized rows (source, __gl_source, __gl_place, size)."""
    by_source = rows.groupBy("__gl_source", F.col("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("__gl_place.key").alias("low"), F.max("__gl_place.key").alias("high"))
    by_source = materialize(by_source, "mix-sources")
    targets = source_targets(by_source.select(F.col("__gl_source").alias("source_key"), "source", "source_size")).withColumnRenamed("source_key", "__gl_source").drop("source")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    wanted = targets.filter("rest > 0").select("__gl_source", "rest").join(by_source.select("__gl_source", "low", "high", "n"), "__gl_source")
    state = materialize(wanted.select("__gl_source", "rest", F.lit(0).cast("long").alias("before"), "low", "high", "n"), "mix-borders")
    return materialize(targets.drop("rest").join(_cuts(rows, state), "__gl_source", "left"), "mix-plan")


def with_copies(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Append the plan's columns and copies to rows with __gl_source and __gl_place; of the rows at a source's cut the first ones are taken."""
    joined = join_small(df, plan, "__gl_source", "inner", salt_by=F.col("__gl_place"))
    at_cut = F.coalesce(F.col("__gl_place") == F.col("cut"), F.lit(False)) & (F.col("cut_take") < F.col("cut_of"))
    more = F.coalesce(F.col("__gl_place") <= F.col("cut"), F.lit(False))
    if not plan.filter("cut_take > 0 and cut_take < cut_of").head(1):
        return joined.withColumn("copies", F.col("epochs") + F.when(at_cut, 0).otherwise(more.cast("int")))
    # equal rows at a cut are numbered by partition
    numbered = joined.withColumn("__gl_part", F.spark_partition_id()).withColumn("__gl_at", F.monotonically_increasing_id())
    ties = numbered.filter(at_cut)
    before = F.coalesce(F.sum("__gl_rows").over(Window.partitionBy("__gl_source").orderBy("__gl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(ties.groupBy("__gl_source", "__gl_part").agg(F.count("*").alias("__gl_rows")).select("__gl_source", "__gl_part", before.alias("__gl_before")), "mix-ties")
    place = F.row_number().over(Window.partitionBy("__gl_source", "__gl_part").orderBy("__gl_at")) + F.col("__gl_before")
    ties = join_small(ties, parts, ["__gl_source", "__gl_part"], "inner").withColumn("more", (place <= F.col("cut_take")).cast("int")).drop("__gl_before")
    rest = numbered.filter(~at_cut).withColumn("more", more.cast("int"))
    return rest.unionByName(ties).withColumn("copies", F.col("epochs") + F.col("more")).drop("more", "__gl_part", "__gl_at")


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document."""
    t, d, s = F.col(text), F.col(doc_id), F.col(source)
    rows = df.select(d.alias("doc_id"), s.alias("source"), size_of(t).alias("size"), *[c.alias(n) for n, c in _keyed(d, t, s, weight, seed).items()])
    rows = materialize(rows, "mix-keys")
    out = with_copies(rows, mix_plan(rows))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, with its own columns, whatever their names and types.

    Null texts have size 0; a null source is a source of its own; rows equal in doc_id, text and source are taken singly;
    very long texts count whole; an empty table stays empty.
    """
    renamed, restored, name = kept_columns(documents)
    doc_id, text, source = (F.col(name[c]) for c in ("doc_id", "text", "source"))
    keyed = _keyed(doc_id, text, source, None, SEED)
    rows = materialize(renamed.select(source.alias("source"), size_of(text).alias("size"), *[c.alias(n) for n, c in keyed.items()]), "mix-keys")
    taken = with_copies(renamed.withColumns(keyed), mix_plan(rows)).filter("copies > 0")
    return taken.withColumn("__gl_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*restored)


ORACLE_SQL = """
WITH k AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce(length(text), 0) AS chars,
    coalesce(length(text), 0) - coalesce(length(translate(text, '#*$%&|<>!', '')), 0) AS symbols,
    (('0x' || substr(md5('mix-1:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
d AS (SELECT doc_id, source, size, -ln(u) / greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * symbols::DOUBLE / greatest(chars, 1)::DOUBLE) AS key FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
  source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / w) AS final FROM l WHERE cap / w > level),
t AS (SELECT source, source_size, coalesce(least(cap, w * final), cap) AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs::BIGINT + CASE WHEN rest > 0 AND upto::DOUBLE - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
