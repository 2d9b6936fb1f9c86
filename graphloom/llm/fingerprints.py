"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text's tokens are hashed; every K consecutive tokens are a k-mer.  A k-mer is chosen if the smallest of its
inner s-mers (S tokens) is its first or its last one.  The choice depends on the k-mer alone, so the same passage
gives the same anchors wherever it stands (closed syncmers; Edgar 2021).  An anchor is its hash and its place.
The fingerprint holds all anchors of the text, at each of their places; from two fingerprints follow their likeness
(Jaccard similarity of the sets of anchor hashes) and the places that match.

Documents are neighbours in ascending order of doc_id, then of a hash of the text.  Ranges of that order are dealt to
tasks, by bounds from a bounded sample, and the first document of each range is also sent to the range before it, so one
shuffle of the texts pairs all neighbours.  Equal rows take part once and come back as many, so neither they nor the
rows of one id must fit one range.

Defined cases: null text is empty, an empty text has an empty fingerprint and is alike (1) to another empty
one; texts of fewer than K tokens have one anchor, the whole sequence; tokens longer than TOKEN_CHARS are cut; very long
texts are read whole, places from 2^PLACE_BITS - 1 on are given as that; null ids come first; an equal row's next document
is the next of its equals, the last one's what follows; a single document is its own next one; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import join_small, materialize, table

K, S = 5, 2
TOKEN_CHARS = 24
#: Bits of an anchor's place; its hash has the other 40.
PLACE_BITS = 23
#: Ranges of doc_id for each shuffle partition: several small ones even out what tasks get.
RANGES = 4
#: Ranges at most; their bounds (8 bytes each) are held in the plan.
MOST_RANGES = 100_000
#: Documents sampled for each range to find the bounds.
SAMPLED = 20
_FIRST = -(1 << 63)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, where a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hash_: Column, place: Column) -> Column:
    low = F.least(place, F.lit((1 << PLACE_BITS) - 1)).cast("long")
    return F.shiftleft(hash_.bitwiseAND(F.lit((1 << 40) - 1)), PLACE_BITS).bitwiseOR(low)


def anchor_hash(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def anchor_place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def fingerprint(text: Column, sketch: int | None = None) -> Column:
    """array<long> of all packed anchors, in ascending order; with `sketch`, the first place of so many smallest hashes."""
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN_CHARS), F.lit(0))
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def of_hashes(h: Column) -> Column:
        # m[i]: hash of the s-mer at i
        m = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def of_mers(m: Column) -> Column:
            last = K - S

            def chosen(i: Column) -> Column:
                edge = F.least(F.get(m, i), F.get(m, i + last))
                return edge <= F.least(*[F.get(m, i + j) for j in range(1, last)])

            def anchor(i: Column) -> Column:
                parts = [F.get(m, i + j) for j in range(0, K - S, S)] + [F.get(m, i + K - S)]
                return _packed(F.xxhash64(*parts), i)

            return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - K), chosen), anchor)

        short = F.when(F.size(h) > 0, F.array(_packed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) < K, short).otherwise(_bind(m, of_mers))

    def distinct(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (anchor_hash(x) != anchor_hash(F.get(a, i - 1))))

    every = F.sort_array(_bind(hashes, of_hashes))
    return every if sketch is None else F.slice(_bind(every, distinct), 1, sketch)


def likeness(a: Column, b: Column, sketch: int | None = None) -> Column:
    """Jaccard similarity of the sets of anchor hashes, 1 for two empty ones; with `sketch`, over so many smallest hashes."""

    def of_two(x: Column) -> Column:
        union, shared = F.array_union(x["a"], x["b"]), F.array_intersect(x["a"], x["b"])
        if sketch is None:
            return F.size(shared) / F.size(union)
        return _bind(F.slice(F.sort_array(union), 1, sketch), lambda u: F.size(F.array_intersect(u, shared)) / F.size(u))

    hashes = F.struct(F.transform(a, anchor_hash).alias("a"), F.transform(b, anchor_hash).alias("b"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_bind(hashes, of_two))


def _first_place(fp: Column, anchor: Column) -> Column:
    """First place in a fingerprint of an anchor's hash, by binary search; null if it isn't there."""
    least = F.shiftleft(anchor_hash(anchor), PLACE_BITS)
    steps = F.lit([1 << i for i in range(30, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda at, s: F.when((s <= F.size(fp) - at) & (F.get(fp, at + s - 1) < least), at + s).otherwise(at))
    return _bind(F.get(fp, before), lambda x: F.when(anchor_hash(x) == anchor_hash(anchor), anchor_place(x)))


def matching_places(a: Column, b: Column) -> Column:
    """array<struct<a, b>>: token places of the anchors that two fingerprints share, for positional matching.

    Every place of a shared anchor in either text is there, a repeated one with the other text's first.
    """

    def pairs(x: Column) -> Column:
        again = F.filter(x["b"], lambda y, i: (i > 0) & (anchor_hash(y) == anchor_hash(F.get(x["b"], i - 1))))
        of_a = F.transform(x["a"], lambda y: F.struct(anchor_place(y).alias("a"), _first_place(x["b"], y).alias("b")))
        of_b = F.transform(again, lambda y: F.struct(_first_place(x["a"], y).alias("a"), anchor_place(y).alias("b")))
        return F.sort_array(F.filter(F.concat(of_a, of_b), lambda p: p["a"].isNotNull() & p["b"].isNotNull()))

    return _bind(F.struct(a.alias("a"), b.alias("b")), pairs)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _range_of(k: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds that are at most (k, tie), by binary search."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    ks, ties = F.lit([b[0] for b in bounds]), F.lit([b[1] for b in bounds])

    def go(at: Column, s: Column) -> Column:
        i = at + s - 1
        return F.when((F.get(ks, i) < k) | ((F.get(ks, i) == k) & (F.get(ties, i) <= tie)), at + s).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), go)


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """(k, tie) that cut the keys into about equal ranges, from a sample of SAMPLED for each."""
    n = keys.count()
    if ranges < 2 or n == 0:
        return []
    sample = keys if n <= SAMPLED * ranges else keys.sample(SAMPLED * ranges / n, seed=11)
    # bounded, so one task may order it
    place = F.row_number().over(Window.orderBy("k", "tie"))
    size = max(1, min(n, SAMPLED * ranges) // ranges)
    chosen = sample.withColumn("place", place).filter(F.col("place") % size == 0).select("k", "tie").distinct().limit(2 * ranges)
    return sorted((r["k"], r["tie"]) for r in chosen.collect())


def with_next_document(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document with the next one in order, the last with the first."""
    spark = df.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(MOST_RANGES, ranges or RANGES * partitions)
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("k"), F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = rows.select("k", "tie")
    repeated = materialize(keys.groupBy("k", "tie").agg(F.count("*").alias("n")).filter("n > 1"), "fp-repeated")
    if repeated.head(1):
        rows = join_small(rows, repeated, ["k", "tie"], "left", salt_by=F.monotonically_increasing_id())
        rows = rows.filter("n is null").unionByName(rows.filter("n is not null").dropDuplicates(["k", "tie"]))
    else:
        rows = rows.withColumn("n", F.lit(None).cast("long"))
    bounds = _bounds(keys, ranges)
    own = _range_of(F.col("k"), F.col("tie"), bounds)
    # one row for each range, at most 2 * MOST_RANGES
    firsts = sorted((r["r"], r["f"]["k"], r["f"]["tie"]) for r in keys.groupBy(own.alias("r")).agg(F.min(F.struct("k", "tie")).alias("f")).collect())
    sent = [(k, tie, firsts[i - 1][0]) for i, (_, k, tie) in enumerate(firsts)]
    copies = F.broadcast(spark.createDataFrame(sent, "k long, tie long, before int"))
    rows = rows.withColumn("own", own).join(copies, ["k", "tie"], "left")
    places = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(1).alias("copy")))
    places = F.when(F.col("before").isNull(), F.slice(places, 1, 1)).otherwise(places)
    dealt = rows.withColumn("p", F.explode(places)).select("doc_id", "k", "tie", "n", "text", "p.range", "p.copy").repartition(min(ranges, partitions), "range")
    marked = dealt.withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("range").orderBy("copy", "k", "tie")
    paired = marked.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).filter("copy = 0")
    last = paired.select("doc_id", "text", "fp", "next_text", "next_fp")
    if not repeated.head(1):
        return last
    several = paired.filter("n > 1").withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n"))))
    return last.unionByName(several.select("doc_id", "text", "fp", F.col("text").alias("next_text"), F.col("fp").alias("next_fp")))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of a text (in code points, rounded down) replaced by the first as many of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(df: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses, as arrays of anchors."""
    paired = with_next_document(df.select("doc_id", "text")).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    both = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return both.select("*", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
