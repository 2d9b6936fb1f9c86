"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order: those that very many documents share come last, the others go by hash.  The order is
cut into fragments, overlaps are counted in each fragment by itself and summed for each pair (as in FS-Join; Rong
et al. 2017).  The first fragment of a document is its prefix, the n - ceil(0.8 n) + 1 first shingles: similar
documents share one there, and the overlap counted there bounds the whole.  Only pairs whose bound reaches the
threshold are counted in the other fragments.

Copies: documents with equal sets form a class and take part once.  Large groups of near copies share only very
frequent shingles, so lists of these aren't paired: every member is compared with the list's pivot (the one with the
fewest other shingles), which is what connects such a group; then only members outside a list's main component are
compared with the others, if their numbers of frequent shingles let them be similar at all.  So no link between
components is lost, and pairs inside a component need not be found.

Which shingles count as frequent changes the order, hence the cost, never the result: any order is right.  They are found in
parts of the table first; a prefix list that still has more than LONG nodes makes its shingle a frequent one too.  Tasks hold
at most MOST_FREQUENT; any further ones (`late`) are a table, joined with the sets of the documents that have one in their prefix.
No list of more than LONG nodes is ever paired.

Defined cases: null or empty texts have an empty set, no links, and are their own component; texts of fewer words than
a shingle are one shingle; very long texts are compared whole; repeated rows and ids are documents each; a null doc_id takes
part and its component is the smallest id reachable, null if there is none; ties between pivots go to the smaller node; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import BROADCAST_BYTES, SALTS, join_small, kept_columns, materialize, trimmed, written_bytes
from graphloom.llm.textvec import LOWER, NOT_SPACE, buffers, mix, slices, window_hashes, words

SHINGLE = 5
#: Similarity from which documents link, in percent.
PERCENT = 80
#: Documents from which a shingle counts as frequent, and frequent shingles held at most (8 bytes each in every task).
FREQUENT = 64
MOST_FREQUENT = 400_000
#: Prefix lists with more nodes aren't paired: their shingles become frequent ones, and the prefixes are made anew.
LONG = 512
#: Shingles among which a task looks for repeated ones at a time.
COUNT_CHUNK = 3_000_000
#: Fragments in which overlaps of the remaining pairs are counted.
FRAGMENTS = 4
#: Pairs of one node from which its fragments are dealt over several tasks.
HUB_PAIRS = 256
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a slice, by document and hash; hashes are even."""
    w = words(LOWER[data], offsets, NOT_SPACE)
    at, h = window_hashes(w, SHINGLE)
    doc = w.document()[at]
    n = np.diff(w.first)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):
            one = np.zeros(len(short), np.uint64)
            for j in range(size):
                one = mix(one + w.hash[w.first[short] + j] * np.uint64(2 * j + 3) + np.uint64(size))
            doc, h = np.concatenate([doc, short]), np.concatenate([h, one])
    h = h & _EVEN
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    return doc, h


def _least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-n * PERCENT // 100)


def _signed(h: np.ndarray) -> np.ndarray:
    """Even 64-bit hashes as non-negative longs in the same order."""
    return (h >> np.uint64(1)).astype(np.int64)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that stand in many documents, sorted: at most MOST_FREQUENT, the most frequent ones.

    Tasks report what repeats among COUNT_CHUNK of their shingles; the reports are summed over all documents.
    """

    def count(batches):
        held, size = [], 0

        def report():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(_signed(values[some]), pa.int64()), pa.array(n[some], pa.int64())], names=["h", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                _, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append(h)
                size += len(h)
                if size >= COUNT_CHUNK:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    sums = docs.select("text").mapInArrow(trimmed(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = sums.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow()  # bounded
    return np.sort(top["h"].to_numpy()) if top.num_rows else np.zeros(0, np.int64)


DOCUMENT = "doc_id long, tag long, node long, n long, known long, last long, prefix array<long>, frequent array<long>"


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int64()))


def _among(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of h stand in the sorted values."""
    if len(values) == 0:
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return values[at] == h


def _prefixes(doc: np.ndarray, h: np.ndarray, is_hot: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(n, known, last, prefix, frequent) of the sets (document, hash), by document, in the order (frequent, hash)."""
    n = np.bincount(doc, minlength=rows)
    first = np.searchsorted(doc, np.arange(rows + 1))
    order = np.lexsort((h, is_hot, doc))
    h, is_hot, doc = h[order], is_hot[order], doc[order]
    length = np.where(n > 0, n - _least_overlap(n) + 1, 0)
    inside = np.arange(len(h)) - first[:-1][doc] < length[doc]
    plain, often = inside & ~is_hot, inside & is_hot
    reach = np.bincount(doc[often], minlength=rows) > 0
    cold = np.bincount(doc[~is_hot], minlength=rows)
    last = np.full(rows, np.iinfo(np.int64).max)
    end = first[:-1] + length - 1
    ok = (n > 0) & ~reach
    last[ok] = h[end[ok]]
    return n.astype(np.int64), np.where(reach, cold, length).astype(np.int64), last, _lists(h[plain], doc[plain], rows), _lists(h[often], doc[often], rows)


def prefix_table(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row for each document with its set's size, hash (`node`), and prefix in the global order.

    known: how many shingles the prefix shows up to its end; `last` is that end.  If frequent shingles reach into the prefix,
    all others lie in it, and known is their number.  tag: a hash of the text.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT longs

    def run(batches):
        hot = held.value
        for batch in batches:
            ids = batch.column(0)
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                rows = b - a
                doc, raw = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = _signed(raw)
                n, known, last, prefix, often = _prefixes(doc, h, _among(h, hot), rows)
                # equal sets have equal sums of mixed hashes
                total = np.zeros(rows, np.uint64)
                if len(h):
                    some = np.flatnonzero(n)
                    total[some] = np.add.reduceat(mix(raw + np.uint64(11)), np.searchsorted(doc, some))
                node = _signed(mix(total + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & ~np.int64(1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, rows).cast(pa.int64()), batch.column(2).slice(a, rows), pa.array(node), pa.array(n), pa.array(known), pa.array(last), prefix, often],
                    names=["doc_id", "tag", "node", "n", "known", "last", "prefix", "frequent"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(trimmed(run), DOCUMENT)


def later_prefixes(sets: DataFrame, hit: DataFrame, frequent: np.ndarray, late: DataFrame) -> DataFrame:
    """Prefixes made anew for the nodes of `hit`, from their fragments: the shingles of `late` are frequent ones as well."""
    held = sets.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT longs
    known_late = join_small(sets.select("node", F.explode("s").alias("h")), late, "h", "inner", F.col("node")).groupBy("node").agg(F.collect_list("h").alias("late"))
    whole = sets.groupBy("node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("f", "s"))), lambda x: x["s"])).alias("s"))
    rows = hit.join(whole.join(known_late, "node"), "node").select("doc_id", "node", "s", "late")

    def run(batches):
        hot = held.value
        for batch in batches:
            s, late = batch.column(2), batch.column(3)
            doc = np.repeat(np.arange(len(s)), s.value_lengths().to_numpy())
            first = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())])
            begin = np.concatenate([[0], np.cumsum(late.value_lengths().to_numpy())])
            h, late = s.flatten().to_numpy(), late.flatten().to_numpy()
            is_hot = _among(h, hot)
            for d in range(len(s)):
                mine = slice(first[d], first[d + 1])
                is_hot[mine] |= np.isin(h[mine], late[begin[d] : begin[d + 1]])
            n, known, last, prefix, often = _prefixes(doc, h, is_hot, len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(last), prefix, often], names=["doc_id", "node", "n", "known", "last", "prefix", "frequent"])

    return rows.mapInArrow(trimmed(run), "doc_id long, node long, n long, known long, last long, prefix array<long>, frequent array<long>")


def fragment_pairs(postings: DataFrame, partitions: int) -> DataFrame:
    """Overlaps in the first fragment: (x, y, c) for nodes x < y, by partition.

    Partitions hold whole lists of a shingle.  Of a list with more than LONG nodes only (shingle, -1, nodes) is given.
    """

    long = LONG

    def out(x, y):
        pairs = np.stack([np.concatenate(x), np.concatenate(y)], 1)
        pairs, c = np.unique(pairs, axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(c.astype(np.int64))], names=["x", "y", "c"])

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        h, node = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(begin, len(h)))
        if (over := size > long).any():
            yield pa.RecordBatch.from_arrays([pa.array(h[begin[over]]), pa.array(np.full(over.sum(), -1)), pa.array(size[over].astype(np.int64))], names=["x", "y", "c"])
        mine = (size > 1) & ~over
        held_size = np.repeat(size, size)[np.repeat(mine, size)]
        node, place = node[np.repeat(mine, size)], (np.arange(len(h)) - np.repeat(begin, size))[np.repeat(mine, size)]
        xs, ys, held, d = [], [], 0, 1
        # pairs d places apart; lists that are too short for that leave
        while len(node):
            first = np.flatnonzero(place + d < held_size)
            xs.append(node[first])
            ys.append(node[first + d])
            held += len(first)
            if held > 2_000_000:
                yield out(xs, ys)
                xs, ys, held = [], [], 0
            d += 1
            stay = held_size > d
            if not stay.all():
                node, place, held_size = node[stay], place[stay], held_size[stay]
        if held:
            yield out(xs, ys)

    return postings.repartition(partitions, "h").mapInArrow(trimmed(run), "x long, y long, c long")


def first_fragment(kept: DataFrame, partitions: int) -> DataFrame:
    """fragment_pairs of the prefixes of `kept`, summed for each pair."""
    return fragment_pairs(kept.select(F.explode("prefix").alias("h"), "node"), partitions).groupBy("x", "y").agg(F.sum("c").alias("c"))


def _similar(n: Column, overlap: Column) -> Column:
    """Whether sets with n shingles together can be similar, or are, with this overlap."""
    return (100 + PERCENT) * overlap >= PERCENT * n


def fragment_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, f, s): the sets of the wanted (doc_id, node), cut into FRAGMENTS ranges of hashes."""
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if written_bytes(wanted) <= BROADCAST_BYTES else ids
    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in slices(offsets):
                rows = b - a
                doc, raw = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(doc, minlength=rows)
                total = np.zeros(rows, np.uint64)
                first = np.searchsorted(doc, np.arange(rows + 1))
                if len(raw):
                    some = np.flatnonzero(n)
                    total[some] = np.add.reduceat(mix(raw + np.uint64(11)), first[:-1][some])
                node = _signed(mix(total + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.int64(1)
                h = _signed(raw)
                part = doc * FRAGMENTS + (h >> np.int64(61))  # hashes have 63 bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node, FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), rows)), _lists(h, part, rows * FRAGMENTS)],
                    names=["half", "f", "s"],
                )

    sets = chosen.select("text").mapInArrow(trimmed(run), "half long, f int, s array<long>")
    nodes = wanted.select("node", F.shiftright("node", 1).alias("half")).distinct()
    nodes = F.broadcast(nodes) if written_bytes(wanted) <= BROADCAST_BYTES else nodes
    # copies with the same id give the same fragments
    return sets.join(nodes, "half").dropDuplicates(["node", "f"]).select("node", "f", "s")


def verify(pairs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (x, y) that are similar: overlaps are counted in each fragment and summed.

    Fragments of a y with more than HUB_PAIRS pairs are copied SALTS times and its pairs dealt over the copies.
    """
    pairs = materialize(pairs, "pairs")
    hubs = materialize(pairs.groupBy("y").count().filter(F.col("count") > HUB_PAIRS).select("y", F.lit(True).alias("hub")), "hubs")
    pairs = join_small(pairs, hubs, "y", "left", F.col("x"))
    left = pairs.join(sets.select(F.col("node").alias("x"), "f", F.col("s").alias("sx")), "x")
    right = sets.select(F.col("node").alias("y"), "f", F.col("s").alias("sy"))
    partial = left.filter("hub is null").join(right, ["y", "f"])
    if hubs.head(1):
        copies = join_small(right, hubs, "y", "inner").drop("hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = left.filter("hub").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
        partial = partial.unionByName(dealt.join(copies, ["y", "f", "salt"]).drop("salt"))
    counted = partial.select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("o"))
    summed = counted.groupBy("x", "y").agg(F.sum("o").alias("o"))
    sized = _with_nodes(summed, nodes.select("node", "n"))
    return sized.filter(_similar(F.col("x_n") + F.col("y_n"), F.col("o"))).select("x", "y")


def _with_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Append the columns of both nodes, named x_... and y_...."""
    small = written_bytes(nodes) <= BROADCAST_BYTES
    for side in ("x", "y"):
        named = nodes.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in nodes.columns])
        pairs = pairs.join(F.broadcast(named) if small else named, side)
    return pairs


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of links (x, y), by alternating large and small stars (Kiveris et al. 2014)."""
    edges = materialize(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # done once all are stars: whoever has a smaller neighbour has one, which has none itself
        roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter(F.col("below") + F.col("above") > 1).filter("below > 0").head(1):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = join_small(both, least, "u", "inner", F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        own = least.select("u", F.col("m").alias("v"))
        small = join_small(large, least, "u", "inner", F.col("v")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(own).distinct(), "small-star")
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")


def _with_components(pairs: DataFrame, comps: DataFrame, sides=("x", "y")) -> DataFrame:
    for side in sides:
        named = comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
        pairs = pairs.join(F.broadcast(named) if written_bytes(comps) <= BROADCAST_BYTES else named, side, "left").withColumn(f"{side}_comp", F.coalesce(f"{side}_comp", side))
    return pairs


def frequent_pairs(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, y): every node of a frequent shingle's list with the list's pivot y, where their bounds allow a link."""
    with_bounds = lists.join(F.broadcast(nodes) if written_bytes(nodes) <= BROADCAST_BYTES else nodes, "node")
    pivots = with_bounds.groupBy("h").agg(F.min(F.struct(F.col("own") / F.col("n"), "node", "n", "own")).alias("p"))
    pivots = materialize(pivots.select("h", F.col("p.node").alias("y"), F.col("p.n").alias("y_n"), F.col("p.own").alias("y_own")), "pivots")
    pairs = join_small(with_bounds, pivots, "h", "inner", F.col("node")).filter(F.col("node") != F.col("y"))
    return pairs.filter(_can_link()).select(F.col("node").alias("x"), "y").distinct()


def _can_link() -> Column:
    """Whether two nodes whose prefixes reach frequent shingles can be similar without another common one; pairs with one are found in the first fragment."""
    most = F.least(F.col("n") - F.col("own"), F.col("y_n") - F.col("y_own"))
    return _similar(F.col("n") + F.col("y_n"), most)


def rest_pairs(lists: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(x, y): pairs of a frequent list in different components, at least one outside the list's main component, that can link."""
    named = comps.select("node", "comp")
    marked = lists.join(F.broadcast(nodes) if written_bytes(nodes) <= BROADCAST_BYTES else nodes, "node")
    marked = marked.join(F.broadcast(named) if written_bytes(comps) <= BROADCAST_BYTES else named, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = marked.groupBy("h", "comp").agg(F.count("*").alias("k"))
    main = materialize(by_comp.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")), "main-components")
    # sizes of similar sets lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)))).cast("int")
    marked = join_small(marked, main, "h", "inner", F.col("node")).filter("comps > 1").withColumn("band", band)
    marked = materialize(marked.filter(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n")), "frequent-rest")
    rest = materialize(marked.filter("comp <> main").select("h", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("own").alias("y_own"), F.col("comp").alias("y_comp"), F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")), "outside")
    keys = ["h", "band"]
    if written_bytes(rest) <= BROADCAST_BYTES:
        joined = marked.join(F.broadcast(rest), keys)
    else:
        salted = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"])
    pairs = joined.filter((F.col("comp") != F.col("y_comp")) & _can_link())
    return pairs.select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, component) for each row of docs (doc_id, text).

    tag: a hash of the text; component: the component's node, which tells components apart whatever the ids.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_shingles(docs)
    while True:
        table = materialize(prefix_table(docs, frequent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
        full = table.filter("n > 0")
        classes = materialize(full.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "classes")
        repeated = materialize(classes.filter("copies > 1").select("node", F.col("row").alias("kept")), "repeated")
        kept = join_small(full, repeated, "node", "left", F.col("row")).filter("kept is null or kept = row")
        kept = materialize(kept.select("doc_id", "node", "n", "known", "last", "prefix", "frequent"), "kept")
        # first fragment
        counted = materialize(first_fragment(kept, partitions), "fragment-1")
        more = counted.filter("y = -1").orderBy(F.desc("c"), "x").limit(max(MOST_FREQUENT - len(frequent), 0)).select("x").toArrow()  # at most MOST_FREQUENT rows
        if not more.num_rows:
            break
        frequent = np.union1d(frequent, more["x"].to_numpy())
    # long lists beyond what tasks hold
    late = None
    while (long := counted.filter("y = -1").select(F.col("x").alias("h"))).head(1):
        late = materialize(long if late is None else late.union(long), "late")
        has_late = join_small(kept.select("node", F.explode("prefix").alias("h")), late, "h", "inner", F.col("node")).select("node").distinct()
        hit = materialize(kept.select("doc_id", "node").join(has_late, "node").select("doc_id", "node"), "late-nodes")
        anew = later_prefixes(materialize(fragment_sets(docs, hit), "late-sets"), hit, frequent, late)
        kept = materialize(kept.join(hit.select("node"), "node", "left_anti").unionByName(anew), "kept")
        counted = materialize(first_fragment(kept, partitions), "fragment-1")
    sizes = materialize(kept.select("node", "n", "known", "last", (F.size("frequent") > 0).alias("odd")), "nodes")
    near = _with_nodes(counted, sizes)
    n, odd_x, odd_y = F.col("x_n") + F.col("y_n"), F.col("x_odd"), F.col("y_odd")
    left_x, left_y = F.col("c") + F.col("x_n") - F.col("x_known"), F.col("c") + F.col("y_n") - F.col("y_known")
    bound = F.when(odd_x & odd_y, F.least(left_x, left_y)).when(F.col("x_last") <= F.col("y_last"), left_x).otherwise(left_y)
    near = materialize(near.filter(_similar(n, F.least(bound, F.col("x_n"), F.col("y_n")))).select("x", "y", "c"), "near-pairs")

    # lists of frequent shingles
    odd = kept.filter(F.size("frequent") > 0)
    lists = materialize(odd.select(F.explode("frequent").alias("h"), "node"), "frequent-lists")
    bounds = materialize(odd.select("node", "n", F.col("known").alias("own")), "bounds")

    wanted = near.select(F.col("x").alias("node")).union(near.select("y")).union(odd.select("node")).distinct()
    wanted = materialize(kept.select("doc_id", "node").join(wanted, "node"), "wanted")
    sets = materialize(fragment_sets(docs, wanted), "fragments")

    # each node with its best partner and with the pivots, then what is still apart
    sided = near.union(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "c"))
    best = sided.groupBy("x").agg(F.max(F.struct("c", (-F.col("y")).alias("y"))).alias("b")).select("x", (-F.col("b.y")).alias("y"))
    best = best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = verify(best, sets, sizes).union(verify(frequent_pairs(lists, bounds), sets, sizes))
    links = materialize(links, "first-links")
    comps = connected_components(links)
    apart = _with_components(near.select("x", "y"), comps).filter("x_comp <> y_comp").select("x", "y")
    apart = materialize(apart.union(rest_pairs(lists, bounds, comps)).distinct(), "apart")
    more = materialize(verify(apart, sets, sizes), "more-links")
    # components that these links join
    above = None
    if more.head(1):
        ends = _with_components(more, comps)
        above = connected_components(ends.select(F.col("x_comp").alias("x"), F.col("y_comp").alias("y"))).select(F.col("node").alias("comp"), F.col("comp").alias("top"))

    # back to documents
    placed = classes.join(F.broadcast(comps) if written_bytes(comps) <= BROADCAST_BYTES else comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if above is not None:
        placed = join_small(placed, above, "comp", "left", F.col("node")).withColumn("comp", F.coalesce("top", "comp"))
    grouped = placed.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("least_id").alias("component"), F.count("*").alias("nodes"), F.sum("copies").alias("rows")).filter("rows > 1")
    labels = materialize(placed.select("node", "comp").join(grouped.select("comp", "component"), "comp").select("node", "comp", "component"), "labels")
    out = join_small(table.select("doc_id", "tag", "node", "n", "row"), labels, "node", "left", F.col("row"))
    component_id = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, with its own columns: that with the smallest doc_id, then text hash, nulls last.

    Rows without words are linked with nothing and all stay.  Of rows equal in doc_id and text one stays, whichever of them.  Null
    ids take part; very long texts are compared whole; columns pass whatever their names; an empty table stays empty.
    """
    renamed, restored, name = kept_columns(documents)
    doc_id, text = name["doc_id"], name["text"]
    kind = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "tag")
    found = materialize(jaccard_components(documents.select("doc_id", "text")).filter("component is not null").withColumn("kind", kind), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "kind"))
    winners = found.groupBy("component").agg(first.alias("w"), F.count("*").alias("rows")).filter("rows > 1").select("component", F.col("w.kind").alias("winner"))
    marked = join_small(found, materialize(winners, "winners"), "component", "inner", F.col("kind"))
    gone = materialize(marked.filter("kind <> winner").select(F.col("kind").alias("__gl_kind")).distinct(), "gone")
    # equal rows of one document, of which one stays
    twice = materialize(marked.filter("kind = winner").groupBy(F.col("kind").alias("__gl_kind")).count().filter("count > 1").select("__gl_kind", F.lit(True).alias("__gl_twice")), "twice")
    key = F.col(doc_id).cast("long")
    keyed = renamed.withColumn("__gl_kind", F.xxhash64(F.coalesce(key, F.lit(-1)), key.isNull(), F.xxhash64(text)))
    stay = join_small(join_small(keyed, gone, "__gl_kind", "left_anti", F.col(text)), twice, "__gl_kind", "left", F.col(text))
    once = stay.filter("__gl_twice").dropDuplicates(["__gl_kind"])
    return stay.filter("__gl_twice is null").unionByName(once).select(*restored)
