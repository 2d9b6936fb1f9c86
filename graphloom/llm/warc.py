"""WARC writing, and reading by boundary-chain verification.

Archives are plain WARC 1.1 files, written by Spark's own writer into any file system it knows; any version 1.x is
read.  Reading splits files at the magic that starts a record, so large files are read in parts by many tasks.  Every
place of the magic is a candidate: a task emits the candidate's offset and, from its Content-Length, the
offset of its successor.  Whether a candidate is a record or text inside a payload shows only in the
chain: records are what is reached from the start of the file by following successors.

Offsets are sums inside a block of a file (what one task reads), moved by the sums of the blocks before: no task
orders more than a block.  Candidates whose successor is the next candidate form runs; only the ends of runs need
jumps, and these are followed by pointer jumping (the jumps are doubled in each round).  All steps are DataFrame
operations and shuffle offsets and digests, not payloads, but for the few blocks with payloads that hold a magic.

Defined cases: null payloads are empty; of equal payloads the smallest page_id is the response (repeated
rows of that id too) and null ids come last; a null url is written as about:blank; line ends in urls are
escaped; payloads of any length are written whole; other columns, whatever their names, are not read; an empty
table gives no records.  A length that is missing, negative or runs past the end of the file breaks the chain: that
record and those behind it are not reached and not returned.  A file that doesn't begin with a record is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import join_small, materialize, new_path

#: Fixed values of the format.
MAGIC = "WARC/1."
VERSION = "1\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"

HEX_SHA1_EMPTY_DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(hex_sha1: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_first_copies(pages: DataFrame, payload: str) -> DataFrame:
    """Append sha1 and first_id: the smallest page_id of the payload's copies, null if it is the only one.

    Only digests are shuffled.  `repeated` has a row for each payload with copies.
    """
    keyed = pages.withColumn("sha1", F.sha1(F.encode(payload, "UTF-8")))
    repeated = keyed.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return join_small(keyed, materialize(repeated, "warc-repeated"), "sha1", "left")


def write_warc(pages: DataFrame, path: str, date: str = HEX_SHA1_EMPTY_DATE) -> None:
    """Write (page_id, url, html) as one record each under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = with_first_copies(rows, "html")
    n = F.octet_length("html")
    digest = base32_of_hex(F.col("sha1"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(HTTP_HEAD + "\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(F.col("first_id")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    # the writer ends each row with the two empty lines that end a record
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", RECORD_END).text(path)


def _header(c: Column, name: str) -> Column:
    value = F.regexp_extract(c, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(value != "", value)


def _id_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text between places of the magic, with its file, the block that it was read in, and its order there."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _in_block():
    return Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)


def _blocks_before(name: str, of=F.sum):
    """A value over the blocks before in the file: one row for each block."""
    return of(name).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def _with_offsets(chunks: DataFrame, blocks: DataFrame, size: Column) -> DataFrame:
    """Append offset (of the magic before the chunk, negative for what precedes the first one); blocks: (file, block, begin)."""
    inside = F.coalesce(F.sum(size + len(MAGIC)).over(_in_block()), F.lit(0))
    return join_small(chunks.withColumn("inside", inside), blocks.select("file", "block", "begin"), ["file", "block"], "inner").withColumn("offset", F.col("begin") + F.col("inside") - len(MAGIC)).drop("inside", "begin")


def _payload(rest: Column, content_length: Column) -> tuple[Column, Column]:
    """(bytes, SHA-1 in hex) of the HTTP body in a record's block."""
    start = F.octet_length(F.substring_index(rest, "\r\n\r\n", 1)) + 4
    n = F.greatest(content_length - start, F.lit(0)).cast("int")
    return n.cast("long"), F.sha1(F.substring(rest.cast("binary"), start + 1, n))


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all places of the magic with their successors, fields, and payload digest as if they were records; blocks of the files)."""
    head = F.substring_index("value", "\r\n\r\n", 1)
    c = _chunks(spark, path).withColumn("head", head).withColumn("head_bytes", F.octet_length("head").cast("long"))
    length = _header(F.col("head"), "Content-Length").try_cast("long")
    c = c.withColumn("length", F.when(F.rlike("head", F.lit(r"^\d+\r\n")) & (length >= 0), length))
    rest = F.substr(F.col("value"), F.length("head") + 5)
    payload_bytes, sha1 = _payload(rest, F.col("length"))
    size, skip = F.octet_length("value").cast("long"), F.col("head_bytes") + F.col("length") + len(RECORD_END) + 4
    narrow = c.select(
        "file", "block", "at", size.alias("size"), skip.alias("skip"), "length",
        # the successor is the next candidate
        F.when(skip.eqNullSafe(size), 0).otherwise(1).alias("broken"),
        _header(F.col("head"), "WARC-Type").alias("record_type"),
        _id_of(_header(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        _id_of(_header(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("declared_digest"),
        F.regexp_extract(rest, r"^[^\r\n]*(?:\r\n[^\r\n]+)*?\r\nContent-Length: *(\d+)", 1).try_cast("long").alias("http_length"),
        payload_bytes.alias("payload_bytes"), sha1.alias("sha1"),
    )
    narrow = materialize(narrow, "warc-chunks")
    sums = narrow.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.sum("broken").alias("breaks"))
    zero = F.lit(0)
    blocks = sums.select(
        "file", "block", F.coalesce(_blocks_before("bytes"), zero).alias("begin"), F.coalesce(_blocks_before("breaks"), zero).alias("breaks"),
        (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_end"),
    )
    blocks = materialize(blocks, "warc-blocks")
    run = F.coalesce(F.sum("broken").over(_in_block()), zero)
    placed = _with_offsets(narrow.withColumn("inside_run", run), blocks, F.col("size"))
    placed = join_small(placed, blocks.select("file", "block", "breaks", "file_end"), ["file", "block"], "inner")
    succ = F.col("offset") + len(MAGIC) + F.col("skip")
    placed = placed.withColumn("run", F.col("breaks") + F.col("inside_run")).withColumn("succ", F.when(succ <= F.col("file_end"), succ)).filter("offset >= 0")
    return materialize(placed.drop("inside_run", "breaks", "file_end", "skip"), "warc-candidates"), blocks


def reached_runs(cand: DataFrame) -> DataFrame:
    """(file, run, entry): runs that the chain from the file's start enters, and where.  Successors lie behind, so a run is entered once."""
    first = cand.filter("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    jumps = cand.filter("broken = 1 and succ is not null").select("file", "run", "succ")
    ends = cand.filter("length is not null").select("file", F.col("offset").alias("succ"), F.col("run").alias("to"))
    # from the end of a run to the place in another one where its successor starts
    jump = materialize(jumps.join(ends, ["file", "succ"]).select("file", "run", "to", F.col("succ").alias("entry")), "warc-jumps")
    reached = materialize(first, "warc-reached")
    if not jump.head(1):
        return reached
    n = reached.count()
    while True:
        new = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), jump["entry"])
        reached = materialize(reached.union(new).groupBy("file", "run").agg(F.min("entry").alias("entry")), "warc-reached")
        m = reached.count()
        if m == n:
            return reached
        n = m
        other = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        doubled = jump.join(other, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry"))
        jump = materialize(doubled, "warc-jumps")


_RECORD = ("file", "offset", "page_id", "record_type", "refers_to", "declared_digest", "http_length", "payload_bytes", "sha1")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record reached: file, offset, page_id, record_type, refers_to, payload_bytes, payload_digest, declared_digest."""
    cand, blocks = candidates(spark, path)
    begun = cand.filter("offset = 0 and length is not null").select("file")
    if lost := blocks.filter("block = 0 and file_end > 0").join(begun, "file", "left_anti").head(1):
        raise ValueError(f"{lost[0]['file']} doesn't begin with a WARC 1.x record")
    records = join_small(cand, reached_runs(cand), ["file", "run"], "inner").filter("offset >= entry and succ is not null")
    whole = records.filter("broken = 0").select(*_RECORD)
    split = materialize(records.filter(f"broken = 1 and succ > offset + {len(MAGIC)} + size").select("block", "succ", "length", *_RECORD), "warc-split")
    if split.head(1):
        whole = whole.unionByName(_reassembled(spark, path, cand, blocks, split))
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "file", "offset", "page_id", "record_type", "refers_to",
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(base32_of_hex(F.col("sha1"))).alias("payload_digest"),
        "declared_digest",
    )


def _reassembled(spark: SparkSession, path: str, cand: DataFrame, blocks: DataFrame, split: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their chunks are put together again.

    Which record a chunk belongs to follows from the offsets alone; payloads are read anew, of the blocks concerned.
    """
    starts = split.select("file", "offset", F.struct("offset", "succ").alias("start"))
    marked = cand.select("file", "block", "at", "offset").join(starts, ["file", "offset"], "left")
    held = F.last("start", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # starts ascend in a file, so the last one of the blocks before is the largest
    by_block = marked.groupBy("file", "block").agg(F.max("start").alias("top"))
    carried = materialize(by_block.select("file", "block", _blocks_before("top", F.max).alias("carried")), "warc-carried")
    parts = join_small(marked.withColumn("held", held), carried, ["file", "block"], "inner").withColumn("held", F.coalesce("held", "carried"))
    parts = materialize(parts.filter("offset < held.succ").select("file", "block", "offset", F.col("held.offset").alias("record")), "warc-parts")
    concerned = materialize(parts.select("file", "block").distinct().withColumn("concerned", F.lit(True)), "warc-concerned")
    chunks = join_small(_chunks(spark, path), concerned, ["file", "block"], "inner").drop("concerned")
    chunks = _with_offsets(chunks, blocks, F.octet_length("value").cast("long")).select("file", "offset", "value")
    pieces = F.sort_array(F.collect_list(F.struct("offset", "value")))
    text = chunks.join(parts.drop("block"), ["file", "offset"]).groupBy("file", F.col("record").alias("offset")).agg(F.array_join(F.transform(pieces, lambda x: x["value"]), MAGIC).alias("value"))
    rest = F.substr(F.col("value"), F.length(F.substring_index("value", "\r\n\r\n", 1)) + 5)
    payload_bytes, sha1 = _payload(rest, F.col("length"))
    done = split.drop("payload_bytes", "sha1").join(text, ["file", "offset"]).withColumn("payload_bytes", payload_bytes).withColumn("sha1", sha1)
    return done.select(*_RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ten hex digits are eight base32 digits
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n{g} >> {5 * (7 - d)}) & 31)::INT + 1, 1)" for g in range(4) for d in range(8))
_PARTS = ", ".join(f"('0x' || substr(sha1(p.html), {10 * g + 1}, 10))::BIGINT AS n{g}" for g in range(4))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
d AS (SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, first_id, {_PARTS} FROM p JOIN f ON p.html = f.html)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
