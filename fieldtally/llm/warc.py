"""WARC archives of pages, written and read back by boundary-chain verification.

Writing: pages with equal payloads (SHA-1) are one ``response``, that with the largest page_id, and
``revisit`` records which name it. A record is a line of a text file whose line separator is the
end of a record, so Spark's writer makes archives of any number of records wherever Spark can write.

Reading: Spark's text reader, with the magic as separator, splits archives by byte ranges and gives
the pieces between magics. A task parses each piece as a candidate record and says where its
successor would begin; sums of the pieces' lengths give the candidates' offsets. A magic
inside a payload gives candidates as well, and these can even be sound records (an
archive within a page). Only those that the chain from the start of the file reaches are
retained: pieces that end where their successor begins are joined to segments of a split, and
pointers between segments are doubled until no new one is reached, in as many rounds as the
logarithm of the longest chain of segments. The payload of a record that holds magics is put together from
its pieces in a second pass over the files that have such records.

Edge cases: a null html is an empty payload. Payloads below ``least_bytes`` are all responses. A null page_id
is written without a record id and never has others refer to it unless all equal pages have none (then all are
responses). Rows that repeat page_id and payload are records of their own: of the largest page_id all
are responses. Line ends in a url become %0D and %0A; a null url is left out. A candidate without a length, or
whose record does not end as one, ends its chain. Very long payloads are read as rows of their pieces.
An empty table gives no records. Other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_join, fresh_path, stored, whole

# Fixed by the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
DATE = "2024-01-01T00:00:00Z"
LEAST_BYTES = 0
RECORDS_PER_FILE = 50_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: ten hex digits are eight base-32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives of all pages (page_id, url, html) below ``path``."""
    payload = whole(F.col("html"))
    url = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    rows = rows.withColumn("weighed", F.octet_length("payload") >= least_bytes)
    equal = rows.where("weighed").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    equal = stored(equal.where("n > 1 and first is not null").select("digest", "first"), "warc-equal")
    rows = bounded_join(rows, equal, ["digest"], F.col("page_id"))
    revisit = F.col("weighed") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    block = F.concat(F.lit(HTTP), F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    rows = rows.withColumn("block", block)
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    record = rows.select(F.concat(F.lit(MAGIC), head, F.lit(END), "block").alias("value"))
    record.write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, lineSep=END)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (start of the split), at (order in the split): what lies between magics."""
    lines = spark.read.text(path, lineSep=MAGIC)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _field(name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract("head", f"(?im)^{name}:[ \\t]*{pattern}[ \\t]*\\r?$", 1), F.lit(""))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds what a piece, or a record put together, says of itself as a record.

    ``needs`` is how many bytes from the magic's end to the successor; null if it cannot be a record.
    ``sound``: the piece is as long as that and ends as a record does.
    """
    rows = rows.withColumn("head", F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1)))
    rows = rows.withColumns({"size": _field("Content-Length", "([0-9]{1,18})").cast("long"), "type": F.lower(_field("WARC-Type", "([A-Za-z]+)")), "head_bytes": F.octet_length("head")})
    rows = rows.withColumn("needs", F.when(F.col("type").isNotNull(), F.col("head_bytes") + 2 * len(END) + F.col("size")))
    whole_piece = F.coalesce(F.col("needs") == F.octet_length("value"), F.lit(False))
    rows = rows.withColumns({"sound": whole_piece & F.col("value").endswith(END), "needs": F.when(~whole_piece | F.col("value").endswith(END), F.col("needs"))})
    data = F.col("value").cast("binary")
    rows = rows.withColumn("body", F.when(F.col("sound"), F.substring(data, F.col("head_bytes") + len(END) + 1, F.col("size").cast("int"))))
    # The payload of an HTTP message begins after its own head.
    told = F.col("body").cast("string")
    http = F.when(F.lower(_field("Content-Type", "([^;\\r\\n]+).*")) == "application/http", F.octet_length(F.substring_index(told, END, 1)) + len(END)).otherwise(0)
    rows = rows.withColumn("payload", F.substring("body", http + 1, F.octet_length("body")))
    return rows.select(
        *[c for c in rows.columns if c in ("file", "block", "at", "offset")],
        F.octet_length("value").cast("long").alias("bytes"),
        "needs",
        "sound",
        F.col("type").alias("record_type"),
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]{1,19})>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "(.*?)").alias("url"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]{1,19})>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("told_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "payload",
    )


def placed(rows: DataFrame, size: Column) -> DataFrame:
    """Adds ``offset``: where in its file the magic before a piece begins. ``size``: the piece's bytes."""
    step = size.cast("long") + len(MAGIC)
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("_total"))
    start = F.sum("_total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(start, F.lit(0)).alias("_start"))
    return rows.withColumn("_inside", inside).join(blocks, ["file", "block"]).withColumn("offset", F.col("_start") + F.col("_inside") - len(MAGIC)).drop("_start", "_inside")


def segments(found: DataFrame) -> DataFrame:
    """Adds ``successor`` and ``segment``: the offset of the first piece of a run, in one split, of
    pieces of which each but the last ends where the next begins, and none but the first is a landing of another's end."""
    found = found.withColumn("successor", F.col("offset") + len(MAGIC) + F.col("needs"))
    landings = found.where("not sound and successor is not null").select("file", F.col("successor").alias("offset")).distinct().withColumn("landing", F.lit(True))
    found = found.join(landings, ["file", "offset"], "left")
    order = Window.partitionBy("file", "block").orderBy("at")
    opens = F.col("landing").isNotNull() | F.coalesce(~F.lag("sound").over(order), F.lit(True))
    found = found.withColumn("_opens", opens)
    return found.withColumn("segment", F.max(F.when(F.col("_opens"), F.col("offset"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens", "landing")


def reached(jumps: DataFrame) -> DataFrame:
    """file, segment: those that the chain from offset 0 reaches. ``jumps``: file, segment, successor.

    After round k a jump is 2^k segments long, and all within 2^k of the start are found. Successors lie
    behind, so chains end.
    """
    there = stored(jumps.where("segment = 0").select("file", "segment"), "warc-reached")
    jumps = stored(jumps.where("successor is not null"), "warc-jumps")
    while True:
        new = stored(there.join(jumps, ["file", "segment"]).select("file", F.col("successor").alias("segment")), "warc-reached")
        if new.isEmpty():
            return there
        there = stored(there.unionAll(new), "warc-reached")
        then = jumps.select("file", F.col("segment").alias("successor"), F.col("successor").alias("further"))
        jumps = stored(jumps.join(then, ["file", "successor"]).select("file", "segment", F.col("further").alias("successor")), "warc-jumps")


def _put_together(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """The records of ``broken`` (file, offset, successor), of several pieces each, as ``parsed`` gives them."""
    files = broken.select("file").distinct()
    rows = placed(pieces(spark, path).join(files, "file", "left_semi"), F.octet_length("value"))
    rows = rows.join(broken.select("file", "offset", F.struct("offset", "successor").alias("record")), ["file", "offset"], "left")
    rows = rows.withColumn("record", F.last("record", True).over(Window.partitionBy("file").orderBy("offset")))
    rows = rows.where(F.col("offset") < F.col("record.successor"))
    parts = F.sort_array(F.collect_list(F.struct("offset", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), MAGIC).cast("binary")
    rows = rows.groupBy("file", "record").agg(joined.alias("value"))
    # What stands between its end and the next magic is not the record's.
    size = (F.col("record.successor") - F.col("record.offset") - len(MAGIC)).cast("int")
    return parsed(rows.select("file", "record.offset", F.substring("value", F.lit(1), size).cast("string").alias("value"))).where("sound")


def records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row for each record that the chains of the archives below ``path`` reach: file, offset,
    record_type, page_id, url, refers_to, told_digest, payload_bytes, payload_digest (of what
    the record holds) and, if asked for, the payload (binary)."""
    columns = ["file", "offset", "record_type", "page_id", "url", "refers_to", "told_digest", "payload_bytes", "payload_digest", *["payload"] * payload]
    found = parsed(pieces(spark, path))
    found = stored(found if payload else found.drop("payload"), "warc-candidates")
    found = stored(segments(placed(found, F.col("bytes"))).where("offset >= 0"), "warc-segments")
    jumps = found.groupBy("file", "segment").agg(F.max(F.struct("offset", "successor")).alias("last"))
    kept = found.join(reached(jumps.select("file", "segment", "last.successor")), ["file", "segment"], "left_semi")
    out = kept.where("sound").select(*columns)
    broken = stored(kept.where("not sound and successor is not null").select("file", "offset", "successor"), "warc-broken")
    if broken.isEmpty():
        return out
    return out.unionByName(_put_together(spark, path, broken).select(*columns))


def resolved(found: DataFrame) -> DataFrame:
    """Of each record of ``records`` page_id, payload_bytes and payload_digest of the full payload (a
    revisit's by the response it names), record_type, refers_to, and whether the digest told is that of the payload."""
    found = found.drop("payload")
    responses = found.where("record_type = 'response'")
    revisits = found.where("record_type = 'revisit'")
    asked = revisits.groupBy("refers_to", "told_digest").agg(F.count("*").alias("n"))
    held = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    known = stored(asked.join(held, ["refers_to", "told_digest"]).drop("n"), "warc-referred")
    full = bounded_join(revisits, known, ["refers_to", "told_digest"], F.col("page_id"))
    told = F.col("told_digest").alias("payload_digest")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), F.coalesce(F.col("told_digest") == F.col("payload_digest"), F.lit(False)).alias("verified")).unionAll(
        full.select("page_id", F.col("full_bytes").alias("payload_bytes"), told, "record_type", "refers_to", F.col("full_bytes").isNotNull().alias("verified"))
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    return resolved(stored(records(spark, path), "warc-records"))
