"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing: a record is a line of Spark's text writer whose line end is the blank
lines that end a WARC record, so archives are written by ordinary, committed
tasks to whatever store the path names. Of records with equal payloads the one
with the smallest page id is a response, the others are revisits.

Reading: archives are split at the magic ``WARC/1.0``, wherever it stands. Each
piece is a candidate record; its headers name its length and so the offset of
its successor. Offsets come from prefix sums of piece lengths in a file. The
chain from the start of each file is followed by pointer jumping: every round
doubles the step, and only candidates that the chain meets are records, so a
magic inside a payload is never taken for one. Payloads that hold the magic are
put together from their pieces.

Edge cases: a null html is an empty payload, a null url has no header, a null
page id no id header; such rows are written and read like others. Line ends in
urls are percent-encoded. Rows that repeat a page id and payload are all of the
first one's kind. No pages give no records. A file whose chain does not end at
its length is an error, never a shorter result. Clashing columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmine.llm.common import let, stage
from flowmine.session import shared_folder

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
#: Revisits are looked up in a broadcast table up to this many, and joined by shuffle beyond it.
BROADCAST_REVISITS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes, which is taken once."""
    return let(F.sha1(payload), _base32)


def _base32(digits: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    def nibble(at: Column) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substring(digits, at + 1, F.lit(1))) - 1

    def letter(i: int) -> Column:
        first = F.lit(5 * i // 4)
        both = nibble(first) * 16 + nibble(first + 1)
        return F.substring(F.lit(BASE32), F.pmod(F.shiftright(both, 3 - 5 * i % 4), F.lit(32)) + 1, F.lit(1))

    return F.concat(*[letter(i) for i in range(32)])


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"))
    facts = stage(rows.select("page_id", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("n")))
    firsts = facts.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    revisits = stage(facts.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
                     .select(F.col("page_id").alias("again"), F.col("digest").alias("its_digest"), "first").distinct())
    digested = rows.withColumn("digest", base32_sha1(F.col("html")))
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    judged = digested.join(revisits, (F.col("digest") == F.col("its_digest"))
                           & F.col("page_id").eqNullSafe(F.col("again")), "left")
    revisit = F.col("its_digest").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit(BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _urn(F.col("first"), F.col("digest")))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("X-Refers-To-Page", F.when(revisit, F.col("first").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK))
    judged.select(F.concat(head, block).alias("value")).write.option("lineSep", BLANK).text(path)


def _field(head: str, name: str) -> Column:
    """A header's value; null where the header is absent."""
    found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col(head)), rf"\r\n{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of pieces (column value: all behind the magic), and the payload of whole ones."""
    rows = pieces.withColumn("head", F.substring_index("value", BLANK, 1)).withColumn("size", F.octet_length("value"))
    rows = (rows.withColumn("block_bytes", _field("head", "Content-Length").try_cast("long"))
            .withColumn("record_bytes", F.lit(len(MAGIC)) + F.octet_length("head") + 4 + F.col("block_bytes") + 4))
    whole = (F.col("record_bytes") == F.col("size") + len(MAGIC)) & F.endswith("value", F.lit(BLANK))
    block = F.substring(F.col("value"), F.length("head") + 5, F.length("value") - F.length("head") - 8)
    rows = rows.withColumn("block", F.when(whole, block))
    http = F.substring_index("block", BLANK, 1)
    payload = F.substring(F.col("block"), F.length(http) + 5, F.length("block"))
    revisit = _field("head", "WARC-Type") == "revisit"
    rows = rows.withColumn("http", http)
    return rows.select(
        *[c for c in pieces.columns if c != "value"], "size", "record_bytes", whole.alias("whole"),
        _field("head", "X-Page-ID").try_cast("long").alias("page_id"),
        F.when(revisit, _field("http", "Content-Length").try_cast("long"))
        .otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(_field("head", "WARC-Payload-Digest"), ":", -1))
        .otherwise(base32_sha1(payload)).alias("payload_digest"),
        _field("head", "WARC-Type").alias("record_type"),
        _field("head", "X-Refers-To-Page").try_cast("long").alias("refers_to"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics with its place: file, block of the file, order in the block."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.monotonically_increasing_id().alias("nth"), "value")


def _offsets(pieces: DataFrame) -> DataFrame:
    """Offset of the magic before each piece: lengths summed in a block, and over the blocks before it."""
    span = F.col("size") + len(MAGIC)
    block = Window.partitionBy("file", "start")
    inside = block.orderBy("nth")
    totals = pieces.groupBy("file", "start").agg(F.sum(span).alias("total"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "start", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return (pieces.withColumn("rank", F.row_number().over(inside))
            .withColumn("inner", F.coalesce(F.sum(span).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .join(bases, ["file", "start"])
            .withColumn("offset", F.col("base") + F.col("inner") - len(MAGIC)).drop("base", "inner", "nth"))


def reachable(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0 of each file, by pointer jumping.

    ``links`` has file, offset and next. After k rounds ``next`` jumps 2^k
    records and the first 2^k records of each file are known.
    """
    now = stage(links.select("file", "offset", "next", (F.col("offset") == 0).alias("on")))
    known = now.filter("on").count()
    for _ in range(max_rounds):
        jumps = now.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        met = now.filter("on").select("file", F.col("next").alias("offset"), F.lit(True).alias("met"))
        now = stage(now.join(met, ["file", "offset"], "left").join(jumps, ["file", "next"], "left")
                    .select("file", "offset", F.coalesce("after", "next").alias("next"),
                            (F.col("on") | F.col("met").isNotNull()).alias("on")))
        last, known = known, now.filter("on").count()
        if known == last:
            return now.filter("on").select("file", "offset", F.col("next").alias("end"))
    raise RuntimeError("a chain of records does not end")


RECORD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    places = stage(_offsets(_parsed(_pieces(spark, path))))
    links = places.filter((F.col("offset") >= 0) & F.col("record_bytes").isNotNull()) \
        .select("file", "offset", (F.col("offset") + F.col("record_bytes")).alias("next"))
    on_chain = reachable(links)
    lengths = places.groupBy("file").agg(F.max(F.col("offset") + len(MAGIC) + F.col("size")).alias("length"))
    ends = on_chain.groupBy("file").agg(F.max("end").alias("end"))
    broken = lengths.filter("length > 0").join(ends, "file", "left").filter("end is null or end <> length").count()
    if broken:
        raise ValueError(f"the records of {broken} archive files do not chain up to the end of the file")
    records = places.join(on_chain.select("file", "offset", F.lit(True).alias("record")), ["file", "offset"], "left")
    whole = records.filter("record and whole").select(*RECORD)
    split = records.filter("record and not whole").select("file", "offset")
    if split.isEmpty():
        return whole
    return whole.unionAll(_put_together(spark, path, records, split))


def _put_together(spark: SparkSession, path: str, records: DataFrame, split: DataFrame) -> DataFrame:
    """Records whose payloads hold the magic, from all their pieces."""
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = records.withColumn("owner", F.max(F.when(F.col("record"), F.col("offset"))).over(before))
    wanted = owned.join(split.withColumnRenamed("offset", "owner"), ["file", "owner"]) \
        .select("file", "start", "rank", "offset", "owner")
    again = _pieces(spark, path).join(wanted.select("file", "start").distinct(), ["file", "start"])
    ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("file", "start").orderBy("nth")))
    joined = (ranked.join(wanted, ["file", "start", "rank"]).groupBy("file", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
              .select("file", "owner", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value")))
    return _parsed(joined).select(*RECORD)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and return the records read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
