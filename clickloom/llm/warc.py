"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, joined back.

``write_archive`` leaves two tables in a folder: ``headers`` (one row per record: the exact header
block and the address of its payload) and ``payloads`` (one row per address). The address is SHA-256
and byte length; at writing the copies of an address must agree in a second digest, and at reading the
stored bytes must give their address again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import hot_join
from clickloom.state import new_path, settle

CRLF = "\r\n"
# base32 alphabet, and the fields of a WARC record header.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit hex digest: four groups of 40 bits, eight letters each."""
    letters = []
    for g in range(4):
        number = F.conv(F.substring(hex_digest, 10 * g + 1, 10), 16, 10).cast("bigint")
        for k in range(7, -1, -1):
            five = F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(BASE32), five + 1, F.lit(1)))
    return F.concat(*letters)


def _uri(url: Column) -> Column:
    """The url with blanks and control characters percent-encoded, as a header line needs it."""
    out = url
    for code in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike("[\\x00-\\x20\\x7f]"), out).otherwise(url)


def _record_name(page_id: Column, url: Column, copy: Column) -> Column:
    """What names a record: its page, a hash of url and payload address, its number among equal rows."""
    return F.concat_ws("-", F.coalesce(page_id.cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64(url, "address"))), copy.cast("string"))


def _header(min_bytes: int) -> Column:
    is_response = F.col("record_type") == "response"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("record"), F.lit(">")),
        F.lit(f"WARC-Date: {NO_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.coalesce("url", F.lit("")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1_base32")),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_record"), F.lit(">"))),
        F.when(~is_response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_response, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archive every row of ``pages``.

    Payload: the html in UTF-8, null as no bytes. Of records with equal payloads of at least
    ``min_bytes`` bytes the one with the smallest id (null last, then url) is a response and the
    others are revisits of it; smaller ones are all responses. Rows equal in id, url and payload are
    records of their own: the first is counted as smaller.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    wide = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("bytes"),
    )
    # Equal rows meet in one group with their number; no payload is moved for this.
    slim = wide.groupBy("page_id", "url", "address", "sha1", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    slim = settle(slim, "warc_rows")
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    per_address = settle(
        slim.groupBy("address").agg(
            F.min(place).alias("first"), F.sum("copies").alias("records"), F.count(F.lit(1)).alias("n"),
            F.min("sha1").alias("sha1_a"), F.max("sha1").alias("sha1_b"), F.min("bytes").alias("bytes_a"), F.max("bytes").alias("bytes_b"),
        ),
        "warc_addresses",
    )
    checked = per_address.withColumn(
        "first",
        F.when((F.col("sha1_a") == F.col("sha1_b")) & (F.col("bytes_a") == F.col("bytes_b")), F.col("first"))
        .otherwise(F.raise_error(F.lit("two payloads share one address"))),
    ).select("address", "first", "n")

    with_first = hot_join(slim, checked, ["address"], "n", ["page_id", "url"])
    records = with_first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    is_first = (place == F.col("first")) & (F.col("copy") == 1)
    name = _record_name(F.col("page_id"), F.col("url"), F.col("copy"))
    first_name = _record_name(F.col("first.page_id"), F.col("first.url"), F.lit(1))
    typed = records.select(
        "page_id", "url", "address", "bytes", base32(F.col("sha1")).alias("sha1_base32"),
        F.when((F.col("bytes") < min_bytes) | is_first, "response").otherwise("revisit").alias("record_type"),
        name.alias("record"), first_name.alias("refers_record"), F.col("first.page_id").alias("first_id"),
    )
    headers = typed.select(_header(min_bytes).alias("header"), "address", F.col("bytes").alias("payload_bytes"))
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")

    # One row per address keeps its bytes: a payload moves only with the row chosen for it.
    firsts = checked.select("address", "first.page_id", "first.url").withColumn("key", F.xxhash64("address", "page_id", "url"))
    candidates = wide.select("address", "payload", F.xxhash64("address", "page_id", "url").alias("key"))
    stored = (
        candidates.join(firsts.select(F.col("address").alias("a"), F.col("key").alias("k")), (F.col("key") == F.col("k")) & (F.col("address") == F.col("a")))
        .select("address", "payload", F.row_number().over(Window.partitionBy("key", "address").orderBy(F.lit(0))).alias("nth"))
        .where("nth = 1")
        .select("address", "payload")
    )
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: ``header``, ``payload`` (the full payload, of revisits too), ``payload_bytes``.

    Stored bytes that do not give their address again stop the job.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("address")
    verified = stored.select(
        "address", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its address"))).alias("payload")
    )
    counts = headers.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    # Counts are joined only to find hot addresses, whose few payloads are then spread by key.
    return _with_payload(headers, verified, counts)


def _with_payload(headers: DataFrame, stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Join headers to payloads; a payload used by many records is repeated under several sub-keys.

    A payload can be long, so it is not broadcast: one used by n records gets one copy per 5,000 of
    them, and the records are dealt over the copies.
    """
    per = 5000
    many = counts.where(F.col("n") > per).withColumn("deal", F.ceil(F.col("n") / F.lit(per)).cast("int"))
    many = settle(many.select("address", "deal"), "warc_hot")
    total = headers.count()
    assert many.count() <= max(1, total // per)  # one entry of 70 bytes for each 5,000 records
    marked = hot_join(headers, many.withColumn("n", F.col("deal").cast("bigint") * per), ["address"], "n", ["header"], "left")
    dealt = marked.withColumn("deal", F.pmod(F.xxhash64("header"), F.coalesce("deal", F.lit(1))).cast("int"))
    copies = stored.join(many.withColumnRenamed("deal", "of"), "address", "left").withColumn(
        "deal", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))
    )
    return dealt.join(copies.select("address", "deal", "payload"), ["address", "deal"]).select("header", "payload", "payload_bytes")


def header_field(name: str) -> Column:
    value = F.regexp_extract("header", f"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(value == "", None).otherwise(value)


def records(archive: DataFrame) -> DataFrame:
    """What the records of an archive say: (page_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    def page(field: str) -> Column:
        return F.regexp_extract(header_field(field), "urn:page:(-?\\d+)-", 1).try_cast("bigint")

    return archive.select(
        page("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "header", "payload",
    )


def export_warc(archive: DataFrame, path: str) -> None:
    """Write plain WARC files: header block, block, two line ends. Revisits have an empty block."""
    block = F.when(F.col("header").contains("WARC-Type: revisit"), "").otherwise(F.decode("payload", "UTF-8"))
    archive.select(F.concat("header", block).alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).text(path)


def new_archive(spark: SparkSession) -> str:
    return new_path(spark, "warc")
