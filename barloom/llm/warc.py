"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

The reader splits archives at every blank line followed by the version line, so
wherever a record could begin, also inside payloads. Each candidate's header says
where its successor would begin. A candidate is a record only if the chain of
successors from the file's start reaches it; reachability is found for all files
at once by pointer jumping, doubling the length of the jumps each round. Pieces
that no chain reaches belong to the payload of the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import fresh_path, maybe_broadcast, staged

VERSION = "WARC/1.1\r\n"
#: How the version lines of WARC/1.0 and 1.1 begin; the minor digit stays with the record.
MAGIC = "WARC/1."
BLANK = "\r\n\r\n"
#: What stands between the end of a record's block and the minor digit of the next record's version.
SEPARATOR = BLANK + MAGIC
#: Payloads below this many bytes are never written as revisits.
SMALL = 1000


def record_types(df: DataFrame, id_col: str, payload: Column, small: int = SMALL) -> DataFrame:
    """Ids of rows whose payload another row with a larger id holds too: id_col and refers_to (the largest)."""
    narrow = staged(df.select(id_col, F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")), "digests").filter(F.col("size") >= small)
    several = narrow.groupBy("digest", "size").agg(F.max(id_col).alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = staged(several, "repeated")
    repeated = narrow.join(maybe_broadcast(several, several.count(), 80), ["digest", "size"]).filter(F.col(id_col) < F.col("refers_to"))
    return repeated.select(id_col, "refers_to")


def _header(lines: list[Column]) -> Column:
    return F.concat_ws("\r\n", *lines)


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", small: int = SMALL, records_per_file: int = 4096, compression: str = "gzip") -> None:
    """One response or revisit record per row. Texts are not shuffled unless repeated payloads are very many.

    Null payloads are empty, null urls become urn:page:<id>. Of rows with equal
    payloads of at least ``small`` bytes that with the largest id is the response;
    rows with null ids are always responses, and records of repeated rows repeat.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    revisits = staged(record_types(df.select(id_col, payload_col), id_col, payload, small).distinct(), "revisits")
    revisits = maybe_broadcast(revisits.withColumnRenamed(id_col, "_id"), revisits.count(), 40)
    rows = df.select(id_col, F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = rows.join(revisits, rows[id_col] == revisits["_id"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    url = F.coalesce(F.regexp_replace("_url", r"[\r\n]", "%0A"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_payload").cast("string"), F.lit(BLANK))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = _header(
        [
            F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), F.coalesce(name(F.col(id_col)), F.lit("<urn:page:>"))),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1("_payload")),
            F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to"))),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
    )
    record = F.concat(F.lit(VERSION), head, F.lit(BLANK), block)
    rows.select(record.alias("value")).write.option("lineSep", BLANK).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _bytes_after(data: Column, skip: Column) -> Column:
    return F.substring(data, skip + 1, F.octet_length(data))


def pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Archives cut wherever a record could begin: (seq, file, piece), and the candidates (seq, file, at, succ, total).

    at is the byte offset in the (unpacked) file; succ, where the successor would
    begin that the candidate's header announces, null where it announces none; total,
    the file's bytes.
    """
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("piece"),
    )
    # A header ends at its first blank line, or with the piece where the payload itself begins with a version line.
    head = F.substring_index(F.col("piece").cast("string"), BLANK, 1)
    stated = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *(\d{1,18})(?:\r\n|$)", 1)
    length = F.octet_length(head) + len(BLANK) + stated.try_cast("bigint") + len(BLANK)
    lines = staged(lines.withColumns({"size": F.octet_length("piece").cast("long"), "length": length}), "pieces")
    in_block = W.partitionBy("file", "block").orderBy("seq")
    narrow = lines.select("file", "block", "seq", "size", "length").withColumn("upto", F.sum(F.col("size") + len(SEPARATOR)).over(in_block))
    blocks = narrow.groupBy("file", "block").agg(F.max("upto").alias("all"))
    offset = F.sum("all").over(W.partitionBy("file").orderBy("block")) - F.col("all")
    # No separator follows a file's last piece.
    total = F.sum("all").over(W.partitionBy("file")) - len(SEPARATOR)
    blocks = blocks.select("file", "block", offset.alias("offset"), total.alias("total"))
    placed = narrow.join(blocks.hint("merge"), ["file", "block"])
    # Offsets are those of version lines; a file begins with one that no separator cuts off.
    start = F.col("offset") + F.col("upto") - F.col("size") - len(MAGIC) - len(SEPARATOR)
    first = (F.col("offset") + F.col("upto")) == F.col("size") + len(SEPARATOR)
    at = F.when(first, F.lit(0)).otherwise(start)
    ahead = F.when(first, 0).otherwise(len(MAGIC))
    placed = placed.select("seq", "file", at.alias("at"), (at + ahead + F.col("length")).alias("succ"), "total")
    return lines.select("seq", "file", "piece"), staged(placed, "placed")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, succ) on the chain from offset 0 of their file, by pointer jumping."""
    table = staged(candidates.select("file", "at", F.col("succ").alias("jump"), (F.col("at") == 0).alias("reached")), "jumps")
    known = -1
    while (count := table.filter("reached").count()) > known:
        known = count
        hit = table.filter("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        far = table.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        # These tables compress to little on disk but not in memory, so they are never broadcast.
        table = table.join(hit.hint("merge"), ["file", "at"], "left").join(far.hint("merge"), ["file", "jump"], "left")
        table = staged(table.select("file", "at", F.col("far").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "jumps")
    return table.filter("reached").select("file", "at")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per record: file, offset, type, record_id, target_uri, refers_to, payload_digest (as written), payload.

    Archives are WARC/1.0 or 1.1. Version lines inside payloads are not records.
    Where a file's chain doesn't end with the file (it is cut short or damaged),
    ValueError is raised, or, if not strict, its records end there; what follows
    belongs to the last one and is left out. An empty folder of archives gives
    no rows. Only records whose payload holds version lines are put together from
    several pieces, which is a shuffle of those records alone.
    """
    lines, placed = pieces(spark, path)
    chain = reachable(placed).withColumn("real", F.lit(True))
    owner = F.max(F.when(F.col("real"), F.col("at"))).over(W.partitionBy("file").orderBy("at"))
    marked = staged(placed.join(chain.hint("merge"), ["file", "at"], "left").withColumn("owner", owner), "owners")
    if strict:
        ends = marked.groupBy("file").agg(F.max_by(F.when(F.col("real"), F.col("succ")), F.when(F.col("real"), F.col("at"))).alias("end"), F.max("total").alias("total"))
        bad = ends.filter(~F.col("end").eqNullSafe(F.col("total"))).agg(F.count("*").alias("n"), F.min_by(F.struct("file", "end", "total"), "file").alias("first")).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} archives end before or after their last record, such as {bad['first']['file']}: {bad['first']['total']} bytes, records up to {bad['first']['end']}")
    false = marked.filter("real IS NULL").select("file", F.coalesce("owner", F.lit(-1)).alias("owner")).distinct()
    broken = marked.select("seq", "file", "at", F.coalesce("owner", F.lit(-1)).alias("owner")).join(false, ["file", "owner"], "left_semi")
    broken = staged(broken, "broken")
    if n_broken := broken.count():
        parts = lines.drop("file").join(maybe_broadcast(broken, n_broken, 200), "seq").filter("owner >= 0")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("hex")))), lambda p: p["hex"]), SEPARATOR.encode().hex())
        built = parts.groupBy("file", "owner").agg(F.unhex(joined).alias("piece"))
        lines = lines.join(maybe_broadcast(broken.select("seq"), n_broken, 16), "seq", "left_anti")
        lines = lines.select("file", "piece").unionByName(built.select("file", "piece"))
    text = F.col("piece").cast("string")
    head = F.substring_index(text, BLANK, 1)
    field = lambda n: F.nullif(F.trim(F.regexp_extract(head, rf"(?i)(?:^|\r\n){n}: *([^\r\n]*)", 1)), F.lit(""))
    rows = lines.withColumn("_head", F.octet_length(head) + len(BLANK))
    rows = rows.withColumn("_block", F.substring(F.col("piece"), F.col("_head") + 1, field("Content-Length").cast("int")))
    http = F.octet_length(F.substring_index(F.col("_block").cast("string"), BLANK, 1)) + len(BLANK)
    payload = F.when(F.startswith(F.col("_block"), F.lit(b"HTTP/")), _bytes_after(F.col("_block"), http)).otherwise(F.col("_block"))
    return rows.select(
        "file",
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        payload.alias("payload"),
    )


def archive(df: DataFrame, **options: object) -> DataFrame:
    """df written as archives to the shared folder and read back."""
    path = fresh_path(df.sparkSession, "warc")
    write(df, path, **options)
    return read(df.sparkSession, path)


def page_id(record_id: str | Column) -> Column:
    """The number in a record id <urn:page:N>; null if there is none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
