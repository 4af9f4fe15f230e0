"""Web archives and their fixity: WARC files written and read by Spark, and a Merkle audit of their replicas.

Pages become WARC resource records; archives hold ``RECORDS`` pages each, in order. Reading an archive gives every
record's offset, length and SHA-256. The records of an archive, in order of offset, are the leaves of a tree: ranges
of ``RANGE`` bytes of offsets hash their records, ``FANOUT`` neighbouring ranges hash to the range above, up to one root
per archive. An audit compares the roots of two replicas and descends into the children of nodes that differ only, down
to the records of differing ranges. There, records of equal hash are the same ones, wherever they lie now; of the others
those of one id (or url, where that is null) or one offset are changed, and what is left is missing or in excess.

What cannot be read does not end an audit. Where a record's header is broken, the bytes up to the next record are one
record without id and url; where a file cannot be unpacked to its end, its packed bytes are one such record, of length 0
behind what could be read.

Defined cases: a null page is an empty payload, a null url an empty one; pages with a null id go to archives of
negative number by a hash of their url and page; rows that repeat an id follow each other in one archive; an archive
that one replica lacks differs as a whole; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import column, landed, map_arrow

RECORDS = 500
RANGE = 1 << 16
FANOUT = 8
_END = "\r\n\r\n"
_START = "WARC/1.1\r\nWARC-Type: resource\r\n"


def archive_number(page_id: Column, url: Column, html: Column, records: int) -> Column:
    hashed = -1 - F.pmod(F.xxhash64(url, html), F.lit(1 << 20))
    return F.coalesce(F.floor(page_id.cast("long") / records), hashed)


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC record without the two line ends that close it."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(_START + "WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)


def write_archives(pages: DataFrame, path: str, records: int = RECORDS, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages as WARC files, one for each archive, in order of page id, below ``path``."""
    _write(_dealt(pages, F.lit(False), records, page_id, url, html), path)


def _dealt(pages: DataFrame, wrong: Column, records: int, page_id: str, url: str, html: str) -> DataFrame:
    """(archive, id, tie, url, html, wrong): the pages, those of one archive in one task; ``tie`` orders pages of one id."""
    p, u, h = column(page_id), column(url), column(html)
    return pages.select(
        archive_number(p, u, h, records).alias("archive"), p.alias("id"), F.xxhash64(u, h).alias("tie"),
        u.alias("url"), h.alias("html"), wrong.alias("wrong")).repartition("archive")


def _write(dealt: DataFrame, path: str, *folders: str) -> None:
    """Write dealt pages as WARC files, one for each archive, below a folder for each value of the columns ``folders``."""
    by = [*folders, "archive"]
    rows = dealt.select(*by, "id", "tie", record_text(F.col("id"), F.col("url"), F.col("html")).alias("value"))
    ordered = rows.sortWithinPartitions(*by, "id", "tie").select(*by, "value")
    ordered.write.partitionBy(*by).option("lineSep", _END).option("compression", "gzip").text(path)


def _unpacked(packed: bytes) -> tuple[bytes, bool]:
    """The content of a file of one or more gzip members as far as it can be unpacked, and whether that is all."""
    parts, rest = [], packed
    while rest:
        unpack = zlib.decompressobj(31)
        try:
            parts.append(unpack.decompress(rest) + unpack.flush())
        except zlib.error:  # again in short steps, to keep what comes before the damage
            unpack = zlib.decompressobj(31)
            try:
                for i in range(len(rest)):
                    parts.append(unpack.decompress(rest[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), False
        if not unpack.eof:
            return b"".join(parts), False
        rest = unpack.unused_data
    return b"".join(parts), True


def _records(data: bytes) -> Iterator[tuple]:
    """Offset, length, page_id, url and hash of each record; page_id and url are null where it cannot be read."""
    at, close = 0, _END.encode()
    while at < len(data):
        number = url = None
        try:
            body = data.index(close, at) + 4
            lines = data[at : body - 4].split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines[1:])
            size = int(fields[b"Content-Length"])
            end = body + size + 4
            if not lines[0].startswith(b"WARC/") or size < 0 or data[end - 4 : end] != close:
                raise ValueError("not a record")
            name, url = fields[b"WARC-Record-ID"], fields[b"WARC-Target-URI"].decode()
            if not (name.startswith(b"<urn:page:") and name.endswith(b">")):
                raise ValueError("not a record id")
            number = int(name[10:-1]) if name[10:-1] else None
            if number is not None and not -(1 << 63) <= number < 1 << 63:
                raise ValueError("not a page id")
        except (KeyError, ValueError):
            number = url = None
            following = data.find(close + _START.encode(), at)
            end = following + 4 if following >= 0 else len(data)
        yield at, end - at, number, url, hashlib.sha256(data[at:end]).hexdigest()
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: archive, offset, length (closing line ends included), page_id, url, sha256."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                packed = content.as_py()
                data, whole = _unpacked(packed)
                rows = [(archive, *record) for record in _records(data)]
                if not whole:
                    rows.append((archive, len(data), 0, None, None, hashlib.sha256(packed).hexdigest()))
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "offset", "length", "page_id", "url", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return map_arrow(
        files.select(F.col("archive").cast("long").alias("archive"), "content"), parse,
        "archive long, offset long, length long, page_id long, url string, sha256 string")


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of nodes (archive, node, hash), leaf ranges first."""

    def hashed(rows: DataFrame, key: str) -> DataFrame:
        inside = F.array_sort(F.collect_list(F.struct(key, "hash")))
        return rows.groupBy("archive", "node").agg(F.sha2(F.array_join(F.transform(inside, lambda x: x["hash"]), ""), 256).alias("hash"))

    leaves = records.select("archive", "offset", F.col("sha256").alias("hash"), F.floor(F.col("offset") / range_bytes).alias("node"))
    result = [landed(hashed(leaves, "offset"), "ranges")]
    for _ in range(levels):
        above = result[-1].select("archive", F.col("node").alias("child"), "hash", F.floor(F.col("node") / fanout).alias("node"))
        result.append(hashed(above, "child"))
    return result


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Records of replicas (as ``read_archives`` gives them) that differ: archive, offset, state (changed, missing, extra).

    Offsets are those of ``left``, for extra records those of ``right``.
    """
    farthest = max((r[0] or 0) for df in (left, right) for r in df.agg(F.max("offset")).collect())
    levels, reach = 0, farthest // range_bytes
    while reach:
        reach //= fanout
        levels += 1
    ours, theirs = tree(left, levels, range_bytes, fanout), tree(right, levels, range_bytes, fanout)
    suspects = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        if suspects is not None:  # only children of nodes that differ
            below = lambda level: level.withColumn("up", F.floor(F.col("node") / fanout)).join(
                suspects.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi").drop("up")  # noqa: B023
            a, b = below(a), below(b)
        both = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), ["archive", "node"], "full_outer")
        suspects = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node")
    suspects = landed(suspects, "suspect-ranges")

    def inside(records: DataFrame, name: str) -> DataFrame:
        mark = F.coalesce(F.concat(F.lit("id "), F.col("page_id").cast("string")), F.concat(F.lit("url "), F.col("url")))
        rows = records.select(
            "archive", F.col("offset").alias(name), "sha256", mark.alias("mark"), F.floor(F.col("offset") / range_bytes).alias("node"))
        return rows.join(suspects, ["archive", "node"], "left_semi").drop("node")

    def paired(ours: DataFrame, theirs: DataFrame, key: Column) -> DataFrame:
        """Both sides in rows (archive, x, mark_x, y, mark_y); records of one key meet in their order."""
        sides = []
        for rows, name in ((ours, "x"), (theirs, "y")):
            once = Window.partitionBy("archive", "key").orderBy(name)
            keyed = rows.withColumn("key", key).withColumn("nth", F.when(F.col("key").isNotNull(), F.row_number().over(once)))
            sides.append(keyed.select("archive", "key", "nth", name, F.col("mark").alias(f"mark_{name}")))
        return sides[0].join(sides[1], ["archive", "key", "nth"], "full_outer").drop("key", "nth")

    def unpaired(rows: DataFrame, name: str) -> DataFrame:
        other = "y" if name == "x" else "x"
        return rows.filter(F.col(other).isNull()).select("archive", name, F.col(f"mark_{name}").alias("mark"))

    equal = landed(paired(inside(left, "x"), inside(right, "y"), F.col("sha256")), "equal-records")
    named = landed(paired(unpaired(equal, "x"), unpaired(equal, "y"), F.col("mark")), "named-records")
    a, b = unpaired(named, "x").withColumn("at", F.col("x")), unpaired(named, "y").withColumn("at", F.col("y"))
    placed = a.drop("mark").join(b.drop("mark"), ["archive", "at"], "full_outer").select("archive", "x", "y")
    found = named.filter("x is not null and y is not null").select("archive", "x", "y").unionByName(placed)
    state = F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").otherwise("changed")
    return found.select("archive", F.coalesce("x", "y").alias("offset"), state.alias("state"))


def audited(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Every record of the archives below ``first``, with its state in the replica below ``second``."""
    ours, theirs = landed(read_archives(spark, first), "records"), landed(read_archives(spark, second), "records")
    found = landed(audit(ours, theirs), "differences")
    return ours.join(found.filter("state <> 'extra'"), ["archive", "offset"], "left").withColumn("state", F.coalesce("state", F.lit("intact")))


def replicated(pages: DataFrame, damage: Column, html: str = "html") -> tuple[str, str]:
    """Two replicas of the pages as archives; in the second the first character of pages under ``damage`` is wrong.

    Pages are shuffled once: the task that holds an archive's pages writes them to both replicas.
    """
    path = fresh_path(pages.sparkSession, "replicas")
    dealt = _dealt(pages, damage & (F.char_length(column(html)) > 0), RECORDS, "page_id", "url", html)
    twice = dealt.withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1))))
    wrong = F.when((F.col("replica") == 1) & F.col("wrong"), F.overlay("html", F.lit("~"), F.lit(1)))
    _write(twice.withColumn("html", F.coalesce(wrong, "html")), path, "replica")
    return f"{path}/replica=0", f"{path}/replica=1"
