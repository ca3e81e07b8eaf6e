"""WARC archives as Spark tables: writing with revisits, and reading by boundary-chain verification.

Writing: one text row is one record, and the row separator is the two line ends that close a record, so Spark's own
writer makes the files, on any store.

Reading: files are cut at every magic `WARC/1.0` line, in parallel splits. Each piece is a candidate record; its
header names the offset of its successor. Inside a split, candidates are chained to the first offset beyond it; these
exits are joined by pointer jumping, from the start of each file, in rounds that double the jump. Only records on
that chain are real: a magic inside a payload is on no chain, and its piece belongs to the record around it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, new_path, salted, sized, stage, stream_groups

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELDS = "record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, stated_digest string"
_PIECE = f"file string, block long, seq long, rel long, length long, span long, {_FIELDS}"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 5 hexadecimal digits are 4 base32 digits."""
    digest, out = F.sha1(payload.cast("binary")), []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row. Of equal payloads of at least least_bytes bytes, the smallest id's is a response and the
    others are revisits without payload. Null html: empty payload; null url: no target; null ids and rows that repeat
    the smallest id stay responses."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": sha1_base32(F.col("html"))})
    known = stage(p.select("page_id", "bytes", "digest").filter(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes)), "warc-digests")
    first = known.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top")).filter("refers_to < top").drop("top")
    # One payload may be that of very many pages, so its look-up is dealt to several tasks.
    again = stage(salted(known, first, ["digest", "bytes"], ["page_id"], 96).filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    p = p.join(sized(again, 64), ["page_id", "digest"], "left")
    revisit, nl = F.col("refers_to").isNotNull(), F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), nl, nl)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size),
    ]
    p.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), nl, nl, block).alias("value")).write.option("lineSep", END).text(path)
    drop_staged(known, again)


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)
_URN = re.compile(rb"<urn:page:(-?\d+)>")


def _parse(piece: bytes) -> tuple[int | None, tuple]:
    """Bytes from the record's magic to its successor, and its fields; None for what has no record header.

    A payload that goes beyond the piece leaves digest and bytes null.
    """
    head, mark, block = piece.partition(b"\r\n\r\n")
    field = {k.lower(): v for k, v in _FIELD.findall(head)}
    if not mark or not field.get(b"content-length", b"").isdigit() or b"warc-type" not in field:
        return None, (None,) * 7
    size = int(field[b"content-length"])
    span = len(MAGIC) + len(head) + 4 + size + len(END)
    kind, stated = field[b"warc-type"].decode("utf-8", "replace"), field.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    ids = [int(m[1]) if (m := _URN.fullmatch(field.get(k, b""))) else None for k in (b"warc-record-id", b"warc-refers-to")]
    url = field[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in field else None
    if kind == "revisit":
        http = {k.lower(): v for k, v in _FIELD.findall(block[:size].partition(b"\r\n\r\n")[0])}
        n, digest = int(http.get(b"content-length", b"0") or 0), stated
    elif len(block) < size:
        n = digest = None
    else:
        payload = block[:size].partition(b"\r\n\r\n")[2]
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return span, (kind, ids[0], url, ids[1], n, digest, stated)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a split's pieces, with their places relative to the split's first."""
    at, seq, rel = None, 0, 0
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("rel", pa.int64()), ("length", pa.int64()), ("span", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string())])
    for batch in batches:
        rows = []
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != at:
                at, seq, rel = (file, block), 0, 0
            span, fields = _parse(value)
            rows.append((file, block, seq, rel, len(value), span, *fields))
            seq, rel = seq + 1, rel + len(value) + len(MAGIC)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, seq = None, 0
    for batch in batches:
        out = []
        for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seq = seq + 1 if (file, block) == at else 0
            at = (file, block)
            out.append(seq)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), batch.column(2)], ["file", "block", "seq", "value"])


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each candidate of a split, the first offset beyond the split's candidates that its chain leads to."""
    for _, g in stream_groups(frames, ["file", "block"]):
        offset, after, leads = g["offset"].tolist(), g["after"].tolist(), {}
        for o, s in zip(reversed(offset), reversed(after), strict=True):
            leads[o] = leads.get(s, s)
        yield pd.DataFrame({"file": [g["file"].iloc[0]] * len(g), "offset": offset, "exit": [leads[o] for o in offset]})


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of a split that are on the chain from its entry."""
    for _, g in stream_groups(frames, ["file", "block"]):
        after, entries = dict(zip(g["offset"].tolist(), g["after"].tolist(), strict=True)), g["offset"][g["entry"]].tolist()
        on = []
        for o in entries:
            while o in after:
                on.append(o)
                o = after.pop(o)
        if on:
            yield pd.DataFrame({"file": [g["file"].iloc[0]] * len(on), "offset": on})


def verified(pieces: DataFrame) -> DataFrame:
    """Pieces with their offset, whether they are records, and the record that each belongs to (its offset)."""
    ends = pieces.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("bytes"))
    base = ends.select("file", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = stage(base, "warc-base")
    placed = stage(pieces.join(sized(base, 256), ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel") - len(MAGIC)).filter("offset >= 0").drop("base"), "warc-placed")
    c = placed.filter("span is not null").select("file", "block", "offset", (F.col("offset") + F.col("span")).alias("after"))
    c = c.repartition("file", "block").sortWithinPartitions("file", "block", "offset")
    jump = stage(c.mapInPandas(_exits, "file string, offset long, exit long"), "warc-exits")
    # Only candidates that a chain can enter a split by are needed between splits.
    doors = jump.select("file", F.col("exit").alias("offset")).union(jump.select("file", F.lit(0).cast("long"))).distinct()
    jump = stage(jump.join(doors, ["file", "offset"]), "warc-jumps")
    most = pieces.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    reached = stage(jump.filter("offset = 0").select("file", "offset"), "warc-reached")
    for _ in range(most.bit_length()):
        step = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        new = stage(reached.union(step).distinct(), "warc-reached")
        far = jump.select("file", "offset", F.col("exit").alias("via")).join(jump.select("file", F.col("offset").alias("via"), "exit"), ["file", "via"], "left")
        longer = stage(far.select("file", "offset", F.coalesce("exit", "via").alias("exit")), "warc-jumps")
        drop_staged(reached, jump)
        reached, jump = new, longer
    entry = c.join(reached.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    on = stage(entry.repartition("file", "block").sortWithinPartitions("file", "block", "offset").mapInPandas(_walk, "file string, offset long"), "warc-on")
    drop_staged(reached, jump)
    marked = placed.join(on.withColumn("record", F.lit(True)), ["file", "offset"], "left").withColumn("record", F.coalesce("record", F.lit(False)))
    # A piece belongs to the last record before it: of its own split, else of the last split before that has one.
    inside = F.last(F.when(F.col("record"), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("offset"))
    last = on.join(placed.select("file", "block", "offset"), ["file", "offset"]).groupBy("file", "block").agg(F.max("offset").alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = base.select("file", "block").join(last, ["file", "block"], "left").select("file", "block", carried.alias("ahead"))  # a row a split
    owned = marked.withColumn("inside", inside).join(sized(ahead, 256), ["file", "block"]).withColumn("owner", F.coalesce("inside", "ahead"))
    owned = stage(owned.drop("inside", "ahead"), "warc-owned")
    drop_staged(base, placed, on)
    return owned


def _assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One record out of all its pieces."""
    pdf = pdf.sort_values("offset")
    whole = MAGIC.encode().join(pdf["value"])
    span, fields = _parse(whole)
    return pd.DataFrame([(*key, span, *fields)], columns=["file", "offset", "span", *[f.split()[0] for f in _FIELDS.split(", ")]]).astype({c: "Int64" for c in ("span", "page_id", "refers_to", "payload_bytes")}).astype({c: object for c in ("file", "record_type", "url", "payload_digest", "stated_digest")})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: (file, offset, record_type, page_id, url, refers_to, payload_bytes,
    payload_digest, stated_digest, intact). payload_digest is of the payload as read; a revisit has its stated one.
    intact: the payload has the digest that its record states; null where there is no payload to compare.

    Bytes before a file's first record, and files that do not begin with one, hold no record. A last record that
    its file cuts off has null bytes and digest.
    """
    pieces = stage(_raw(spark, path).mapInArrow(_pieces, _PIECE), "warc-pieces")
    owned = verified(pieces)
    fields = ["file", "offset", *[f.split()[0] for f in _FIELDS.split(", ")]]
    whole = F.col("payload_bytes").isNotNull()
    intact = F.when(F.col("record_type") != "revisit", F.col("payload_digest") == F.col("stated_digest")).alias("intact")
    direct = owned.filter("record").filter(whole).select(*fields)
    broken = owned.filter("record").filter(~whole).select("file", F.col("offset").alias("owner"))
    parts = stage(owned.join(broken, ["file", "owner"], "left_semi").select("file", "block", "seq", "offset", "owner"), "warc-parts")
    if parts.isEmpty():
        drop_staged(pieces)
        return direct.select(*fields, intact)
    again = _raw(spark, path).mapInArrow(_numbered, "file string, block long, seq long, value binary").join(sized(parts, 256), ["file", "block", "seq"])
    joined = again.groupBy("file", "owner").applyInPandas(_assemble, f"file string, offset long, span long, {_FIELDS}")
    return direct.unionByName(joined.select(*fields)).select(*fields, intact)


def warc_query(pages: DataFrame) -> DataFrame:
    """Write all pages to an archive and read it back: one row per page."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
