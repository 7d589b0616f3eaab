"""WARC archives: writing with revisit records, and reading by boundary chains.

Writing: each page becomes a record; Spark's text sink writes the records of a
partition one after the other, byte for byte (the record's last line feed is the
sink's line separator). Pages with equal payloads of some size become one response
and revisits of it.

Reading: the text source cuts the files at the magic ``WARC/1.1`` line, in splits of
any size; the sizes of the cut segments, summed over the splits in file order, give
each segment's byte offset. A segment that starts with a complete header is a
candidate record, and its Content-Length gives the offset where its successor must
begin. Magic inside a payload makes false candidates. Only candidates that a chain of
successors reaches from the start of the file are records: inside a split a task
follows the chains to where they leave it; between splits, pointer jumping doubles
the hops until every split knows where the chain enters it.

Defined results: a null payload is an empty one; a null url has no target header; of
rows with one id and equal payloads each with the smallest id is a response; a null
id is never the smallest unless all are null; an empty table gives no records.
Ids are whole numbers; others raise TypeError. A file
that doesn't begin with a record, or ends within one, gives the records before the
break."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbarium.llm.common import drop, materialize, whole_numbers, workspace

MAGIC = "WARC/1.1\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bits a revisit in the map that is sent to all executors, most bits of the map (64 MB,
#: however many revisits there are), and those of one of its rows.
EACH_BITS, MAP_BITS, ROW_BITS = 64, 1 << 29, 1 << 15


# ------------------------------------------------------------------ writing


def _place(bits: int, *columns: str):
    """The bit of a revisit in the map."""
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def _bits(again: DataFrame, bits: int) -> DataFrame:
    """The map of revisits: (_row, _map), rows without a bit left out."""
    place = _place(bits, "_id", "_mark")
    return again.select(F.floor(place / ROW_BITS).alias("_row"), (place % ROW_BITS).alias("_at")).groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_map"))


def _bit(bits: str, at):
    """Whether the bit is set in a row of the map."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column ``value``: the record of each page, without its last line feed."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "utf-8"), 256)).withColumn("size", F.octet_length("payload").cast("bigint"))
    # of one id, different payloads differ in this part of the digest
    rows = rows.withColumn("mark", F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint"))
    keys, keys_path = materialize(rows.where(F.col("size") >= LEAST_REVISIT).select("id", "digest", "mark"))
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again, _ = materialize(keys.join(first, "digest").where("id is null or id > first").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "first").distinct())
    drop(pages.sparkSession, keys_path)
    # payloads stay where they are read, but for those of revisits and of the few pages that share a bit with one
    bits = min(MAP_BITS, ROW_BITS * (1 + again.count() * EACH_BITS // ROW_BITS))
    place = _place(bits, "id", "mark")
    maybe = rows.join(F.broadcast(_bits(again, bits)), F.floor(place / ROW_BITS) == F.col("_row"), "left")
    maybe = maybe.withColumn("_maybe", F.coalesce((F.col("size") >= LEAST_REVISIT) & _bit("_map", place % ROW_BITS), F.lit(False))).drop("_row", "_map")
    sure = maybe.where("not _maybe").withColumn("first", F.lit(None).cast("bigint"))
    asked = maybe.where("_maybe")
    asked = asked.join(again.hint("merge"), asked["id"].eqNullSafe(again["_id"]) & (asked["mark"] == again["_mark"]), "left").drop("_id", "_mark")
    rows = sure.unionByName(asked)
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit("\r\n"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", "\n").text(path)


# ------------------------------------------------------------------ reading

_FIELDS = {b"warc-type": "type", b"warc-record-id": "record_id", b"warc-refers-to": "refers_to", b"warc-target-uri": "uri", b"warc-payload-digest": "digest"}
CANDIDATE = "path string, block bigint, rel bigint, next bigint, type string, record_id string, refers_to string, uri string, digest string, payload_bytes bigint, payload_digest string, begin bigint"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value): what lies between the magic lines, split by split. The
    first segment of a file is what comes before its first magic."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


class _Places:
    """Offsets of segments from the first of their split, which is where it began to
    read: rows of a split come in file order."""

    def __init__(self):
        self.split, self.at, self.first = None, 0, False

    def step(self, path: str, block: int, size: int) -> tuple[int, bool]:
        """(offset of the segment, whether it follows a magic line)."""
        if (path, block) != self.split:
            self.split, self.at, self.first = (path, block), 0, block == 0
        place, led = self.at, not self.first
        self.at += size + len(MAGIC)
        self.first = False
        return place, led


def _header(value: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, size of the header, Content-Length) of a segment after its magic."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields, length = {}, None
    for row in value[:end].split(b"\r\n"):
        key, colon, rest = row.partition(b":")
        if not colon:
            return None
        key, rest = key.strip().lower(), rest.strip()
        if key == b"content-length":
            if not rest.isdigit():
                return None
            length = int(rest)
        elif key in _FIELDS:
            fields[_FIELDS[key]] = rest.decode("utf-8", "replace")
    return None if length is None or "type" not in fields else (fields, end + 4, length)


def candidates(parts: DataFrame) -> DataFrame:
    """A row for each segment that begins with a header. ``rel``: offset of the
    segment from its split's start; ``next``: where its successor's segment must
    begin, likewise; ``begin``: of its payload in the segment. The payload's digest
    and size are null where the segment ends before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        names = [c.split()[0] for c in CANDIDATE.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for path, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                value = value.as_py()
                rel, led = places.step(path, block, len(value))
                got = _header(value) if led else None
                if got is None:
                    continue
                fields, begin, length = got
                whole = value[begin : begin + length] if begin + length <= len(value) else None
                out.append((path, block, rel, rel + begin + length + 4 + len(MAGIC), *[fields.get(f) for f in _FIELDS.values()], length, hashlib.sha256(whole).hexdigest() if whole is not None else None, begin))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return parts.mapInArrow(run, CANDIDATE)


def starts(parts: DataFrame) -> DataFrame:
    """(path, block, start, stop): the bytes of the file that each split's segments
    cover; one row a split."""
    size = F.octet_length("value") + F.lit(len(MAGIC))
    sums = parts.groupBy("path", "block").agg(F.sum(size).alias("size"))
    along = Window.partitionBy("path").orderBy("block")
    return sums.withColumn("stop", F.sum("size").over(along)).select("path", "block", (F.col("stop") - F.col("size")).alias("start"), "stop")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """The candidates that are records, with the offset of their segment in the file
    (``at``) and that of their successor's (``follow``)."""
    parts = segments(spark, path)
    splits, splits_path = materialize(starts(parts))
    found, found_path = materialize(candidates(parts).join(splits, ["path", "block"]).withColumn("at", F.col("start") + F.col("rel")).withColumn("follow", F.col("start") + F.col("next")).drop("next"))

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first offset at or after the split's end on each candidate's chain."""
        held: list[tuple] = []

        def solve() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: -x[2])
            out: dict[int, int] = {}
            for _, _, at, follow, stop in held:
                if follow >= stop:
                    out[at] = follow
                elif follow in out:
                    out[at] = out[follow]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(out)), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["path", "at", "leave"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from solve()
                    held = []
                held.append(row)
        if held:
            yield from solve()

    def by_split(df: DataFrame) -> DataFrame:
        return df.repartition("path", "block").sortWithinPartitions("path", "block", "at")

    jumps, jumps_path = materialize(by_split(found.select("path", "block", "at", "follow", "stop")).mapInArrow(leaving, "path string, at bigint, leave bigint"))
    files = splits.groupBy("path").count()
    hops = max([0, *[r[0] for r in files.agg(F.max("count")).collect() if r[0]]])
    # a file's chain begins right after the magic at its start
    reached = found.where(F.col("at") == len(MAGIC)).select("path", "at").distinct()
    reached, reached_path = materialize(reached)
    old = [splits_path, found_path, jumps_path, reached_path]
    reach = 1
    while reach < hops:  # the entries of 2 ** i splits are known after i rounds
        more = reached.join(jumps, ["path", "at"]).select("path", F.col("leave").alias("at"))
        reached, p = materialize(reached.unionByName(more).distinct())
        twice = jumps.join(jumps.select("path", F.col("at").alias("leave"), F.col("leave").alias("further")), ["path", "leave"]).select("path", "at", F.col("further").alias("leave"))
        jumps, q = materialize(twice)
        old += [p, q]
        reach *= 2

    def follow_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each split, the candidates on the chain from its entry."""
        held: list[tuple] = []

        def solve() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[2])
            wanted: set[int] = set()
            keep = []
            for _, _, at, follow, entry in held:
                if entry or at in wanted:
                    keep.append(at)
                    wanted.add(follow)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(keep)), pa.array(keep, pa.int64())], ["path", "at"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from solve()
                    held = []
                held.append(row)
        if held:
            yield from solve()

    entries = found.select("path", "block", "at", "follow").join(reached.withColumn("entry", F.lit(True)), ["path", "at"], "left").select("path", "block", "at", "follow", F.coalesce("entry", F.lit(False)).alias("entry"))
    true, true_path = materialize(found.join(by_split(entries).mapInArrow(follow_in, "path string, at bigint"), ["path", "at"]))
    for p in old:
        drop(spark, p)
    return true


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives: path, at (offset of the record after its magic),
    type, record_id, refers_to, uri, digest (as the header has it), payload_bytes and
    payload_digest (SHA-256 of the payload read), and with ``payloads`` the payload.

    Payloads that hold the magic lie in several segments; those are fetched again and
    put together, one record at a time."""
    true = verified(spark, path)
    columns = ["path", "at", "type", "record_id", "refers_to", "uri", "digest", "payload_bytes", "payload_digest"]
    split = true if payloads else true.where("payload_digest is null")
    if not payloads and not split.limit(1).count():
        return true.select(columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in batches:
            sizes = batch.column(3).to_pylist()
            rel = [places.step(p, b, n)[0] for p, b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rel, pa.int64()), batch.column(2)], ["path", "block", "rel", "value"])

    parts = segments(spark, path)
    sized = parts.withColumn("size", F.octet_length("value")).mapInArrow(placed, "path string, block bigint, rel bigint, value binary")
    splits, _ = materialize(starts(parts))
    index = sized.select("path", "block", "rel", F.octet_length("value").alias("size")).join(splits, ["path", "block"]).select("path", "block", "rel", (F.col("start") + F.col("rel")).alias("seg"))
    # the record that each segment belongs to: the last record at or before it
    own = split.select("path", F.col("at").alias("seg"), F.lit(True).alias("is_record"), "begin", "payload_bytes", F.col("follow"))
    along = Window.partitionBy("path").orderBy("seg")
    index = index.join(own, ["path", "seg"], "left")
    index = index.withColumn("record", F.last(F.when(F.col("is_record"), F.struct(F.col("seg").alias("at"), "begin", "payload_bytes", "follow")), True).over(along))
    index = index.where("record is not null and seg < record.follow").select("path", "block", "rel", "seg", "record.at", "record.begin", "record.payload_bytes")
    pieces = sized.join(index, ["path", "block", "rel"]).groupBy("path", "at", "begin", "payload_bytes").agg(F.sort_array(F.collect_list(F.struct("seg", "value"))).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda x: F.hex(x["value"])), MAGIC.encode().hex().upper())
    body = F.unhex(F.substring(whole, F.col("begin") * 2 + 1, F.col("payload_bytes") * 2))
    pieces = pieces.select("path", "at", body.alias("payload")).withColumn("whole_digest", F.sha2("payload", 256))
    out = true.join(pieces, ["path", "at"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "whole_digest"))
    return out.select(*columns, *["payload"] * payloads)


def page_of(name):
    """The page id in a record id that write_warc made."""
    return F.regexp_extract(name, r"\A<urn:page:(-?\d+)>\z", 1).try_cast("bigint")


def archived(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back and return
    page_id, payload_bytes, payload_digest (of the full payload; a revisit's are its
    response's), record_type and refers_to of every record."""
    whole_numbers(pages, columns.get("id_col", "page_id"), "warc")
    spark = pages.sparkSession
    path = workspace(spark)
    write_warc(pages, path, **columns)
    rows, _ = materialize(read_warc(spark, path).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"), F.regexp_replace("digest", r"\Asha256:", "").alias("stated")))
    full = rows.where("record_type = 'response'")
    again = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("stated").alias("payload_digest"))
    sizes = full.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    again = again.join(sizes, ["refers_to", "payload_digest"])
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(names).unionByName(again.select(names))
