"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: records are lines of Spark's text writer whose line separator is the end of a WARC record,
so any file system that Spark writes to takes them and the commit protocol guards against lost tasks.

Reading: Spark's text reader cuts the files at the version line of a record, wherever it stands, in
splits of any size. A version line in a payload makes false candidates. Tasks emit for each candidate
its place and, from its header, the place of its successor; within each file pointer jumping from the
start keeps the candidates that a chain of successors reaches. What a payload holds cannot be reached.
A record whose payload goes on in later splits is put together from their pieces, which are joined with it
by split; nothing of it goes through the driver. Payloads of any length are read whole: a record must fit
into a worker, and a split's pieces are held once while a candidate waits for its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm._shared import shared_dir, small_batches, stored

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records of one archive file, at most.
FILE_RECORDS = 20_000
#: Revisits up to this number are broadcast when records are made (about 40 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 100_000
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record without its closing separator. Revisits carry the payload's length and digest only."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    block = HTTP + payload if refers_to is None else HTTP
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id and refers_to of the pages that repeat an earlier page's payload of at least
    ``least_bytes``. Groups are reduced to their smallest id before the join, whose hot keys Spark
    splits (no row of a group meets another)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    prints = pages.filter(F.col("page_id").isNotNull()).select("page_id", F.sha1(html).alias("sha"), F.octet_length(html).alias("size")).filter(F.col("size") >= least_bytes)
    firsts = prints.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("sha", "size", "refers_to")
    return prints.join(firsts, ["sha", "size"]).filter("page_id <> refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0) -> None:
    """Writes a record for each page (page_id, url, html) to WARC files in ``path``.

    Null html is an empty payload. Of equal payloads of at least ``least_bytes`` that with the
    smallest page_id is a response and the others revisit it; rows that repeat that page_id are
    responses too, as are pages of null id. An empty table writes no record.
    """
    spark = pages.sparkSession
    small_batches(spark)
    again = stored(revisits(pages, least_bytes), "revisits")
    few = again.count() <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", "html").join(F.broadcast(again) if few else again, "page_id", "left")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(p, u, (h or "").encode("utf-8", "surrogatepass"), r).decode("utf-8", "replace") for p, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    lines = rows.select("page_id", "url", "html", "refers_to").mapInArrow(records, "value string")
    lines.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"(?mi)^([\w-]+):[ \t]*(.*?)\r?$")


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of the header at the start of a piece, its closing blank line included; None
    if it has none or no usable length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(piece[:end])}
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    return fields, end + 4


def _page(name: str | None) -> int | None:
    m = re.search(r"urn:page:(-?\d+)", name or "")
    return int(m[1]) if m else None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else block


CANDIDATE_SCHEMA = "file string, block long, place long, successor long, span long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, declared string"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file and block (start of the split) of what stands between version lines."""
    text = spark.read.option("lineSep", VERSION.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


class Split:
    """The pieces of one split while candidates wait for their ends. Places count from its first piece."""

    def __init__(self, file: str, block: int):
        self.name, self.at = (file, block), 0
        self.held: list[tuple[int, bytes]] = []
        self.waiting: list[tuple[list, int, int]] = []  # row, begin and end of the record's block

    def bytes_of(self, begin: int, end: int) -> bytes:
        return b"".join(data[max(begin - at, 0) : end - at] for at, data in self.held if at < end and at + len(data) > begin)

    def add(self, value: bytes) -> list[tuple]:
        """Takes the next piece; the rows that it completes."""
        found = parse_header(value)
        after = self.at + len(value)
        if found:
            fields, head = found
            begin, kind = self.at + head, fields["warc-type"]
            end = begin + int(fields["content-length"])
            declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            length = fields.get("warc-payload-length", "")
            # place is where the version line would begin if the first piece began at 0
            row = [*self.name, self.at - len(VERSION), end + len(END), None, _page(fields.get("warc-record-id")), int(length) if length.isdigit() else None, declared, kind, _page(fields.get("warc-refers-to")), declared]
            if kind == "revisit":
                self.waiting.append((row, begin, begin))  # its header says all
            else:
                self.waiting.append((row, begin, end))
        if self.waiting:
            self.held.append((self.at - len(VERSION), VERSION + value) if self.at else (0, value))
        done = [self.finished(*w) for w in self.waiting if w[2] <= after]
        self.waiting = [w for w in self.waiting if w[2] > after]
        first = min((w[1] for w in self.waiting), default=after)
        self.held = [x for x in self.held if x[0] + len(x[1]) > first]
        self.at = after + len(VERSION)
        return done

    def finished(self, row: list, begin: int, end: int) -> tuple:
        if row[8] == "revisit":
            return tuple(row)
        payload = payload_of(self.bytes_of(begin, end))
        return (*row[:6], len(payload), digest_of(payload), *row[8:])

    def close(self) -> list[tuple]:
        """Rows of candidates that go on beyond the split, and the split's own."""
        return [(*row[:6], None, None, *row[8:]) for row, _, _ in self.waiting] + [(*self.name, None, None, self.at, *[None] * 6)]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each candidate record, and for each split one whose ``span`` is the split's length.

    place and successor count from the split's first piece. payload_digest is null where the payload
    goes on beyond the split; then place and successor say what to read again.
    """
    small_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: Split | None = None
        rows: list[tuple] = []
        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split is None or (file, block) != split.name:
                    rows += split.close() if split else []
                    split = Split(file, block)
                rows += split.add(value)
            if rows:
                yield _batch(rows)
                rows = []
        if split:
            yield _batch(split.close())

    return pieces(spark, path).mapInArrow(scan, CANDIDATE_SCHEMA)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in CANDIDATE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def reachable(place: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the candidates, given by rising place, a chain of successors from place 0 reaches, by
    pointer jumping: each round doubles the length of all jumps."""
    n = len(place)
    jump = np.searchsorted(place, successor)
    jump = np.where((jump < n) & (place[np.minimum(jump, n - 1)] == successor), jump, n)
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and place[0] == 0
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if (more == reached).all():
            return reached[:n]
        reached = more


def chain(group: pa.Table) -> pa.Table:
    """The true records of one file, with places counted from the file's start; ``covers`` has block and
    base of each split that a record with an open end lies in."""
    block, span = group["block"].to_numpy(), group["span"].to_numpy(zero_copy_only=False)
    ends = ~np.isnan(span.astype(float))
    order = np.argsort(block[ends])
    blocks = block[ends][order]
    bases = np.concatenate([[0], np.cumsum(span[ends][order])[:-1]]).astype(np.int64)
    own = group.filter(pa.array(~ends))
    base = bases[np.searchsorted(blocks, own["block"].to_numpy())]
    place, successor = own["place"].to_numpy() + base, own["successor"].to_numpy() + base
    order = np.argsort(place, kind="stable")
    kept = order[reachable(place[order], successor[order])] if len(order) else order
    covers = []
    for i, cut in zip(kept.tolist(), own["payload_digest"].take(pa.array(kept)).is_null().to_pylist(), strict=True):
        over = np.flatnonzero((bases >= base[i]) & (bases < successor[i])) if cut else []
        covers.append([{"block": int(blocks[k]), "base": int(bases[k])} for k in over])
    out = own.set_column(own.column_names.index("place"), "place", pa.array(place)).set_column(own.column_names.index("successor"), "successor", pa.array(successor))
    out = out.take(pa.array(kept)).select(["file", "place", "successor", *_RECORD, "declared"])
    return out.append_column("covers", pa.array(covers, pa.list_(pa.struct([("block", pa.int64()), ("base", pa.int64())]))))


_RECORD = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files in ``path``: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and intact (the digest of what was read is the declared one; true for revisits).

    Sizes and digests of responses are those of the bytes read. Archives without records give an
    empty table. Only the places of a file's candidates, not their contents, come together in a task.
    """
    schema = f"file string, place long, successor long, {RECORD_SCHEMA}, declared string, covers array<struct<block: long, base: long>>"
    kept = stored(candidates(spark, path).groupBy("file").applyInArrow(chain, schema), "records")
    whole = kept.filter("payload_digest is not null")
    cut = kept.filter("payload_digest is null")
    if cut.limit(1).count():
        more = cut.drop("payload_bytes", "payload_digest").join(reassembled(spark, path, cut), ["file", "place"])
        whole = whole.unionByName(more)
    return whole.select(*_RECORD, (F.col("payload_digest") == F.col("declared")).alias("intact"))


PART_SCHEMA = "file string, place long, at long, data binary"


def reassembled(spark: SparkSession, path: str, cut: DataFrame, most: int | None = None) -> DataFrame:
    """file, place, payload_bytes and payload_digest of records that lie in several splits.

    Each split's pieces meet the records that lie in it, of which there is mostly one that begins before
    it and one that ends after it; the parts of a record come together in a task. Up to ``most`` rows of
    records and splits are broadcast; beyond, pieces are dealt by split.
    """
    most = BROADCAST_ROWS if most is None else most
    wanted = cut.select("file", "place", "successor", F.explode("covers").alias("c")).select("file", F.col("c.block").alias("block"), F.col("c.base").alias("base"), "place", "successor")
    wanted = stored(wanted.groupBy("file", "block", "base").agg(F.sort_array(F.collect_list(F.struct("place", "successor"))).alias("spans")), "spans")
    few = wanted.count() <= most
    numbered = pieces(spark, path).withColumn("number", F.monotonically_increasing_id())
    found = numbered.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["file", "block"])
    if not few:  # in order again within each split
        found = found.repartition("file", "block").sortWithinPartitions("file", "block", "number")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for file, block, value, base, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != split:
                    split, at = (file, block), 0
                begin = base + at
                data = VERSION + value if begin else value
                low = begin - len(VERSION) if begin else begin
                for span in spans:
                    first, last = max(low, span["place"] + len(VERSION)), min(low + len(data), span["successor"] - len(END))
                    if first < last:
                        rows.append((file, span["place"], first, data[first - low : last - low]))
                at += len(value) + len(VERSION)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "place", "at", "data"])

    def digest(group: pa.Table) -> pa.Table:
        order = np.argsort(group["at"].to_numpy(), kind="stable")
        text = b"".join(group["data"].take(pa.array(order)).to_pylist())
        payload = payload_of(text[parse_header(text)[1] :])
        return pa.table({"file": group["file"][:1], "place": group["place"][:1], "payload_bytes": [len(payload)], "payload_digest": [digest_of(payload)]})

    parted = found.select("file", "block", "value", "base", "spans").mapInArrow(parts, PART_SCHEMA)
    return parted.groupBy("file", "place").applyInArrow(digest, "file string, place long, payload_bytes long, payload_digest string")


def op7_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).drop("intact")
