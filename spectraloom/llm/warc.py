"""WARC archives: pages written as response and revisit records, and read back by boundary-chain verification.

Writing. Of pages with equal payloads (SHA-1 of the UTF-8 bytes) the one with the largest id becomes a
response, the others revisit it and carry no payload. Only payloads that occur twice are known to a
table of copies. A page meets that table without a shuffle of its text unless it may be a copy: the
few payloads with a large share of all copies (at most `HEAVY` by construction) are broadcast, and so
is the set of hash slots that copies fall into (at most `SLOTS` numbers); a page outside both is
written where it was read. The records are one string column that Spark's text writer stores with the
record separator as line separator, so files appear by its commit protocol only.

Reading. Files are cut into chunks of bytes. A task looks for the magic in its chunk, also inside
payloads, and parses what looks like a header into a candidate: record offset -> successor offset
(offset + header + Content-Length + separator). Links inside a chunk are contracted at once by pointer
jumping in numpy; each candidate is left with its first successor outside the chunk. These meet the
candidates of the chunk they point to by a join, and pointer jumping over chunks, from the start of
every file, doubles the reach per round: logarithmically many joins of about one row per chunk.
Magics inside payloads are not reached and so rejected. Last, every chunk with a reachable entry is
walked from there along its records, streaming payloads through the digest.

Cases: a NULL payload is empty (0 bytes); NULL ids are smaller than any id, and are written as `none`;
all rows that repeat the largest id of a payload are responses; a NULL url gives no target; line breaks
in a url are percent-encoded; a file that breaks off, or whose chain meets bytes that are no record,
gives the records before that place, and `verified` says for every file how far its chain holds; an
empty table gives files without records and an empty result. Other columns are ignored, whatever
their names.
"""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectraloom.session import handed_over, scratch_path

#: most payloads that each may hold a thousandth of all copies or more
HEAVY = 1000
#: hash slots for the payloads of all other copies
SLOTS = 1 << 20
CHUNK = 8 << 20
TASK_BYTES = 64 << 20
READ = 1 << 20
WINDOW = 1 << 18

DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC_LENGTH = 10
FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+:")
LENGTH = re.compile(rb"content-length:[ \t]*([0-9]{1,18})[ \t]*", re.I)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing


def base32_sha1(col):
    """Bare upper-case base32 of the SHA-1 of a string: four times ten hex digits are eight base-32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), digits, letters)


def _with_top(pages, min_payload):
    """`pages` (id, url, payload, digest, n) with `top`, the id their payload's response has; NULL if it is their own."""
    copies = pages.filter(F.col("n") >= min_payload).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("copies"))
    copies = handed_over(copies.filter("copies > 1"), "copies")
    all_copies = copies.agg(F.sum("copies")).first()[0] or 0
    is_heavy = F.col("copies") * HEAVY >= all_copies
    heavy = copies.filter(is_heavy).select(F.col("digest").alias("h_digest"), F.col("top").alias("h_top"))
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    slots = copies.filter(~is_heavy).select(slot.alias("slot")).distinct()
    marked = pages.join(F.broadcast(heavy), F.col("digest") == F.col("h_digest"), "left")
    # without a large group, and with its slot unused: decided in place
    here = marked.join(F.broadcast(slots), F.col("h_digest").isNull() & (slot == F.col("slot")), "left_anti")
    maybe = marked.filter("h_digest is null").join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
    light = copies.filter(~is_heavy).select(F.col("digest").alias("c_digest"), F.col("top").alias("c_top"))
    met = maybe.join(light, F.col("digest") == F.col("c_digest"), "left")
    columns = ["id", "url", "payload", "digest", "n"]
    both = here.select(*columns, F.col("h_top").alias("top")).unionByName(met.select(*columns, F.col("c_top").alias("top")))
    return both.withColumn("top", F.when(~F.col("top").eqNullSafe(F.col("id")), F.col("top")))


def _record_id(col):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))


def _record(date):
    """The record of a page of `_with_top`, without its separator."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("top").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)
    )
    block_length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("top"))))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        # rows that repeat an id and a payload share it
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages, folder, page_id="page_id", url="url", payload="html", min_payload=0, date=DATE):
    """One file per task under `folder`; payloads under `min_payload` bytes are always responses."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("n"))
    records = _with_top(rows, min_payload).select(_record(date).alias("value"))
    records.write.option("lineSep", END).option("compression", "none").text(folder)


# ---------------------------------------------------------------- reading


class Archive:
    """Random access to one file, of any file system that Arrow knows by its URI.

    Small reads are served from a window over the file, or from bytes at hand (`hold`).
    """

    def __init__(self, path):
        from pyarrow import fs

        path = re.sub(r"^file:/+", "file:///", path)
        if "://" in path:
            system, path = fs.FileSystem.from_uri(path)
        else:
            system = fs.LocalFileSystem()
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.window = self.held = (0, b"")

    def hold(self, start, n):
        self.held = (start, self.file.read_at(max(min(n, self.size - start), 0), start))
        return self.held[1]

    def read(self, start, n):
        n = max(min(n, self.size - start), 0)
        for at, data in (self.held, self.window):
            if at <= start and start + n <= at + len(data):
                return data[start - at : start - at + n]
        if n >= WINDOW:
            return self.file.read_at(n, start)
        self.window = (start, self.file.read_at(min(WINDOW, self.size - start), start))
        return self.window[1][:n]

    def close(self):
        self.file.close()


class Header:
    """A record's header: its fields, where its block starts, and where its successor would."""

    def __init__(self, fields, at, length, content):
        self.fields, self.block, self.content = fields, at + length, content
        self.successor = self.block + content + len(END)


def header_at(archive, at):
    """The header of a record at `at`, or None.

    Lines are checked one by one and reading goes on only while they look like fields, so a magic in
    a payload costs little however long the payload is.
    """
    data, step = archive.read(at, 1024), 2048

    def more():
        nonlocal data, step
        got = archive.read(at + len(data), step)
        data, step = data + got, 2 * step
        return bool(got)

    if not MAGIC.match(data):
        return None
    place, fields, content = MAGIC_LENGTH, {}, None
    while True:
        while (stop := data.find(b"\r\n", place)) < 0:
            # a line that cannot become a field or the blank line is given up before more is read
            rest = data[place : place + 256]
            if len(rest) > 128 and not FIELD.match(rest) or not more():
                return None
        if stop == place:
            break
        if not FIELD.match(data, place, stop):
            return None
        line = data[place:stop]
        if found := LENGTH.fullmatch(line):
            if content is not None:
                return None
            content = int(found[1])
        name, _, value = line.partition(b":")
        fields.setdefault(name.decode("ascii").lower(), value.strip(b" \t").decode("utf-8", "replace"))
        place = stop + 2
    if content is None:
        return None
    header = Header(fields, at, place + 2, content)
    return header if header.successor <= archive.size and archive.read(header.successor - 4, 4) == END.encode() else None


def contracted(offsets, successors, stop):
    """Each candidate's first successor that is no candidate of this chunk: pointer jumping by squaring."""
    at = np.searchsorted(offsets, successors)
    inside = (successors < stop) & (at < len(offsets))
    inside[inside] = offsets[at[inside]] == successors[inside]
    jump = np.where(inside, at, np.arange(len(offsets)))
    while not np.array_equal(jump, further := jump[jump]):
        jump = further
    return successors[jump]


def chunk_candidates(archive, start, stop):
    """(offsets, first successors outside) of what looks like a record in [start, stop)."""
    data = archive.hold(start, stop - start + MAGIC_LENGTH - 1)
    offsets, successors = [], []
    for found in MAGIC.finditer(data):
        if found.start() < stop - start and (header := header_at(archive, start + found.start())):
            offsets.append(start + found.start())
            successors.append(header.successor)
    offsets, successors = np.array(offsets, np.int64), np.array(successors, np.int64)
    return offsets, contracted(offsets, successors, stop)


def _spread(rows, total_bytes):
    """Small rows that stand for much work, over tasks by the bytes behind them."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // TASK_BYTES))
    return rows.repartition(tasks, *rows.columns)


CANDIDATES = "path string, start bigint, offsets array<bigint>, exits array<bigint>"


def _candidates(files, chunk, total):
    chunks = files.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint"))).alias("start")
    )

    def work(batches):
        for batch in batches:
            rows = []
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                archive = Archive(path)
                offsets, exits = chunk_candidates(archive, start, start + chunk)
                archive.close()
                rows.append((path, start, offsets, exits))
                if sum(len(r[2]) for r in rows) > 100_000:
                    yield _batch(rows, CANDIDATE_TYPES)
                    rows = []
            if rows:
                yield _batch(rows, CANDIDATE_TYPES)

    return handed_over(_spread(chunks.select("path", "start"), total).mapInArrow(work, CANDIDATES), "candidates")


CANDIDATE_TYPES = {
    "path": pa.string(), "start": pa.int64(), "offsets": pa.list_(pa.int64()), "exits": pa.list_(pa.int64()),
}


def _batch(rows, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))


def _reached(candidates, chunk):
    """(path, at, exit): the record every chunk is entered by, if the chain from the file's start comes there."""
    targets = candidates.select("path", F.explode(F.array_distinct("exits")).alias("at"))
    starts = candidates.filter("start = 0").select("path", F.lit(0).cast("bigint").alias("at"))
    targets = targets.unionByName(starts).distinct().withColumn("start", F.col("at") - F.col("at") % chunk)
    place = F.array_position("offsets", F.col("at"))
    nodes = targets.join(candidates, ["path", "start"]).withColumn("place", place).filter("place > 0")
    nodes = handed_over(nodes.select("path", "at", F.element_at("exits", F.col("place").cast("int")).alias("exit")), "entries")

    ends = nodes.select(F.col("path").alias("e_path"), F.col("at").alias("e_at"))
    jumps = nodes.join(ends, (F.col("path") == F.col("e_path")) & (F.col("exit") == F.col("e_at"))).select("path", "at", F.col("exit").alias("to"))
    reach = nodes.filter("at = 0").select("path", "at")
    while True:
        # reach holds what 2^i - 1 links or fewer lead to, jumps lead over 2^i links
        state = handed_over(reach.withColumn("to", F.lit(None).cast("bigint")).unionByName(jumps), "chain")
        reach, jumps = state.filter("to is null").select("path", "at"), state.filter("to is not null")
        if jumps.isEmpty():
            return nodes.join(reach, ["path", "at"], "left_semi")
        further = reach.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        second = jumps.select(F.col("path").alias("s_path"), F.col("at").alias("s_at"), F.col("to").alias("s_to"))
        doubled = jumps.join(second, (F.col("path") == F.col("s_path")) & (F.col("to") == F.col("s_at")))
        reach, jumps = reach.unionByName(further).distinct(), doubled.select("path", "at", F.col("s_to").alias("to"))


RECORDS = (
    "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length bigint, read_digest string, read_bytes bigint, payload binary"
)
RECORD_TYPES = dict(
    zip((c.split()[0] for c in RECORDS.split(", ")), [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")])
)


def _pieces(archive, at, left):
    while left > 0 and (piece := archive.read(at, min(READ, left))):
        yield piece
        at, left = at + len(piece), left - len(piece)


def read_payload(archive, header, keep):
    """(SHA-1, bytes, payload or None) of a record's block, after its HTTP header if it has one; piece by piece."""
    digest, n, kept, head = hashlib.sha1(), 0, [], b""
    inside = not header.fields.get("content-type", "").lower().startswith("application/http")
    for piece in _pieces(archive, header.block, header.content):
        if not inside:
            searched = max(len(head) - len(END), 0)
            head += piece
            end = head.find(END.encode(), searched)
            if end < 0:
                continue
            piece, inside = head[end + len(END) :], True
        digest.update(piece)
        n += len(piece)
        if keep:
            kept.append(piece)
    return digest, n, b"".join(kept) if keep else None


def walk(archive, at, stop):
    """(offset, header) of the records from `at` on that start before `stop`."""
    while at < stop and (header := header_at(archive, at)):
        yield at, header
        at = header.successor


def _row(path, offset, archive, header, keep):
    digest, n, payload = read_payload(archive, header, keep)
    field = header.fields.get
    length = field("x-payload-length", "")
    return (
        path, offset, field("warc-type"), field("warc-record-id"), field("warc-target-uri"), field("warc-refers-to"),
        field("warc-payload-digest", "").removeprefix("sha1:") or None, int(length) if length.isdecimal() else None,
        base64.b32encode(digest.digest()).decode(), n, payload,
    )


def _files(spark, folder):
    """(path, length) of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files, files.agg(F.sum("length")).first()[0] or 0


def read_archives(spark, folder, chunk=CHUNK, with_payload=False):
    """One row per record that the chain from its file's start reaches.

    `payload_digest` and `payload_length` are what the header says; `read_digest`, `read_bytes` and,
    if wanted, `payload` are what the block holds (of a revisit: nothing).
    """
    files, total = _files(spark, folder)
    entries = _reached(_candidates(files, chunk, total), chunk).select("path", "at")

    def work(batches):
        for batch in batches:
            rows, held = [], 0
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                archive = Archive(path)
                for offset, header in walk(archive, at, at - at % chunk + chunk):
                    rows.append(_row(path, offset, archive, header, with_payload))
                    held += len(rows[-1][-1] or b"") + 500
                    if held > 4 * READ:
                        yield _batch(rows, RECORD_TYPES)
                        rows, held = [], 0
                archive.close()
            if rows:
                yield _batch(rows, RECORD_TYPES)

    return _spread(entries, total).mapInArrow(work, RECORDS)


def verified(spark, folder, chunk=CHUNK):
    """(path, length, verified): up to which byte the chain of records holds, for every file that is not empty."""
    files, total = _files(spark, folder)
    ends = _reached(_candidates(files, chunk, total), chunk).groupBy("path").agg(F.max("exit").alias("end"))
    return files.join(ends, "path", "left").select("path", "length", F.coalesce("end", F.lit(0).cast("bigint")).alias("verified"))


def page_digests(records):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of `read_archives` over `write_archives`.

    Responses report what was read; revisits report the payload they stand for.
    """
    page = lambda c: F.col(c).substr(F.lit(13), F.instr(F.substring(c, 13, 40), ":") - 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.col("read_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("read_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(~response, page("refers_to")).alias("refers_to"),
    )


def round_trip(pages, chunk=CHUNK, **options):
    """`pages` written as archives in the shared folder and read back, as `page_digests`."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return page_digests(read_archives(pages.sparkSession, folder, chunk))
