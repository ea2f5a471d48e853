"""Zstandard WARC archives: a writer that stores equal payloads once, and a reader that validates every record.

An archive starts with a skippable frame that holds the dictionary its records were compressed with; every record
is one Zstandard frame. ``write`` lets Spark's text writer lay the frames down, one a row: the line separator is an empty
skippable frame, which readers of the format pass over. So archives get the writer's commit protocol, reach any
file system that Spark reaches, and a lost executor costs its tasks only. ``read`` takes whole files, loads the dictionary
from the leading frame, finds the end of a frame from its block headers and decodes one record at a time.

Of pages with equal payloads (by SHA-1, ``min_bytes`` long at least) the one with the smallest id is a ``response``
record, the others are ``revisit`` records without payload. Finding the first copy shuffles digests; ids of a digest are
spread over ``SALTS`` keys and combined before, so a payload that a third of all pages share is no hot key.

Defined results: a null payload is empty; a null url has no target line and comes back null, control characters of a url are
percent-encoded; rows with a null id are responses that nothing refers to; of repeated rows with the smallest id of their
payload each is a response; an empty table gives no records. A record that breaks the format, a length or the digest comes back with
``problem`` set and nothing else trusted; a file that cannot be followed further ends with such a row. Only the
columns ``page_id``, ``url`` and ``html`` are read. An archive has to fit a task's memory: ``write`` makes one from each of
Spark's partitions. A record's payload is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.llm.registry import register, table
from twinvec.llm.workers import lean

#: Fixed values of the formats: the dictionary's frame, empty skippable frame, a Zstandard frame, the version line, revisits.
DICTIONARY_MAGIC, EMPTY_FRAME, FRAME_MAGIC = 0x184D2A5D, "P*M\x18\0\0\0\0", 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on about this many pages, up to this many characters of each. It changes sizes, not results.
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 65536
SALTS, LEVEL, DATE = 256, 3, "1970-01-01T00:00:00Z"
#: A frame that announces more than this is not decoded.
MOST_BYTES = 1 << 30


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest`` (hex) and ``first``, the smallest id with the same payload, null if it has one copy."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.select("*", F.sha1("html").alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    part = (p.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "salt")
            .agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")))
    whole = part.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    return p.join(part.select("digest", "salt").join(whole, "digest"), ["digest", "salt"], "left").select(
        "page_id", "url", "html", "digest", "first")


def train_dictionary(pages: DataFrame, samples: int = SAMPLES, size: int = DICTIONARY_BYTES) -> bytes | None:
    """A Zstandard dictionary from about ``samples`` pages; None where they are too few or too short for one."""
    import zstandard

    every = max(1, pages.count() // samples)
    rows = (pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("t"))
            .where("t <> ''").limit(2 * samples).collect())
    rows.sort(key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["t"]))
    try:
        return zstandard.train_dictionary(size, [r["t"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, date: str = DATE) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines), b"", block, b"", b""])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """The record of one page: a revisit if ``first`` is another page's id."""
    name = lambda i: f"<urn:x-page:{'none' if i is None else i}>"
    again = first is not None and page_id is not None and first != page_id
    fields = [("WARC-Target-URI", re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if again:
        fields += [("WARC-Refers-To", name(first)), ("WARC-Profile", REVISIT_PROFILE)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if again else "response", name(page_id), fields, head if again else head + payload, date)


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def write(pages: DataFrame, path: str, min_bytes: int = 0, level: int = LEVEL, date: str = DATE) -> None:
    """Writes archives with a record for every row of ``pages`` (``page_id, url, html``) into the folder ``path``."""
    dictionary = train_dictionary(pages)

    def run(batches):
        import zstandard

        lean()
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_checksum=True, write_dict_id=True)
        started = False
        for b in batches:
            html = b["html"].cast(pa.binary())
            ids, urls, firsts = b["page_id"].to_pylist(), b["url"].to_pylist(), b["first"].to_pylist()
            digests, out, size = b["digest"].to_pylist(), [], 0
            if not started and len(b):
                info = record("warcinfo", "<urn:x-archive:pages>", [("Content-Type", "application/warc-fields")],
                              b"software: twinvec\r\nformat: WARC File Format 1.1\r\n", date)
                out, started = ([dictionary_frame(dictionary)] if dictionary else []) + [squeeze.compress(info)], True
            for i in range(len(b)):
                digest = base64.b32encode(bytes.fromhex(digests[i])).decode()
                out.append(squeeze.compress(page_record(ids[i], urls[i], html[i].as_py(), digest, firsts[i], date)))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
    frames = first_copies(pages, min_bytes).select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("first").cast("long"))
    frames = frames.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # One file a partition, or a second one would lack the dictionary.
    frames.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 0).option("compression", "none").text(path)


class Broken(ValueError):
    """A record or archive that breaks the format."""


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its block headers."""
    import zstandard

    head = bytes(data[at:at + 18])
    try:
        end = at + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise Broken(f"frame header: {e}") from None
    last = False
    while not last:
        if end + 3 > len(data):
            raise Broken("frame: cut off")
        block = int.from_bytes(data[end:end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Broken("frame: reserved block type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise Broken("frame: cut off")
    return end


def frames(data: memoryview):
    """``(start, end, magic)`` of the frames of an archive."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50 and at + 8 <= len(data):
            end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
            if end > len(data):
                raise Broken("skippable frame: cut off")
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
        else:
            raise Broken("no frame")
        yield at, end, magic
        at = end


def archive_records(data: memoryview, most_bytes: int = MOST_BYTES):
    """``(offset, record bytes or None, problem)`` for every record frame of an archive."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    reader, at = plain, 0
    try:
        for at, end, magic in frames(data):
            if at == 0 and magic == DICTIONARY_MAGIC:
                body = bytes(data[8:end])
                try:
                    body = plain.decompress(body) if body[:4] == FRAME_MAGIC.to_bytes(4, "little") else body
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except zstandard.ZstdError as e:
                    raise Broken(f"dictionary: {e}") from None
            if magic != FRAME_MAGIC:
                continue
            size = zstandard.frame_content_size(bytes(data[at:at + 18]))
            if size > most_bytes:
                yield at, None, "frame: announces too many bytes"
                continue
            try:
                whole = reader.decompress(data[at:end]) if size >= 0 else reader.decompressobj().decompress(data[at:end])
                yield at, whole, None
            except zstandard.ZstdError as e:
                yield at, None, f"frame: {e}"
    except Broken as e:
        yield at, None, str(e)


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """Header fields (names in small letters) and block of a record; raises ``Broken``."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        raise Broken("header: no version line")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        name = name.decode("utf-8", "replace").lower()
        if not colon or not re.fullmatch("[!#$%&'*+.^_`|~0-9a-z-]+", name):
            raise Broken("header: no field name")
        if name in fields and name != "warc-concurrent-to":
            raise Broken(f"header: {name} twice")
        fields[name] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Broken(f"header: no {name}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise Broken("length: not a number")
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n" or len(rest) != n + 4:
        raise Broken("length: the block is not as long as its header says")
    return fields, rest[:n]


def payload_of(fields: dict, block: bytes) -> tuple[bytes | None, int | None]:
    """Payload (None for a revisit) and payload's length of an HTTP response record; checks length and digest."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise Broken("http: no header")
    found = re.findall(rb"(?i)^content-length:[ \t]*([0-9]+)[ \t]*$", head.replace(b"\r\n", b"\n"), re.M)
    if len(found) > 1:
        raise Broken("http: content-length twice")
    digest = fields.get("warc-payload-digest")
    if fields["warc-type"] == "revisit":
        if "warc-refers-to" not in fields or payload:
            raise Broken("revisit: refers to nothing or has a payload")
        return None, int(found[0]) if found else None
    if found and int(found[0]) != len(payload):
        raise Broken("length: the payload is not as long as its header says")
    if digest and digest.lower().startswith("sha1:") and digest[5:].upper() != base32_sha1(payload):
        raise Broken("digest: not the payload's")
    return payload, len(payload)


READ_SCHEMA = ("path string, offset long, record_type string, record_id string, uri string, date string, refers_to string, "
               "payload_digest string, payload_bytes long, payload binary, problem string")


def read(spark: SparkSession, path: str, payloads: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The records of all archives in ``path``, one row each; ``payloads=False`` leaves the column ``payload`` null."""
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in READ_SCHEMA.split(", ")])

    def row(file: str, at: int, data: bytes | None, problem: str | None) -> dict:
        out = dict.fromkeys(names) | {"path": file, "offset": at, "problem": problem}
        if data is None:
            return out
        try:
            fields, block = parse_record(data)
            out |= {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"),
                    "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to")}
            digest = fields.get("warc-payload-digest")
            out["payload_digest"] = digest and digest.partition(":")[2]
            if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
                payload, out["payload_bytes"] = payload_of(fields, block)
                out["payload"] = payload if payloads else None
        except Broken as e:
            out["problem"] = str(e)
        return out

    def run(batches):
        lean()
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"]):
                rows, size = [], 0
                if content.as_buffer() is None:
                    continue
                for found in archive_records(memoryview(content.as_buffer()), most_bytes):
                    rows.append(row(file, *found))
                    size += len(rows[-1]["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ_SCHEMA)


def page_rows(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of page records; a broken record raises its problem."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    whole = F.when(F.col("problem").isNull(), F.col("record_id")).otherwise(
        F.raise_error(F.concat_ws(" ", "path", F.col("offset").cast("string"), "problem")))
    r = records.withColumn("record_id", whole).where(F.col("record_id").startswith("<urn:x-page:"))
    return r.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = """WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""


@register("op11_warc", SQL)
def op11_warc(spark, sf_dir):
    import uuid

    from twinvec.session import ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + "/twinvec-warc/" + uuid.uuid4().hex
    write(table(spark, sf_dir, "pages"), path)
    return page_rows(read(spark, path, payloads=False))
