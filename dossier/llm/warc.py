"""WARC archives: index first, then coalesced byte-range reads.

Writing, each task makes one archive file of gzip members (one a record) in the shared folder and returns, for each
record, offset, length, URL and digest: the index, a table that is written before anything is read. Only the index of
a task that ended names its file, so files of lost or repeated tasks are never read. Reading, the selected index rows
are dealt out by archive and stretch, sorted by offset, and neighbouring ranges are fetched in one read.

Files are opened through ``pyarrow.fs``, which reaches local and shared folders and object stores by URI.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, shared_dir, stored

MIN_REVISIT = 100
STRETCH, GAP, READ = 64 << 20, 64 << 10, 8 << 20
CRLF = b"\r\n"
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, record_type string"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded, and so are percent signs."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _unclean(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, errors="surrogatepass")


def record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to, archive: str, offset: int) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it states digest and size of the payload that it refers to."""
    block = payload if kind == "response" else b""
    name = f"{archive}/{offset}/{page_id}/{digest}"  # rows may repeat, places do not
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    for key, value in (("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Refers-To-Page-ID", refers_to)):
        if value is not None:
            headers.append((key, _clean(str(value))))
    if kind == "revisit":
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass")
    return b"WARC/1.1" + CRLF + head + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError where it is cut short."""
    head, mark, rest = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a record's length differs from its header")
    return headers, rest[:n]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_plan(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with payload size, digest, record type and what a revisit refers to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"),
    )
    large = rows.where(f"payload_bytes >= {MIN_REVISIT}")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # The size joins the key, so that both sides are dealt anew and the rows of one payload can be split.
    first = first.select(F.col("payload_digest").alias("_d"), F.xxhash64("payload_digest").alias("_k"), "_first")
    on = (F.col("payload_digest") == F.col("_d")) & (F.xxhash64("payload_digest") == F.col("_k"))
    rows = rows.join(first, on, "left")
    again = F.coalesce((F.col("payload_bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    return rows.select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 4
) -> DataFrame:
    """Writes a record for each row below ``folder`` (a URI) and returns the stored index, a row for each record.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are responses, others revisits of
    that id; a null id counts as larger than all others, and rows are all responses where no id is known. Null html
    is an empty payload. Repeated rows get a record each. Other columns of ``pages`` do not matter.
    """
    pages = ensure_columns(pages, **{id_col: "long", url_col: "string", html_col: "string"})

    def run(batches):
        out, name, at = None, None, 0
        try:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    if out is None:
                        task = TaskContext.get()
                        store, path = _open(folder)
                        store.create_dir(path, recursive=True)
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    page, refers = (None if v is None or v != v else int(v) for v in (r.page_id, r.refers_to))
                    payload = (r.html or "").encode("utf-8", "surrogatepass")
                    raw = record(page, r.url, payload, int(r.payload_bytes), r.payload_digest, r.record_type, refers, name, at)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = z.compress(raw) + z.flush()
                    out.write(data)
                    rows.append((page, name, at, len(data), r.url, r.payload_digest, r.record_type))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    plan = record_plan(pages, id_col, url_col, html_col)
    # Ids travel as text: a column of ids with nulls would become floating point in pandas.
    text_ids = plan.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stored(text_ids.mapInPandas(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Size and digest of a response are those of the payload that was read; a payload that differs from the index's
    digest fails the job. html is null for revisits.
    """
    wanted = index.select("archive", "offset", "length", "payload_digest").withColumn("_s", F.floor(F.col("offset") / STRETCH))
    wanted = wanted.repartition("archive", "_s").sortWithinPartitions("archive", "offset")

    def ranges(rows):
        """Neighbouring records as one range."""
        run: list = []
        for archive, offset, length, digest in rows:
            if run and (run[0][0] != archive or offset - run[-1][1] - run[-1][2] > GAP or offset + length - run[0][1] > READ):
                yield run
                run = []
            run.append((archive, offset, length, digest))
        if run:
            yield run

    def run(batches):
        store, path = _open(folder)
        file, name = None, None
        rows = (r for pdf in batches for r in pdf[["archive", "offset", "length", "payload_digest"]].itertuples(index=False, name=None))
        for part in ranges(rows):
            if part[0][0] != name:
                if file:
                    file.close()
                name = part[0][0]
                file = store.open_input_file(f"{path}/{name}")
            start = part[0][1]
            data = file.read_at(part[-1][1] + part[-1][2] - start, start)
            out = []
            for _, offset, length, digest in part:
                head, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind = head["WARC-Type"]
                found = hashlib.sha256(block).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].partition(":")[2]
                if found != digest:
                    raise ValueError(f"{name} at {offset}: the payload is not the one that was indexed")
                size = len(block) if kind == "response" else int(head["WARC-Payload-Length"])
                url = head.get("WARC-Target-URI")
                out.append((
                    head.get("WARC-Page-ID"), None if url is None else _unclean(url), size, found, kind,
                    head.get("WARC-Refers-To-Page-ID"), block.decode("utf-8", "surrogatepass") if kind == "response" else None,
                ))
            yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
        if file:
            file.close()

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string"
    read = wanted.drop("_s").mapInPandas(run, schema)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads every record back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, **columns), folder)
