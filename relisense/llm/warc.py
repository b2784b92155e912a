"""WARC archives with a two-level capture index.

Records are gzip members of ``.warc.gz`` files, so each can be read alone by offset and
length. The index holds one line per capture, sorted by reversed-host URL key, in
compressed blocks of a fixed number of lines. Above it lies a sparse directory with the
first key of each block, and above that one row per index part with its first and last key.
A lookup searches the part list, then the part's directory (both binary searches), reads
the one range that holds the block, and at last the range of the record itself.

All files lie in a folder that driver and executors share and are written through
``pyarrow.fs``, so local, HDFS and object-store addresses work alike. File names carry the
task attempt; only files of attempts that succeeded are named in the manifest.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from relisense.llm.shared import shared_folder

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: An archive is closed at this size before compression.
ARCHIVE_BYTES = 64 << 20
#: Index lines in one block.
BLOCK_LINES = 512
CAPTURES = "key string, file string, at long, size long, page_id long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path: ``com,example,www)/a?b=c``. Null: empty.

    Scheme, user, port and fragment are left out; what can't be parsed is its own key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _name(task) -> str:
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's digest and size come from the payload it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(), "payload_bytes": size if revisit else len(payload), "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): which earlier payload a record need not repeat.

    Among equal payloads of at least REVISIT_BYTES the largest page_id is stored; rows with
    that same page_id are all stored. Digests are grouped on narrow rows with partial
    aggregation; the page bodies are joined by page_id and digest, so that a payload which
    a third of the pages share does not gather in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = rows.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    stored = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    again = narrow.join(stored, "digest").where("page_id < refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left").drop("digest")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns where each one lies.

    Null html is an empty payload, null url an empty key; empty input writes no archive;
    repeated rows get a record each; other columns are not read. Rows without page_id are
    stored in full.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, path = _open(f"{folder}/archives")
        store.create_dir(path, recursive=True)
        stem, out, at, raw, n = _name(TaskContext.get()), None, 0, 0, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(batch["page_id"].tolist(), batch["url"].tolist(), batch["payload"].tolist(), batch["refers_to"].tolist(), strict=True):
                page_id, refers_to, url = (None if pd.isna(x) else x for x in (page_id, refers_to, url))
                page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                if out is None:
                    out, at, raw, n = store.open_output_stream(f"{path}/{stem}-{n:04d}.warc.gz", compression=None), 0, 0, n + 1
                record = record_bytes(page_id, url, bytes(payload), refers_to)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = gz.compress(record) + gz.flush()
                out.write(member)
                rows.append((url_key(url), f"{stem}-{n - 1:04d}.warc.gz", at, len(member), page_id))
                at, raw = at + len(member), raw + len(record)
                if raw >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            frame = pd.DataFrame(rows, columns=["key", "file", "at", "size", "page_id"])
            yield frame.assign(page_id=frame["page_id"].astype("Int64"))
        if out is not None:
            out.close()

    with_revisits(pages).mapInPandas(run, CAPTURES).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by key into compressed blocks; returns the part list (one row per part).

    Captures of one key may fill several parts: the range shuffle also orders by page_id
    and place, so no single key has to fit in one task.
    """
    spark = captures.sparkSession
    order = ["key", "page_id", "file", "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, path = _open(f"{folder}/index")
        store.create_dir(path, recursive=True)
        stem, at, held, directory, last, out = _name(TaskContext.get()), 0, [], [], "", None

        def flush() -> None:
            nonlocal at, out
            block = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            if out is None:
                out = store.open_output_stream(f"{path}/{stem}.blocks", compression=None)
            out.write(block)
            directory.append((held[0][0], at, len(block)))
            at += len(block)
            held.clear()

        for batch in batches:
            for row in batch[["key", "file", "at", "size"]].itertuples(index=False):
                held.append((row.key, row.file, int(row.at), int(row.size)))
                last = row.key
                if len(held) >= BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{stem}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pd.DataFrame({"part": [stem], "first_key": [directory[0][0]], "last_key": [last]})

    captures.select("key", "file", "at", "size", "page_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "part string, first_key string, last_key string").write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/parts")


def block_span(first_keys: list[str], key: str) -> range:
    """Blocks that can hold a key, by binary search over the blocks' first keys."""
    return range(max(0, bisect.bisect_left(first_keys, key) - 1), bisect.bisect_right(first_keys, key))


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """Places (key, file, at, size) of all captures of the distinct keys in ``keys.key``.

    The part list has a row per index part and is collected for the search over parts (its
    size is the number of partitions of the sort). Keys then meet in the task of their part,
    which reads the part's directory and only the blocks that the search names.
    """
    spark = keys.sparkSession
    parts = sorted((r["first_key"], r["last_key"], r["part"]) for r in spark.read.parquet(f"{folder}/parts").collect())
    firsts = [p[0] for p in parts]

    @F.pandas_udf("array<string>")
    def parts_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: [parts[i][2] for i in _parts_span(firsts, parts, k)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _open(f"{folder}/index")
        part, directory, starts, file, block_at, lines = None, [], [], None, -1, {}
        for batch in batches:
            rows = []
            for name, key in zip(batch["part"], batch["key"], strict=True):
                if name != part:
                    part, block_at, file = name, -1, store.open_input_file(f"{path}/{name}.blocks")
                    with store.open_input_file(f"{path}/{name}.directory") as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    starts = [x[0] for x in directory]
                for i in block_span(starts, key):
                    if i != block_at:
                        _, at, size = directory[i]
                        lines, block_at = {}, i
                        for line in zlib.decompress(file.read_at(size, at)).decode().split("\n"):
                            k, *place = json.loads(line)
                            lines.setdefault(k, []).append(place)
                    rows += [(key, *place) for place in lines.get(key, ())]
            yield pd.DataFrame(rows, columns=["key", "file", "at", "size"])

    wanted = keys.select("key").where("key is not null").distinct().select("key", F.explode(parts_of("key")).alias("part"))
    return wanted.repartition("part").sortWithinPartitions("part", "key").mapInPandas(run, "key string, file string, at long, size long")


def _parts_span(firsts: list[str], parts: list[tuple[str, str, str]], key: str) -> list[int]:
    end = bisect.bisect_right(firsts, key)
    i = max(0, bisect.bisect_left(firsts, key) - 1)
    return [j for j in range(i, end) if parts[j][1] >= key]


def fetch(places: DataFrame, folder: str) -> DataFrame:
    """Reads the records at (file, at, size) by ranges, archive by archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _open(f"{folder}/archives")
        name, file = None, None
        for batch in batches:
            rows = []
            for f, at, size in zip(batch["file"], batch["at"].tolist(), batch["size"].tolist(), strict=True):
                if f != name:
                    name, file = f, store.open_input_file(f"{path}/{f}")
                rows.append(parse_record(zlib.decompress(file.read_at(int(size), int(at)), 31)))
            frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return places.select("file", "at", "size").repartition("file").sortWithinPartitions("file", "at").mapInPandas(run, RECORDS)


@F.pandas_udf(StringType())
def url_key_col(url: pd.Series) -> pd.Series:
    return url.map(url_key)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_folder(spark, "warc")
    build_index(write_archives(pages, folder), folder)
    places = lookup(pages.select(url_key_col("url").alias("key")), folder)
    return fetch(places, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
