"""Readers for the studies' file layouts. One glob read covers all subjects; a missing file
just yields no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.functions.columns import nan_to_null

#: Fixed value: names a value column may have, in order of preference.
VALUE_COLUMNS = ("value", "bpm", "hr", "HR")
LABELS = "map<string, struct<labels_task2_1: array<string>, labels_task2_2: array<string>, labels_task2_3: array<array<string>>>>"


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header and given schema, NaN as NULL."""
    return nan_to_null(spark.read.csv(path, header=True, schema=schema))


def read_signals(spark: SparkSession, pattern: str, device: str) -> DataFrame:
    """(subject, device, channel, axis, t, value, pos) from ``.../<subject>/<device>_<channel>.csv``.

    Lines are read as text and parsed by each file's own header, so files of different
    columns (value, or x, y, z) come from one read. ``pos`` is the row's place in its file.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    schema = "subject string, device string, channel string, axis string, t double, value double, pos long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                subject, name = path.rsplit("/", 2)[-2:]
                rows = pd.read_csv(io.BytesIO(bytes(content)))
                at = rows["timestamp"] if "timestamp" in rows else rows.iloc[:, 0]
                axes = [c for c in ("x", "y", "z") if c in rows] or [next((c for c in VALUE_COLUMNS if c in rows), None)]
                if axes == [None]:
                    raise KeyError(f"no value column in {path}")
                for a in axes:
                    yield pd.DataFrame({"subject": subject, "device": device, "channel": name.rsplit(".", 1)[0].removeprefix(f"{device}_"), "axis": a if a in ("x", "y", "z") else None, "t": at.astype(float), "value": rows[a].astype(float), "pos": np.arange(len(rows), dtype=np.int64)})

    return nan_to_null(files.mapInPandas(run, schema))


def read_annotations(spark: SparkSession, pattern: str) -> DataFrame:
    """(subject, rater, seconds, valence, arousal) from ``.../P<subject>.<rater>.csv``.

    Files with a column ``seconds`` are relative to the task's start; others carry absolute
    times in their first column, kept in ``absolute``.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = re.search(r"P?(\w+?)\.(\w+)\.csv$", path.rsplit("/", 1)[-1])
                if not m:
                    continue
                rows = pd.read_csv(io.BytesIO(bytes(content)))
                own = lambda c, r=rows: r[c].astype(float) if c in r else np.nan
                yield pd.DataFrame({"subject": m[1], "rater": m[2], "seconds": own("seconds"), "absolute": np.nan if "seconds" in rows else rows.iloc[:, 0].astype(float), "valence": own("valence"), "arousal": own("arousal")}, index=rows.index)

    return nan_to_null(files.mapInPandas(run, "subject string, rater string, seconds double, absolute double, valence double, arousal double"))


def read_ordinal_csv(spark: SparkSession, path: str, id_name: str = "pid") -> DataFrame:
    """A small CSV whose row number is its key: adds ``id_name`` counting from 1.

    Such tables have a row per subject; they are read in one piece so that numbers follow
    the file.
    """
    rows = spark.read.csv(path, header=True)
    numbered = rows.coalesce(1).withColumn(id_name, (F.monotonically_increasing_id() + 1).cast("int"))
    return numbered.select(id_name, *rows.columns)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(item, task1, task2, task3) from a JSON object keyed by item."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", LABELS)).alias("item", "l")).select("item", F.col("l.labels_task2_1").alias("task1"), F.col("l.labels_task2_2").alias("task2"), F.col("l.labels_task2_3").alias("task3"))


def read_corpus(spark: SparkSession, path: str, key: str, prefix: str = "img_") -> DataFrame:
    """(item, text, prefix*) from a JSON array, the item being its field ``key``; of a repeated one the first object counts."""
    rows = spark.read.json(path, multiLine=True).withColumn("_at", F.monotonically_increasing_id())
    keep = [c for c in rows.columns if c.startswith(prefix)]
    cols = [F.min_by(F.col(c) if c in rows.columns else F.lit(None).cast("string"), "_at").alias(c) for c in ["text", *keep]]
    return rows.groupBy(F.col(key).cast("string").alias("item")).agg(*cols)


def read_record_list(spark: SparkSession, path: str) -> DataFrame:
    """(record): non-empty trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("record")).where("record <> ''")


def read_ground_truth(spark: SparkSession, records: str, acceptable: str, unacceptable: str) -> DataFrame:
    """(record, label): 1, 0, or NULL for unlisted records; a record in both lists is 0."""
    marks = read_record_list(spark, acceptable).withColumn("label", F.lit(1)).unionByName(read_record_list(spark, unacceptable).withColumn("label", F.lit(0)))
    return read_record_list(spark, records).distinct().join(marks.groupBy("record").agg(F.min("label").alias("label")), "record", "left")


def read_waveforms(spark: SparkSession, pattern: str, leads: int, fs: float, gain: float = 200.0) -> DataFrame:
    """(record, fs, leads) from binary files of interleaved little-endian 16-bit samples."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = np.frombuffer(bytes(content), dtype="<i2")
                m = raw[: len(raw) // leads * leads].reshape(-1, leads).T.astype(float) / gain
                m[m == -32768 / gain] = np.nan
                out.append((path.rsplit("/", 1)[-1].rsplit(".", 1)[0], fs, [list(x) for x in m]))
            yield pd.DataFrame(out, columns=["record", "fs", "leads"])

    return files.mapInPandas(run, "record string, fs double, leads array<array<double>>")


#: Bytes of a sample pair or sample, and the number that stands for a missing sample, by storage format.
FORMATS = {"16": -32768, "212": -2048}
HEADER = "record string, fs double, path string, format string, together int, signals array<struct<at:int,within:int,gain:double,baseline:double,name:string>>"
_SIGNAL = re.compile(r"(?P<file>\S+)\s+(?P<format>\d+)(?:x\d+)?(?::\d+)?(?:\+(?P<skip>\d+))?(?:\s+(?P<gain>[-+.\deE]+)(?:\((?P<base>-?\d+)\))?(?:/\S*)?)?(?:\s+(?P<res>\d+))?(?:\s+(?P<zero>-?\d+))?(?:\s+-?\d+)?(?:\s+-?\d+)?(?:\s+\d+)?(?:\s+(?P<name>.*))?")


def parse_header(text: str, folder: str) -> list[tuple]:
    """Rows of HEADER, one per signal file of a waveform header.

    A gain of 0 or none is 200 units; without a baseline the converter's zero is it. Formats
    16 and 212 are known, one sample of each signal per frame.
    """
    lines = [line for line in (x.strip() for x in text.splitlines()) if line and not line.startswith("#")]
    record, count, *more = lines[0].split()
    fs = float(re.match(r"[.\deE+-]+", more[0])[0]) if more else 250.0
    files: dict[str, list] = {}
    for at, line in enumerate(lines[1 : 1 + int(count)]):
        m = _SIGNAL.fullmatch(line)
        if m is None or m["format"] not in FORMATS or m["skip"]:
            raise ValueError(f"{record}: cannot read the signal line {line!r}")
        zero = float(m["zero"] or 0)
        kind, signals = files.setdefault(m["file"], [m["format"], []])
        if kind != m["format"]:
            raise ValueError(f"{record}: {m['file']} has two formats")
        signals.append((at, len(signals), float(m["gain"] or 0) or 200.0, float(m["base"]) if m["base"] else zero, m["name"] or ""))
    return [(record.split("/")[0], fs, f"{folder}/{file}", kind, len(s), s) for file, (kind, s) in files.items()]


def decode_samples(content: bytes, kind: str) -> np.ndarray:
    """Digital samples of a file in storage order: 16-bit little-endian, or pairs of 12 bits in three bytes."""
    if kind == "16":
        return np.frombuffer(content, dtype="<i2", count=len(content) // 2).astype(np.int32)
    raw = np.frombuffer(content, dtype=np.uint8)
    pairs = raw[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int32)
    both = np.stack([pairs[:, 0] | (pairs[:, 1] & 0x0F) << 8, pairs[:, 2] | (pairs[:, 1] & 0xF0) << 4], axis=1).ravel()
    if len(raw) % 3 == 2:  # a last sample without a partner
        both = np.append(both, int(raw[-2]) | (int(raw[-1]) & 0x0F) << 8)
    return np.where(both > 2047, both - 4096, both)


def read_records(spark: SparkSession, headers: str, signals: str) -> DataFrame:
    """(record, fs, names, leads) from waveform headers and the signal files that they name.

    headers, signals: patterns of the two kinds of files. Values are in physical units, gain and
    baseline by lead; samples marked as missing are NaN. A signal file is decoded in one task.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for text, path in zip(batch["value"], batch["path"], strict=True) for r in parse_header(text, path.rsplit("/", 1)[0])]
            yield pd.DataFrame(rows, columns=["record", "fs", "path", "format", "together", "signals"])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record, fs, kind, n, specs, content in batch[["record", "fs", "format", "together", "signals", "content"]].itertuples(index=False):
                digital = decode_samples(bytes(content), kind)
                frames = digital[: len(digital) // n * n].reshape(-1, n).astype(float)
                frames[frames == FORMATS[kind]] = np.nan
                out += [(record, fs, s["at"], s["name"], ((frames[:, s["within"]] - s["baseline"]) / s["gain"]).tolist()) for s in specs]
            yield pd.DataFrame(out, columns=["record", "fs", "at", "name", "samples"])

    found = spark.read.text(headers, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).mapInPandas(heads, HEADER)
    files = spark.read.format("binaryFile").load(signals).select("path", "content")
    leads = found.join(files, "path").mapInPandas(decoded, "record string, fs double, at int, name string, samples array<double>")
    by = leads.groupBy("record", "fs").agg(F.array_sort(F.collect_list(F.struct("at", "name", "samples"))).alias("l"))  # a row per lead
    return by.select("record", "fs", F.col("l.name").alias("names"), F.col("l.samples").alias("leads"))


def read_trials(spark: SparkSession, path: str, key: str, fmt: str = "parquet") -> DataFrame:
    """A trial table with its key column as text; spreadsheets are to be exported to CSV or Parquet."""
    rows = spark.read.csv(path, header=True, inferSchema=True) if fmt == "csv" else spark.read.format(fmt).load(path)
    return nan_to_null(rows.withColumn(key, F.col(key).cast("string")))


def inspect(df: DataFrame, rows: int = 5) -> DataFrame:
    """(column, type, n, nulls, least, largest) for a look at a new table."""
    parts = df.agg(*[F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.min(f"`{c}`").cast("string").alias("least"), F.max(f"`{c}`").cast("string").alias("largest")).alias(f"_{i}") for i, (c, t) in enumerate(df.dtypes) if not t.startswith(("map", "array", "struct"))])
    named = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{i}.n").alias("n"), F.col(f"_{i}.nulls").alias("nulls"), F.col(f"_{i}.least").alias("least"), F.col(f"_{i}.largest").alias("largest")) for i, (c, t) in enumerate(df.dtypes) if f"_{i}" in parts.columns]
    return parts.select(F.inline(F.array(*named)))
