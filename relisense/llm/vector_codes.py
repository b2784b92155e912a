"""Product codes of vectors by integer codebooks, with a partial-distance search.

Components become integers; a vector is cut into equal parts, each part position has a
codebook of its own, refined by a fixed number of rounds and then used to code every
vector. Codebooks have a fixed size (PARTS x ENTRIES x components of a part), so they go to
the tasks by broadcast and back as sums: a round reads the vectors once, adds up per task
what falls to each entry, and shuffles no vector.

The nearest entry is searched dimension by dimension, in descending variance of the codebook:
the entry closest so far is measured completely, which bounds the others, and a mask drops
every entry whose sum so far strictly exceeds the bound of its vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from relisense.llm.shared import join_hot, shared_root

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors that are compared with a codebook together.
BLOCK = 8192
#: Sums of so many labels (about 50 bytes each) are broadcast.
BROADCAST_LABELS = 100_000


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of book closest to each row; ties to the lower index."""
    n, k, dims = len(rows), len(book), rows.shape[1]
    if not dims:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-np.var(book.astype(float), axis=0), kind="stable")
    rows, book = rows[:, order], book[:, order]
    # all pairs by the first dimension
    sums = (rows[:, :1] - book[:, 0][None, :]) ** 2
    first = sums.argmin(axis=1)
    best = ((rows - book[first]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for d in range(1, dims):
        sums = sums + (rows[row, d] - book[entry, d]) ** 2
        if d + 1 < dims:  # the closest so far is measured completely
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(sums, starts)
            hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            _, at = np.unique(row[hit], return_index=True)
            best = np.minimum(best, ((rows - book[entry[hit[at]]]) ** 2).sum(axis=1))
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    # every row still has its closest entries; rows and entries ascend
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least


def integral(vector: Column) -> Column:
    """Components times SCALE, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether the vector is there and all of its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, bad), F.lit(False))


def _parts(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, parts, components) of a column of lists, all of the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, dims // PARTS)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def codebooks(vectors: DataFrame, dims: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """(parts, entries, components): the final codebooks of (id, v), v an integral vector; None without any vector.

    They start as the vectors with the smallest ids (of equal ids the smaller vector first);
    vectors without id are left out there. If none has an id, there is nothing to start from.
    """
    spark = vectors.sparkSession
    first = vectors.where("id is not null").orderBy("id", "v").limit(entries).collect()  # a fixed number
    if not first:
        return None
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            book = sent.value
            total, count = np.zeros(book.shape, dtype=np.int64), np.zeros(book.shape[:2], dtype=np.int64)
            for b in _in_blocks(batches):
                x = _parts(b.column(0), dims)
                for p in range(PARTS):
                    at, _ = nearest(x[:, p], book[p])
                    np.add.at(total[p], at, x[:, p])
                    count[p] += np.bincount(at, minlength=len(book[p]))
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), "total": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

        sums = vectors.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
        width = dims // PARTS
        by = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        books = books.copy()
        for r in by.collect():  # a row per entry of a codebook
            books[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
        sent.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """((id_col, keep, code, error), codebooks): code has two hex digits a part.

    Vectors that are null or hold a null or a component that isn't finite are dropped; so is
    one whose length isn't that of the first vector by id, as it has no parts to compare. The
    length must be a multiple of PARTS. Components must be so small that distances fit 64 bits
    (2**19 in size for 64 dimensions); a larger one raises an error. Repeated rows each get
    their code, equal vectors equal ones; an id that is null stays null. Fewer vectors than
    entries make a smaller codebook. An empty table, or one without any id, gives no rows and
    no codebooks. Other columns, whatever their names, are not read.
    """
    spark = table.sparkSession
    shared_root(spark)
    rows = table.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], F.col(f"`{vector_col}`").alias("e")).where(usable(F.col("e")))
    first = rows.where("id is not null").agg(F.min_by(F.size("e"), F.struct("id", "e"))).first()[0]
    names = [id_col, *keep]
    out = StructType([*rows.drop("e").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    if first is None:
        return spark.createDataFrame([], out).toDF(*names, "code", "error"), None
    dims = int(first)
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    limit = int((2**62 / max(dims, 1)) ** 0.5 / 2 / SCALE)
    large = F.exists("e", lambda x: F.abs(x.cast("double")) >= limit)
    checked = F.when(large, F.raise_error(F.lit(f"a component of {limit} or more: distances would not fit 64 bits")).cast("array<long>")).otherwise(integral(F.col("e")))
    vectors = rows.where(F.size("e") == dims).withColumn("v", checked).drop("e")
    books = codebooks(vectors.select("id", "v"), dims, rounds, entries)
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        for b in _in_blocks(batches):
            x = _parts(b.column(b.num_columns - 1), dims)
            codes, error = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p in range(PARTS):
                at, distance = nearest(x[:, p], book[p])
                codes[:, p] = at
                error += distance
            text = codes.tobytes().hex()
            code = pa.array([text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(x))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], code, pa.array(error)], names=[*b.schema.names[:-1], "code", "error"])

    coded = vectors.select("id", *[f"keep{i}" for i in range(len(keep))], "v").mapInArrow(run, out)
    return coded.toDF(*names, "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with ``label_error``, the errors summed over equal labels, those without one together.

    Sums are made before anything is shuffled. Up to BROADCAST_LABELS labels they are broadcast
    back; beyond, labels that hold many rows are broadcast and the others meet in a shuffle.
    """
    shared_root(coded.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = coded.withColumn("_key", key).checkpoint()
    sums = rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums.drop("_rows")), "_key").drop("_key")
    return join_hot(rows, sums, "_key", "_rows").drop("_key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    all_books = F.lit(digest(books) if books is not None else None).cast("string")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", all_books.alias("codebooks_sha256"))


def _nearest_sql(rows: str, book: str) -> str:
    distance = " + ".join(f"(r.c{i} - b.c{i}) * (r.c{i} - b.c{i})" for i in range(4))
    return f"SELECT vec_id, part, min(({distance}) * 64 + entry) AS m FROM {rows} r JOIN {book} b USING (part) GROUP BY vec_id, part"


def _round_sql(k: int) -> dict[str, str]:
    means = ", ".join(f"floor(sum(c{i})::DOUBLE / count(*))::BIGINT AS c{i}" for i in range(4))
    chosen = ", ".join(f"coalesce(u.c{i}, b.c{i}) AS c{i}" for i in range(4))
    return {
        f"a{k}": _nearest_sql("parts", f"b{k}"),
        f"u{k}": f"SELECT part, m % 64 AS entry, {means} FROM a{k} JOIN parts USING (vec_id, part) GROUP BY part, m % 64",
        f"b{k + 1}": f"SELECT b.part, b.entry, {chosen} FROM b{k} b LEFT JOIN u{k} u ON u.part = b.part AND u.entry = b.entry",
    }


_CTES = {
    "kept": "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0",
    "parts": f"SELECT vec_id, part, {', '.join(f'v[4 * part + {i + 1}] AS c{i}' for i in range(4))} FROM kept, range(16) p(part)",
    "b0": "SELECT part, entry, c0, c1, c2, c3 FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id)",
    **_round_sql(0),
    **_round_sql(1),
    "last": _nearest_sql("parts", "b2"),
    "coded": "SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM last GROUP BY vec_id",
    "sha": "SELECT sha256(string_agg(c0 || ',' || c1 || ',' || c2 || ',' || c3, ',' ORDER BY part, entry)) AS s FROM b2",
}
#: For vectors of 64 components with ids of their own; distance and entry are one number, so that ties go to the lower entry.
SQL = f"WITH {', '.join(f'{k} AS ({v})' for k, v in _CTES.items())} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"
