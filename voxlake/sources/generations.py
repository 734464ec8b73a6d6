"""Stored vector generations: a data source whose commit publishes a generation whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "voxlake_vectors"
SCHEMA = "document_key string, source_content_hash string, embedding array<float>"
#: Texts of a call of the embedder, and rows of a written file.
BATCH, FILE_ROWS = 128, 50_000


class GenerationError(ValueError):
    """A generation does not hold one usable vector for each expected document: it is not published."""


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its files, rows, the sum of its rows' numbers and its vectors' dimensions."""

    files: list[str]
    rows: int
    total: int
    dimensions: list[int]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def row_number_of(document_key: str, content_hash: str) -> int:
    """60 bits that stand for a document's version; sums of them stand for sets (operators.documents.set_digest)."""
    return int(hashlib.sha256(f"{document_key}|{content_hash}".encode()).hexdigest()[:15], 16)


class GenerationWriter(DataSourceArrowWriter):
    """Tasks write files under names of their own; the driver's commit compares what they report with what is expected and then names the files in one file."""

    def __init__(self, options: dict[str, str]):
        self.path, self.generation = options["path"].rstrip("/"), options["generation"]
        self.rows, self.total = int(options["rows"]), int(options["total"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        import numpy as np
        import pyarrow.parquet as pq

        store, root = _store(self.path)
        part, held = Part([], 0, 0, []), []

        def flush() -> None:
            if held:
                name = f"{root}/files/{uuid.uuid4().hex}.parquet"
                with store.open_output_stream(name) as out:
                    pq.write_table(pa.Table.from_batches(held), out)
                part.files.append(name.removeprefix(f"{root}/"))
                held.clear()

        store.create_dir(f"{root}/files", recursive=True)
        for batch in iterator:
            for key, version, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or version is None or not vector or None in vector or not np.isfinite(vector).all() or not any(vector):
                    raise GenerationError(f"no usable vector for {key!r}")
                part.rows += 1
                part.total += row_number_of(key, version)
                if len(vector) not in part.dimensions:
                    part.dimensions.append(len(vector))
            held.append(batch)
            if sum(b.num_rows for b in held) >= FILE_ROWS:
                flush()
        flush()
        return part

    def commit(self, messages: list[Part]) -> None:
        parts = [m for m in messages if m is not None]
        dimensions = sorted({d for p in parts for d in p.dimensions})
        rows, total = sum(p.rows for p in parts), sum(p.total for p in parts)
        if len(dimensions) > 1 or (rows, total) != (self.rows, self.total):
            self.abort(messages)
            raise GenerationError(f"generation {self.generation}: {rows} rows of {self.rows} expected, dimensions {dimensions}, {'the' if total == self.total else 'not the'} expected set")
        store, root = _store(self.path)
        draft = f"{root}/{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"generation": self.generation, "files": [f for p in parts for f in p.files], "rows": rows, "dimensions": dimensions[0] if dimensions else None}).encode())
        store.move(draft, f"{root}/active.json")  # one rename: readers see the old generation or the new one

    def abort(self, messages: list[Part]) -> None:
        store, root = _store(self.path)
        for part in messages:
            for name in part.files if part is not None else []:
                store.delete_file(f"{root}/{name}")


class VectorGenerations(DataSource):
    """Options: path, generation, and rows and total of the expected documents (see rebuilt())."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> GenerationWriter:
        return GenerationWriter(dict(self.options))


def rebuilt(documents: DataFrame, path: str, generation: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> None:
    """Embed documents (document_key, content_hash, text) in batches, store the vectors as a generation and make it the active one.

    A GenerationError, whose cause is what Spark reports of a task, the embedder or the commit, leaves the former generation active; files of tasks that were
    not committed lie unnamed in the folder. The expected set is a count and a sum that Spark takes over all documents, so nothing
    but a row a task reaches the driver.
    """
    from voxlake.operators.vectors import embed

    spark = documents.sparkSession
    spark.dataSource.register(VectorGenerations)
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", "document_key", "content_hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    rows, total = documents.agg(F.count("*"), F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)"))).first()
    vectors = embed(documents, embedder, batch)
    writer = vectors.write.format(FORMAT).mode("append").option("path", path).option("generation", generation).option("rows", str(rows)).option("total", str(int(total)))
    try:
        writer.save()
    except (PySparkException, Py4JJavaError) as error:
        raise GenerationError(f"generation {generation} was not published") from error


def active(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """What is known of the active generation (generation, rows, dimensions), and its vectors; an empty one before the first."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{path}/active.json")
    if not place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place):
        return {"generation": None, "rows": 0, "dimensions": None}, spark.createDataFrame([], SCHEMA)
    known = json.loads("".join(r[0] for r in spark.read.text(f"{path}/active.json", wholetext=True).collect()))
    files = [f"{path}/{f}" for f in known.pop("files")]
    return known, spark.read.schema(SCHEMA).parquet(*files) if files else spark.createDataFrame([], SCHEMA)
