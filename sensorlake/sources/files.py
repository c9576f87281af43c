"""Files in a folder that all machines see: one row a file, written and read by tasks. Spark's listings pass over empty files and over names that begin
with a dot or an underscore; read_hidden opens the latter by name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.sources.shared import new_path, written


def safe(path: Column) -> Column:
    """Whether a relative path stays inside its folder and names a file."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def store_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's content (text or bytes) as the file folder/path. path, bytes of all that is written.
    A file is written beside its place and moved there, so a task that runs again leaves the same files. Paths that would leave the folder raise an error."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                final = f"{root}/{name}"
                there.create_dir(final.rpartition("/")[0], recursive=True)
                with there.open_output_stream(f"{final}.part-tmp") as out:
                    out.write(data)
                there.move(f"{final}.part-tmp", final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in batch.column(1).to_pylist()], pa.int64())], ["path", "bytes"])

    given = rows.select(F.when(safe(F.col(path)), F.col(path)).otherwise(F.raise_error(F.concat(F.lit("not inside the folder: "), F.coalesce(path, F.lit("null"))))).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return written(given.mapInArrow(store, "path string, bytes long"), "stored")


def folder_of(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, as a URI that the writers open too."""
    path = new_path(spark, name)
    return f"file://{path}" if path.startswith("/") else path


def _below(folder: str) -> Column:
    return F.substring_index("path", f"{folder.rstrip('/').rpartition('/')[2]}/", -1).alias("path")


def read_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path (inside the folder), length, modificationTime, content of each file. Content is read only where a query asks for it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(folder).select(_below(folder), "length", "modificationTime", "content")


def read_texts(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path (inside the folder) and the whole text of each file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).select(_below(folder), "text")


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of every file, without its content; caches and version control are left out."""
    files = read_files(spark, folder).select("path", F.col("length").alias("size"))
    return files.where(~F.col("path").rlike(r"(^|/)(__pycache__|\.git)/"))


def read_hidden(products: DataFrame, folder: str, names: list[str]) -> DataFrame:
    """path, content of the files of these names in each product folder (column product) that has them. Listings pass over names that begin with a
    dot, so tasks open them by name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            wanted = [f"{p}/{n}" for p in batch.column(0).to_pylist() for n in names]
            found = [w for w, info in zip(wanted, there.get_file_info([f"{root}/{w}" for w in wanted]), strict=True) if info.type == fs.FileType.File]
            content = []
            for w in found:
                with there.open_input_stream(f"{root}/{w}") as f:
                    content.append(f.read())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    return products.select("product").mapInArrow(read, "path string, content binary")
