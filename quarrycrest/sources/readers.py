"""Readers with declared schemas; order within a file is always an explicit column."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrycrest.sources.schemas import CHUNK


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON array each; absent keys are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text files, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("ord", "line"))
    return lines.withColumn("ord", F.col("ord").cast("bigint"))


def if_there(read) -> DataFrame | None:
    """The DataFrame, or None where its path is missing."""
    try:
        df = read()
        df.schema  # noqa: B018 - resolves the path
        return df
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def chunk_sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame | None]:
    """Chunk records of each named JSON file, None for missing files."""
    return {name: if_there(lambda p=p: json_array(spark, p, CHUNK)) for name, p in paths.items()}


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, text) of PDF files.  Needs a PDF library on the workers."""

    def run(batches):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pypdf on the workers") from e
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(range(len(texts)), pa.int32()), pa.array(texts)], ["file", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, "file string, page int, text string")


def concat_pages(pages: DataFrame) -> DataFrame:
    """(file, text): page texts in order, a line end after every page; null is ''."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))))
    return pages.groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
