"""File sources and sinks of the retrieval pipeline: JSON arrays, contents, indexes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

PAGE = "logical_page array<int>, pdf_page int, chapter string, section string, current_headings array<string>, content string"
CHUNK = "logical_page array<int>, pdf_page int, chapter string, section string, current_heading string, content string"
INDEXED = CHUNK + ", embedding array<float>"
QUESTION = "id string, category string, question string, gold_answer string, gold_printed_pages array<int>, answerable boolean"
BLOCKS = "struct<blocks:array<struct<location:string,content:string>>>"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read whole files that hold one JSON array each, with their position as ``seq``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("seq", "x")).select("seq", "x.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in _split(schema)))


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """Read a table of contents {chapter: [[section, [start, end]], ...]} in its own order."""
    text = spark.read.text(path, wholetext=True)
    chapters = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<array<string>>>"))).alias("chapter_ord", "e"))
    rows = chapters.select("chapter_ord", F.col("e.key").alias("chapter"), F.posexplode("e.value").alias("section_ord", "s"))
    ends = F.from_json(F.get("s", F.lit(1)), "array<int>")
    return rows.select("chapter_ord", "chapter", "section_ord", F.get("s", F.lit(0)).alias("section"), F.get(ends, F.lit(0)).alias("start"), F.get(ends, F.size(ends) - 1).alias("end"))


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with JSON rows, one a line, nulls kept; read_json_array() reads arrays only."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite ``path`` with one file that holds a JSON array of all rows, for tools that read whole files.

    The array is made in one place, so this is for reports and small exports.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"])
    df.agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Write an index of chunks, partitioned by chapter so that filters on it prune."""
    chunks.write.mode("overwrite").partitionBy("chapter").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read an index; it must have rows, and vectors of one length."""
    rows = spark.read.parquet(path)
    low, high = rows.agg(F.min(F.coalesce(F.size("embedding"), F.lit(-1))), F.max(F.size("embedding"))).first()
    if low is None:
        raise ValueError("the index is empty")
    if low < 1 or low != high:
        raise ValueError(f"the index has vectors of {low} to {high} components")
    return rows


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reads."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def is_current(spark: SparkSession, path: str, expected: int, force: bool = False) -> bool:
    """Whether a written index can be used again: it is there, and has as many rows."""
    return not force and is_there(spark, path) and spark.read.parquet(path).count() == expected


#: What stands for a page without text, and the lines of a report's head.
NO_TEXT = "*[Không có nội dung văn bản]*"
REPORT_HEAD = ("# {stem}", "", "- **Nguồn file:** `{name}`", "- **Thời gian xử lý:** {time}", "- **Phạm vi trang PDF gốc:** {first} -> {last} (Tổng: {total} trang)", "- **Model OCR (từ .env):** `{model}`", "", "---", "")


def markdown(pages: DataFrame) -> DataFrame:
    """Return (doc_id, page_seq, markdown) of pages with change flags: headings only where they change."""
    numbers = F.array_join(F.col("logical_page").cast("array<string>"), ", ")
    place = F.concat(F.lit("<!-- Trang logic "), numbers, F.lit(" (PDF Trang "), F.col("pdf_page").cast("string"), F.lit(") -->"))
    text = F.coalesce(F.expr("nullif(content, '')"), F.lit(NO_TEXT))
    parts = F.concat_ws("\n\n", F.when(F.col("new_chapter"), F.concat(F.lit("# "), "chapter")), F.when(F.col("new_section"), F.concat(F.lit("## "), "section")), place, text, F.lit("---"))
    return pages.select("doc_id", "page_seq", F.concat(parts, F.lit("\n")).alias("markdown"))


def write_markdown(pages: DataFrame, path: str, head: dict[str, str | int]) -> None:
    """Overwrite ``path`` with a report: its head, then all pages in order, in as many files as it takes.

    Files are in the order of their names, and rows within them.
    """
    lines = pages.sparkSession.createDataFrame([("", -1, "\n".join(REPORT_HEAD).format(**head))], "doc_id string, page_seq long, markdown string")
    body = markdown(pages).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_seq").cast("long").alias("page_seq"), "markdown")
    lines.unionByName(body).orderBy("doc_id", "page_seq").select("markdown").write.mode("overwrite").text(path)


def completed_prefix(rows: DataFrame, order: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Keep the rows before the first one without a vector: what a resumed run need not do again."""
    first = rows.agg(F.min(F.when(F.col(vector).isNull(), F.col(order))).alias("stop"))
    return rows.crossJoin(F.broadcast(first)).where(F.col("stop").isNull() | (F.col(order) < F.col("stop"))).drop("stop")


def run_stats(pages: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """Return one row with the counts of a run."""
    return pages.agg(F.count("*").alias("input_pages")).crossJoin(chunks.agg(F.count("*").alias("output_chunks"))).withColumn("output_file", F.lit(path))


def snippet(content, lines: int = 6):
    """The first lines of a text, with a mark if there are more."""
    parts = F.split(strip(content), "\n")
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(F.size(parts) > lines, "\n...").otherwise(""))


def numbered(chunks: DataFrame, order: str = "chunk_seq") -> DataFrame:
    """Add ``chunk_id`` from 0 in order within each document."""
    return chunks.withColumn("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1)


def required(options: dict[str, str | None], names: list[str]) -> dict[str, str]:
    """Return the named options; a missing or empty one is an error, never a default."""
    missing = [n for n in names if not options.get(n)]
    if missing:
        raise ValueError(f"missing options: {', '.join(missing)}")
    return {n: str(options[n]) for n in names}


def read_pdf_pages(spark: SparkSession, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Return (path, pdf_page, text) of PDF files in a page range; needs a PDF library on executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(frames):
        try:
            import pymupdf
        except ImportError as error:  # the library is optional, and absent in tests
            raise RuntimeError("reading PDF files needs pymupdf") from error
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                doc = pymupdf.open(stream=bytes(row.content), filetype="pdf")
                numbers = range(max(start, 1), min(end or len(doc), len(doc)) + 1)
                if not numbers:
                    raise ValueError("the page range is empty")
                yield pd.DataFrame({"path": row.path, "pdf_page": list(numbers), "text": [doc[n - 1].get_text() for n in numbers]})

    return files.mapInPandas(pages, "path string, pdf_page int, text string")
