"""JSON Lines as a data source: ordered scans of folders, and writes that appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.registry import query, table
from lodestone.storage import shared_root, swap_text

NAME, SUFFIX, STAGING = "lodestone_jsonl", ".jsonl", "_staging-"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class File(InputPartition):
    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name


class Reader(DataSourceReader):
    """A partition for each file below the folder; what a write has not committed is not seen."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = sorted(f.path[len(root) :].lstrip("/") for f in found if f.is_file and f.path.endswith(SUFFIX))
        return [File(f"{root}/{n}", n) for n in names if not any(part.startswith("_") for part in n.split("/"))] or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = _opened(self.path)
        with files.open_input_stream(partition.path) as raw:
            rest, number = b"", 0
            while chunk := raw.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield partition.name, number, line.decode()
                    number += 1
            if rest:
                yield partition.name, number, rest.decode()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    """Each task writes into a folder of its own; the driver moves the files to their places when all tasks are done, and on a failure removes them."""

    def __init__(self, path: str, schema: StructType, file: str) -> None:
        self.path, self.file = path, file
        self.fields = [n for n in schema.names if n != file]
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _opened(self.path)
        folder, names, now, out = f"{root}/{self.staging}/{uuid.uuid4().hex}", [], None, None
        try:
            for row in iterator:
                name = row[self.file]
                if out is None or name != now:
                    if out is not None:
                        out.close()
                    if name is None or name in names or ".." in name.split("/"):
                        raise ValueError(f"rows of {name} don't come together" if name in names else f"no file name: {name}")
                    now = name
                    names.append(name)
                    files.create_dir(f"{folder}/{name}{SUFFIX}".rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}{SUFFIX}")
                record = {n: _plain(row[n]) for n in self.fields}
                out.write(json.dumps(record, ensure_ascii=False, default=str).encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        done = [(m.folder, n) for m in messages if m for n in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("two tasks wrote one file")
        for folder, name in done:
            target = f"{root}/{name}{SUFFIX}"
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(f"{folder}/{name}{SUFFIX}", target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


def _plain(value: object) -> object:
    """Rows, which are tuples, as dicts, also inside of lists and maps."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, line long, value string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options.get("file", "file"))


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """file (below path, in its order), line (from 0), and the record of each line: as columns of a schema, else as text.

    A missing or empty folder has no rows; a line that is no JSON has nulls in place of its columns.
    """
    spark.dataSource.register(JsonLines)
    rows = spark.read.format(NAME).option("path", path).load()
    return rows.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*") if schema else rows


def save(rows: DataFrame, path: str, file: Column, *order: str) -> None:
    """Writes the rows of each file name (a path below `path`, without suffix), sorted, as the lines of one file, which replaces what was there."""
    rows.sparkSession.dataSource.register(JsonLines)
    named = rows.withColumn("_file", file).repartition("_file").sortWithinPartitions("_file", *order)
    named.write.format(NAME).mode("append").option("path", path).option("file", "_file").save()


def save_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small JSON file of a run or a baseline, in one step: keys in order, numbers to four places."""

    def plain(x: object) -> object:
        return {str(k): plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else round(x, 4) if isinstance(x, float) else x

    swap_text(spark, path, json.dumps(plain(report), indent=2, sort_keys=True) + "\n")


# Fixed value: the kind of question that has no answer in the corpus.
UNANSWERABLE = "unanswerable"
QUESTIONS = (
    "id string, question string, ticker string, type string, gold_answer string, evidence array<struct<accession: string, char_start: long, char_end: long, quote: string>>, "
    "refusal_reason string, note string"
)


def problem() -> Column:
    """What is wrong with a row of an evaluation set (QUESTIONS); null for a sound one. Null evidence counts as none."""
    n = F.when(F.col("evidence").isNull(), 0).otherwise(F.size("evidence"))
    bad = F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["char_start"] >= e["char_end"], F.lit(True))), F.lit(False))
    none = F.col("type") == UNANSWERABLE
    said = F.when(bad, "a span does not end behind its start").when(F.col("type").isNull(), "no type").when(none & (n > 0), "evidence for what has no answer")
    return said.when(none & F.col("refusal_reason").isNull(), "no reason to refuse").when(~none & (n == 0), "an answer without evidence")


@query(
    "SELECT lang || '/' || source || '.jsonl' AS file, (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1)::BIGINT AS line, doc_id, n_chars, md5(text) AS digest FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"
)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a language's source, and what an ordered scan of the folder reads."""
    folder = f"{shared_root(spark)}/jsonl-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    save(docs, folder, F.concat_ws("/", "lang", "source"), "doc_id")
    found = scan(spark, folder, "doc_id long, text string, n_chars long")
    return found.select("file", "line", "doc_id", "n_chars", F.md5("text").alias("digest"))
