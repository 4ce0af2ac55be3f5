"""Rollout log as one JSON document per flush: ``{"step": ..., "generations": [...], "num_samples": ...}``.

A Python data source: every task streams the documents of its flushes, row by row, into a pending folder; the commit, which sees one
name per flush, moves them to their place. So a document is there whole or not at all, and writing a flush again replaces it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from json.encoder import encode_basestring

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "rollout_flushes"
PENDING = "_pending"
_ROWS = 256

#: Schema of a document, for readers.
DOCUMENT = (
    "step bigint, num_samples bigint, generations array<struct<step:bigint,prompt_id:bigint,rollout_idx:bigint,prompt:string,completion:string,"
    "answer:string,ground_truth:string,is_selected:boolean,is_majority:boolean,direction_sign:int>>"
)
_TEXTS = ["step", "prompt_id", "rollout_idx", "prompt", "completion", "ground_truth"]
_FLAGS = ["answer", "is_selected", "is_majority", "direction_sign"]


#: One generation; the values are JSON already.
_LINE = "\n{" + ", ".join(f'"{n}": %s' for n in (*_TEXTS, *_FLAGS)) + "}"


def _json(value: object) -> str:
    """Texts and whole numbers, of which a log consists, without a detour over an encoder of any object."""
    if type(value) is str:
        return encode_basestring(value)
    if type(value) is int:
        return str(value)
    return "null" if value is None else "true" if value is True else "false" if value is False else json.dumps(value, ensure_ascii=False)


def flush_rows(texts: DataFrame, flags: DataFrame, flush: Column) -> DataFrame:
    """Rows in the order of the documents, flags before the text they belong to.

    ``texts``: ``step, prompt_id, rollout_idx, prompt, completion, ground_truth``; ``flags``: ``prompt_id, rollout_idx, answer, is_selected, is_majority,
    direction_sign``; ``flush`` is made of the prompt. Both sides go to their flush by one exchange and meet in its sort order: no join carries texts.
    """
    blank = lambda names, df: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    said = texts.select(flush.alias("flush_step"), F.lit(1).alias("kind"), *_TEXTS, *blank(_FLAGS, flags))
    marks = flags.select(
        flush.alias("flush_step"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("step"), "prompt_id", "rollout_idx", *blank(_TEXTS[3:], texts), *_FLAGS
    )
    key = ["flush_step", "prompt_id", "rollout_idx", "kind"]
    return said.unionByName(marks).repartition("flush_step").sortWithinPartitions(*key)


@dataclass
class Pending(WriterCommitMessage):
    """Documents that a task has finished, by their names under the pending folder and at their place."""

    files: list[tuple[str, str]]


class FlushWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _store(self) -> tuple[stores.FileSystem, str]:
        return stores.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pending:
        store, root = self._store()
        folder = posixpath.join(root, PENDING, uuid.uuid4().hex)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out, flush, count, marks = None, None, 0, None
        for batch in iterator:
            for lo in range(0, batch.num_rows, _ROWS):
                said: list[str] = []  # of the document that is open
                some = batch.slice(lo, _ROWS)
                columns = [some.column(n).to_pylist() for n in ("flush_step", "kind", *_TEXTS, *_FLAGS)]
                for step, kind, *row in zip(*columns, strict=True):
                    if out is None or step != flush:
                        if out is not None:
                            out.write("".join(said).encode())
                            self._end(out, count)
                        flush, count, said = step, 0, []
                        name = f"generations_step_{flush}.json"
                        files.append((posixpath.join(folder, name), posixpath.join(root, name)))
                        out = store.open_output_stream(files[-1][0])
                        said.append(f'{{"step": {flush}, "generations": [')
                    if kind == 0:
                        marks = row
                        continue
                    mine = marks is not None and row[1:3] == marks[1:3]
                    fields = [*row[: len(_TEXTS)], *(marks[len(_TEXTS) :] if mine else ("", False, False, 0))]
                    said.append(("," if count else "") + _LINE % tuple(map(_json, fields)))
                    count += 1
                if out is not None:
                    out.write("".join(said).encode())
        if out is not None:
            self._end(out, count)
        return Pending(files)

    @staticmethod
    def _end(out: pa.NativeFile, count: int) -> None:
        out.write(f'\n], "num_samples": {count}}}'.encode())
        out.close()

    def commit(self, messages: list[Pending | None]) -> None:
        store, _ = self._store()
        for pending, place in (f for m in messages if m for f in m.files):
            store.move(pending, place)
        self._clean(messages)

    def abort(self, messages: list[Pending | None]) -> None:
        self._clean(messages)

    def _clean(self, messages: list[Pending | None]) -> None:
        """The folders of these tasks; what a lost task left stays in the pending folder, which readers don't see."""
        store, _ = self._store()
        for folder in {posixpath.dirname(pending) for m in messages if m for pending, _ in m.files}:
            store.delete_dir(folder)


class RolloutFlushes(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FlushWriter:
        return FlushWriter(self.options["path"])


def write_flushes(rows: DataFrame, path: str) -> None:
    """Write the documents of ``flush_rows`` under ``path``; a flush that is there already is replaced."""
    rows.sparkSession.dataSource.register(RolloutFlushes)
    rows.write.format(FORMAT).mode("append").option("path", path).save()


def read_flushes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
