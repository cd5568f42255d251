"""Match files: a data source writer that makes one named CSV file per file id.

``records.write.format("match_files").save(path)`` puts the points of every record into
``<path>/window_size=…/detector=…/source_pol=…/<file id>.csv``. A file is written under a hidden name and
renamed when it is whole. Its name and content follow from the record alone, so a task that is run again,
or twice at a time, leaves the same file. What tasks wrote comes back in their commit messages: committing
adds it up in ``_SUCCESS``, aborting removes it. Rows of one file must come one after the other (see
``writers.write_match_files``).

Files are reached through ``pyarrow.fs``, so ``path`` may be any URI that it knows or a local path.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tiepoints import schemas

FORMAT = "match_files"
EXTENSION = ".csv"
PARTITIONS = ("window_size", "detector", "source_pol")
#: What Hive-style folder names stand for, and what they escape.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f") | {chr(i) for i in range(1, 32)}


def escaped(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in text)


def folder(row: Any) -> str:
    values = ((name, row[name]) for name in PARTITIONS)
    return "/".join(f"{name}={NULL_PARTITION if v is None or v == '' else escaped(str(v))}" for name, v in values)


def cell(value: float | None) -> str:
    """Text that Spark's CSV reader takes for the same number."""
    if value is None:
        return ""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Inf" if value > 0 else "-Inf"
    return repr(float(value))


def lines(row: Any) -> str:
    lists = [row[name] for name in schemas.RECORD_LISTS]
    return "".join(",".join(map(cell, point)) + "\n" for point in zip(*lists, strict=True))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its files, and their rows."""

    files: list[str]
    rows: int


class MatchFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("match files are appended; give a new path to start over")
        self.path = path.rstrip("/")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._store()
        done, rows, attempt = Written([], 0), 0, uuid.uuid4().hex
        current, out, hidden, made = None, None, None, set()

        def close() -> None:
            out.close()
            store.move(f"{base}/{hidden}", f"{base}/{current}")
            done.files.append(current)

        for row in iterator:
            if row["file_id"] is None:
                raise ValueError("a record without file id has no file")
            at = folder(row)
            name = f"{at}/{escaped(row['file_id'])}{EXTENSION}"
            if name != current:
                if out:
                    close()
                if at not in made:
                    store.create_dir(f"{base}/{at}", recursive=True)
                    made.add(at)
                current, hidden = name, f"{at}/.{attempt}-{len(done.files)}"
                out = store.open_output_stream(f"{base}/{hidden}")
                out.write((",".join(schemas.RECORD_LISTS) + "\n").encode())
            text = lines(row)
            out.write(text.encode())
            rows += text.count("\n")
        if out:
            close()
        done.rows = rows
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        store.create_dir(base, recursive=True)
        told = [m for m in messages if m is not None]
        total = {"files": sum(len(m.files) for m in told), "rows": sum(m.rows for m in told)}
        with store.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(json.dumps(total).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        for message in messages:
            for name in message.files if message else ():
                if store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    store.delete_file(f"{base}/{name}")


class MatchFiles(DataSource):
    """Write only; ``readers.read_match_files`` reads the files with Spark's own reader."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file_id", schemas.STRING), *schemas.MATCH_ROW.fields])

    def writer(self, schema: T.StructType, overwrite: bool) -> MatchFileWriter:
        missing = {"file_id", *PARTITIONS, *schemas.RECORD_LISTS} - set(schema.names)
        if missing:
            raise ValueError(f"match records lack {sorted(missing)}")
        return MatchFileWriter(self.options["path"], overwrite)
