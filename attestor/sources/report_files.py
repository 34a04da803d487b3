"""Reports as files: a data source that writes one file a row.

spark.dataSource.register(ReportFiles)
reports.write.format("report_files").mode("append").save(path)     # name, text

Tasks write beside the target, in a folder of their own attempt. When all have ended, the files that successful attempts name go to the target and the
job's folder goes with whatever failed or repeated attempts left, so that readers never see a report twice or in part. mode("append") keeps reports of other names and
replaces those of the same; mode("overwrite") removes the others. The driver handles a name for each report.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from attestor.sources.multipart import filesystem


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def file_of(name: str) -> str:
    """The file of a report: its name, percent-encoded where a file system could object."""
    return (quote(name, safe=" ") or "%") + ".md"


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"], schema.fieldNames(), overwrite)


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if set(columns) != {"name", "text"}:
            raise ValueError(f"reports have name and text, not {columns}")
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = f"{self.path}/_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = filesystem(f"{self.job}/{uuid.uuid4().hex}")
        store.create_dir(folder, recursive=True)
        names = []
        for r in rows:
            if r["name"] is None:
                raise ValueError("a report has no name")
            with store.open_output_stream(f"{folder}/{file_of(r['name'])}") as out:
                out.write((r["text"] or "").encode())
            names.append(r["name"])
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, target = filesystem(self.path)
        done = [(m.folder, name) for m in messages if m for name in m.names]
        if len({name for _, name in done}) < len(done):
            self.abort(messages)
            raise ValueError("two reports have one name")
        store.create_dir(target, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            keep = {file_of(name) for _, name in done}
            for f in store.get_file_info(fs.FileSelector(target)):
                if f.is_file and f.base_name.endswith(".md") and f.base_name not in keep:
                    store.delete_file(f.path)
        for folder, name in done:
            store.move(f"{folder}/{file_of(name)}", f"{target}/{file_of(name)}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, job = filesystem(self.job)
        if store.get_file_info(job).type != fs.FileType.NotFound:
            store.delete_dir(job)
