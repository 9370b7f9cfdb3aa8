"""ZIP archives as a sink: tasks write whole archives block by block, and a run is seen only once it is whole."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ranges import store_of

SCHEMA = "archive string, ordinal int, name string, block int, content binary"
#: Fixed time of all entries, so that equal entries give equal archives.
TIME = (1980, 1, 1, 0, 0, 0)


class _Told:
    """A stream that counts and digests what is written; it can't be sought in."""

    def __init__(self, stream):
        self.stream, self.digest, self.size = stream, hashlib.sha256(), 0

    def write(self, data) -> int:
        self.digest.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    folder: str


class ZipWriter(DataSourceWriter):
    """What a task writes stays in a folder of its own; the driver gets the folder's name, and at the end moves the files of
    the tasks that count. Other attempts' folders go.
    """

    def __init__(self, root: str):
        self.root, self.pending = root.rstrip("/"), f"{root.rstrip('/')}/_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, pending = store_of(self.pending)
        folder = uuid.uuid4().hex
        store.create_dir(f"{pending}/{folder}", recursive=True)
        lines = []
        for archive, own in groupby(rows, key=lambda r: r["archive"]):
            if not archive or archive[0] in "._" or "/" in archive or "\\" in archive:
                raise ValueError(f"no name of a file: {archive!r}")
            entries = 0
            with store.open_output_stream(f"{pending}/{folder}/{archive}") as stream:
                told = _Told(stream)
                with zipfile.ZipFile(told, "w", zipfile.ZIP_DEFLATED) as packed:
                    for (_, name), blocks in groupby(own, key=lambda r: (r["ordinal"], r["name"])):
                        entry = zipfile.ZipInfo(name, TIME)
                        entry.compress_type, entries = zipfile.ZIP_DEFLATED, entries + 1
                        with packed.open(entry, "w", force_zip64=True) as out:
                            for b in blocks:
                                out.write(b["content"] or b"")
            lines.append({"archive": archive, "entries": entries, "size": told.size, "sha256": told.digest.hexdigest()})
        if lines:
            with store.open_output_stream(f"{pending}/{folder}/_manifest") as stream:
                stream.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, pending = store_of(self.pending)
        _, root = store_of(self.root)
        store.create_dir(f"{root}/_manifest", recursive=True)
        for m in filter(None, messages):
            for file in store.get_file_info(fs.FileSelector(f"{pending}/{m.folder}")):
                to = f"_manifest/{m.folder}.json" if file.base_name == "_manifest" else file.base_name
                store.move(file.path, f"{root}/{to}")
        self._clear()
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, pending = store_of(self.pending)
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class ZipArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"])


def write_archives(blocks: DataFrame, path: str) -> None:
    """Writes blocks (archive, ordinal, name, block, content) as ZIP archives in the folder path.

    Entries go by ordinal, then name, their blocks by number; a null content is an empty block. An archive is one file and
    so written by one task, which holds a block of it; archives are dealt out. Archives appear when all are written, one of
    an equal name is replaced, and a failed run leaves none. Of each, path/_manifest has the number of entries, the size and
    the SHA-256. Names of archives have to be names of files; no rows write no archive. Equal rows give equal bytes.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(ZipArchives)
    rows = blocks.select("archive", "ordinal", "name", "block", "content").repartition("archive")
    rows.sortWithinPartitions("archive", "ordinal", "name", "block").write.format("zip_archives").option("path", path).mode("append").save()


def read_manifest(spark, path: str) -> DataFrame:
    """(archive, entries, size, sha256) of the archives written to path."""
    return spark.read.schema("archive string, entries long, size long, sha256 string").json(f"{path}/_manifest")
