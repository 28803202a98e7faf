"""Documents written by many tasks, as a Python data source.

    spark.dataSource.register(document_source())
    fragments.write.format("documents").mode("append").save(folder)

fragments has (repo, format, offset, fragment) of document_fragments, in any
order.  Every task writes its fragments at their byte offsets, so one
document's parts come from any number of tasks, and a task that runs twice
writes the same bytes again.  All goes to a staging folder beside `folder`;
commit renames it, so the documents appear together or not at all; abort
deletes it.  A document of repository r is `<two hex digits of its name's
crc32>/<r, percent-encoded>.<format's ending>`.

The folder is a path on a file system that driver and executors share and that
allows writing at an offset (POSIX, NFS); it must not exist yet.  An object
store does not allow that: there, write the fragments in order as text parts.
"""

from __future__ import annotations


def document_source() -> type:
    """The data source's class.  All it needs is nested here, so executors
    need not import this package."""
    import os
    import shutil
    import uuid
    import zlib
    from dataclasses import dataclass
    from itertools import chain
    from urllib.parse import quote, unquote, urlparse

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    endings = {"sarif": "sarif", "cbom": "cdx.json", "json": "json"}
    most = 1 << 20  # bytes of neighbouring fragments written at once

    @dataclass
    class Written(WriterCommitMessage):
        n_bytes: int

    class Writer(DataSourceArrowWriter):
        def __init__(self, folder: str) -> None:
            self.folder, self.staging = folder, f"{folder}.{uuid.uuid4().hex}"
            if os.path.exists(folder):
                raise FileExistsError(f"{folder}: documents go to a new folder")
            os.makedirs(self.staging)

        def file(self, name: tuple[str, str]) -> str:
            file = f"{quote(name[0], safe=' ')}.{endings[name[1]]}"
            part = f"{self.staging}/{zlib.crc32(file.encode()) & 0xFF:02x}"
            os.makedirs(part, exist_ok=True)
            return f"{part}/{file}"

        def put(self, name: tuple[str, str], offset: int, pieces: list[bytes]) -> int:
            data, done = b"".join(pieces), 0
            handle = os.open(self.file(name), os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                while done < len(data):
                    done += os.pwrite(handle, data[done:], offset + done)
            finally:
                os.close(handle)
            return done

        def write(self, iterator) -> Written:
            total, name, begin, end, held = 0, None, 0, 0, []
            for repo, fmt, offset, text in chain.from_iterable(zip(*(b[c].to_pylist() for c in ("repo", "format", "offset", "fragment"))) for b in iterator):
                if held and ((repo, fmt) != name or offset != end or end - begin >= most):
                    total += self.put(name, begin, held)
                    held = []
                if not held:
                    name, begin, end = (repo, fmt), offset, offset
                held.append(text.encode())
                end += len(held[-1])
            return Written(total + (self.put(name, begin, held) if held else 0))

        def commit(self, messages) -> None:
            there = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(self.staging) for f in files)
            told = sum(m.n_bytes for m in messages if m)
            if there != told:
                raise OSError(f"{there} bytes of documents are there, {told} were written")
            os.rename(self.staging, self.folder)

        def abort(self, messages) -> None:
            shutil.rmtree(self.staging, ignore_errors=True)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return "documents"

        def schema(self) -> str:
            return "repo string, format string, offset long, fragment string"

        def writer(self, schema, overwrite: bool) -> Writer:
            path = self.options["path"]
            url = urlparse(path)
            if url.scheme not in ("", "file"):
                raise ValueError(f"{path}: not a path that tasks can write to at an offset")
            return Writer((unquote(url.path) if url.scheme else path).rstrip("/"))

    return Documents


def write_documents(fragments, folder: str) -> None:
    """Write the documents of document_fragments under `folder`."""
    spark = fragments.sparkSession
    spark.dataSource.register(document_source())
    fragments.select("repo", "format", "offset", "fragment").write.format("documents").mode("append").save(folder)
