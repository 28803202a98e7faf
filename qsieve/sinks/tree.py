"""A files table written as a tree: one file per row, the inverse of
`sources.files.read_tree`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _writer(root: str):
    """A `mapInArrow` function: (repo, path, content) → the number of files written."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs as pfs
        files, base = pfs.FileSystem.from_uri(root)
        base, made = base.rstrip("/"), set()
        for batch in batches:
            for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not {"", ".", ".."}.isdisjoint([*repo.split("/"), *path.split("/")]):
                    raise ValueError(f"not a path below a tree's root: {repo!r}, {path!r}")
                name = f"{base}/{repo}/{path}"
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(name) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    return write


def write_tree(files: DataFrame, root: str) -> int:
    """Write each row of files(repo, path, content) to `root`/repo/path and
    return the number of files.  Rows without content, the unreadable files,
    have no file.  (repo, path) must be unique, and `root` a path or URI that
    all executors share.  A task that runs again writes the same bytes again.
    A name that would leave the root fails the job."""
    rows = files.select("repo", "path", "content").where("content IS NOT NULL")
    return rows.mapInArrow(_writer(root), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
