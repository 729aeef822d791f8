"""Files by URI for Python data sources: local, HDFS, S3, GCS and Azure through Arrow."""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(URI, size) of a file, of a folder's files, or of those that a glob in the last part names; hidden ones are left out."""
    head, _, last = uri.rstrip("/").rpartition("/")
    glob = any(c in last for c in "*?[")
    files, path = open_fs(head if glob else uri)
    info = files.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    base = (head if glob else uri).rstrip("/")
    found = [(f"{base}/{i.base_name}", i.size) for i in files.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and i.base_name[0] not in "._"]
    return sorted(x for x in found if not glob or fnmatch.fnmatch(x[0].rpartition("/")[2], last))


def open_input(uri: str):
    """A random-access binary stream; compressed files are given as they are."""
    files, path = open_fs(uri)
    return files.open_input_file(path)


def open_output(uri: str):
    """A binary stream to a file; folders above it are made, and nothing is compressed by the file's name."""
    files, path = open_fs(uri)
    files.create_dir(path.rpartition("/")[0] or "/", recursive=True)
    return files.open_output_stream(path, compression=None)


def remove_others(folder: str, job: str, messages) -> None:
    """Delete the files of a write's attempts that didn't count: those with its job in their name but no message."""
    good = {m.path.rpartition("/")[2] for m in messages if m}
    for path, _ in list_files(folder) if good else []:
        name = path.rpartition("/")[2]
        if name.startswith("part-") and f"-{job}-" in name and name not in good:
            files, where = open_fs(path)
            files.delete_file(where)


def in_batches(rows, struct, most_rows: int = 4096, most_bytes: int = 8 << 20):
    """Rows (tuples in the order of a Spark schema) as Arrow batches, each of a bounded number of rows and some megabytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(struct)
    entries = lambda x: list(x.items()) if isinstance(x, dict) else x

    def batch(held):
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([entries(x) for x in c] if pa.types.is_map(f.type) else c, f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most_rows or size >= most_bytes:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)
