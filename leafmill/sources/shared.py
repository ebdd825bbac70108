"""Folders and files that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session where that is unset gets a temporary one; a cluster must set it, as
    its machines don't share their own folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the session ends."""
    folder = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def file_system(folder: str):
    """(file system of pyarrow, path in it)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder) if "://" in folder else FileSystem.from_uri(f"file://{os.path.abspath(folder)}")


def get(path: str) -> bytes:
    files, at = file_system(path)
    with files.open_input_stream(at) as source:
        return source.read()


def put(files, path: str, content: bytes) -> None:
    """Writes a file beside its place, to the disk, and then moves it there: readers see the old content or the new."""
    from pyarrow.fs import LocalFileSystem

    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    files.create_dir(folder, recursive=True)
    if isinstance(files, LocalFileSystem):
        with open(draft, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.replace(draft, path)
    else:
        with files.open_output_stream(draft) as out:
            out.write(content)
        files.move(draft, path)
