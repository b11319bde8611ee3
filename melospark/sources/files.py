"""Files of a shared store, opened from tasks by seeking, and written one by one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and name of a path as Spark writes it (``file:/x`` too); ValueError where pyarrow has none."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return pafs.LocalFileSystem(), "/" + (rest if rest else path).lstrip("/")
    try:
        return pafs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError) as e:
        raise ValueError(f"no file system for {scheme}") from e


def can_seek(path: str) -> bool:
    """Whether tasks can open files of this store."""
    try:
        located(path)
    except ValueError:
        return False
    return True


def write_files(rows: DataFrame, folder: str) -> None:
    """One file for each row (name, content), written by the tasks that hold them; written again, a file is the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = located(folder)
        system.create_dir(at, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with system.open_output_stream(f"{at}/{name}") as out:
                    out.write(content)
            yield pdf[["name"]]

    rows.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
