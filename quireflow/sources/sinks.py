"""Bundles as row sets: one Parquet table per artifact, by format, and text artifacts as JSON lines."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame


def plain(path: str) -> str:
    """A path in one form: without file:, absolute, with . and .. folded; of another store with its scheme and host."""
    u = urlsplit(path)
    if u.scheme in ("", "file"):
        return posixpath.abspath(u.path or path)
    return f"{u.scheme}://{u.netloc}{posixpath.normpath(u.path or '/')}"


def write_bundle(tables: dict[str, DataFrame], path: str, source: str | None = None, partition: str | None = None, mode: str = "overwrite") -> None:
    """Writes each table below path. Overwriting is by partition where one is named; the input's own folder is refused."""
    root = path.rstrip("/")
    if source and (plain(source) == plain(path) or plain(source).startswith(plain(path).rstrip("/") + "/")):
        raise ValueError("the output folder holds the input")
    for name, df in tables.items():
        w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(partition) if partition and partition in df.columns else w).parquet(f"{root}/{name}")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as JSON lines, nulls kept."""
    chunks.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    changes.write.mode(mode).json(path)
