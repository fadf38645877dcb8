"""File systems as tasks open them by themselves."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it (a bare path is local), and the path there."""
    known = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    return pafs.FileSystem.from_uri(known) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", known) else (pafs.LocalFileSystem(), known)
