"""Folders that all machines share, opened inside tasks.

They are named by URIs that pyarrow opens; ``s3a`` and ``s3n`` are read as ``s3``, and another scheme that it does not
know is an error.
"""

from __future__ import annotations

import re

import pyarrow.fs


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it that a URI names."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
