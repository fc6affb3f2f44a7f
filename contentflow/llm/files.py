"""Files of the operators' own formats in the shared folder.

Tasks write under names that no other attempt uses and report them; only names that a finished job has
reported are read, so a lost executor or a second attempt leaves nothing but an unread file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI; the folder is made if it is missing."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path


def new_name(stem: str, suffix: str) -> str:
    return f"{stem}-{uuid.uuid4().hex}{suffix}"
