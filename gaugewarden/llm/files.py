"""Files that tasks write below the shared folder: temporary name first, then the final one."""

import uuid
from contextlib import contextmanager

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a plain path or of any address pyarrow can open (file, hdfs, s3, ...)."""
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@contextmanager
def committed(path: str):
    """A stream to a temporary name beside ``path``, renamed when the block ends well.

    Attempts of one task have names of their own, and as all write the same
    bytes it does not matter which one is renamed last.
    """
    system, name = file_system(path)
    folder, _, leaf = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_temporary-{leaf}-{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
    except BaseException:
        system.delete_file(temporary)
        raise
    system.move(temporary, name)


def write_bytes(path: str, data: bytes) -> None:
    with committed(path) as out:
        out.write(data)
