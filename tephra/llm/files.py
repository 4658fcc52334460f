"""Files in the shared folder that executors write, and read or memory-map.

Paths are URIs; pyarrow's file systems open them. A file on a mounted folder is mapped where it lies. One that lies in
a store is first copied to the executor's temporary folder, mapped and unlinked at once, so nothing stays behind.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def store(uri: str):
    """(file system, path) of a URI or local path."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:") if uri.startswith("file:/") else uri
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, chunks) -> None:
    """Write bytes under another name, then rename: a retried or speculative task leaves one whole file."""
    system, path = store(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(part, path)


def get(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def mapped(uri: str, dtype=np.uint8) -> np.ndarray:
    """The file as a read-only array in mapped memory."""
    from pyarrow import fs

    system, path = store(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as f:
        while chunk := f.read(1 << 22):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy.name, dtype, "r").view(np.ndarray) if os.path.getsize(copy.name) else np.zeros(0, dtype)


def array_bytes(arrays: dict[str, np.ndarray]):
    """The chunks of a file of named arrays, each on an 8-byte boundary so that it can be mapped."""
    import json

    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    head += b" " * (-len(head) % 8)
    yield np.uint64(len(head)).tobytes() + head
    for v in arrays.values():
        raw = np.ascontiguousarray(v).tobytes()
        yield raw + b"\x00" * (-len(raw) % 8)


def mapped_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, in mapped memory."""
    import json

    data = mapped(uri)
    size = int(np.frombuffer(data[:8].tobytes(), np.uint64)[0])
    out, at = {}, 8 + size
    for name, (kind, n) in json.loads(data[8 : 8 + size].tobytes()).items():
        end = at + np.dtype(kind).itemsize * n
        out[name] = data[at:end].view(kind)
        at = end + (-end % 8)
    return out
