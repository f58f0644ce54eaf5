"""Files as Python data sources see them: any file system that pyarrow knows, and whole lines of a byte range."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs

BLOCK_BYTES = 4 << 20
SPLIT_BYTES = 128 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    return system, path.rstrip("/") or "/"


def data_files(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file itself, or all files below a folder in the order of their paths; hidden names do not count."""
    if system.get_file_info(path).type == fs.FileType.File:
        return [system.get_file_info(path)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = ("_", ".")
    names = [(info, info.path[len(path) :].strip("/").split("/")) for info in found if info.type == fs.FileType.File]
    return sorted((i for i, parts in names if not any(p.startswith(hidden) for p in parts)), key=lambda i: i.path)


def line_blocks(stream, lo: int, hi: int, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The lines that begin in bytes ``lo`` to ``hi - 1``, whole, some MB at a time."""
    at, started, rest = max(lo - 1, 0), lo == 0, []
    while at < hi:
        piece = stream.read_at(min(block_bytes, hi - at), at)
        if not piece:
            break
        at += len(piece)
        if not started:
            cut = piece.find(b"\n") + 1
            if not cut:
                continue
            piece, started = piece[cut:], True
        cut = piece.rfind(b"\n") + 1
        if cut:
            yield b"".join((*rest, piece[:cut]))
            rest = []
        if cut < len(piece):
            rest.append(piece[cut:])
    while rest:
        piece = stream.read_at(64 << 10, at)
        cut = piece.find(b"\n") + 1
        if cut or not piece:
            yield b"".join((*rest, piece[:cut]))
            return
        rest.append(piece)
        at += len(piece)
