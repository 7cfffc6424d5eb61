"""Files by path or address, on whatever file system pyarrow opens from an executor."""

from __future__ import annotations

from pyarrow import NativeFile, fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def opened(path: str) -> NativeFile:
    system, inside = located(path)
    return system.open_input_file(inside)


def exists(path: str) -> bool:
    system, inside = located(path)
    return system.get_file_info(inside).type == fs.FileType.File


def listed(path: str, ending: str) -> list[str]:
    """The file, or the files of a folder with that ending, as addresses that ``opened`` takes."""
    system, inside = located(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.path.endswith(ending))
