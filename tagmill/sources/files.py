"""Files behind a path option: lists, folders and patterns, in any store that Arrow reads."""

from __future__ import annotations

from fnmatch import fnmatch

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(path: str, ending: str = "") -> list[tuple[str, int]]:
    """Path and size of all files of a comma list, in order of the list, then of names.

    A folder stands for its files that end so and are not hidden by a dot or underscore, a
    pattern for those in its folder that match. Nothing found is an error.
    """
    out = []
    for part in path.split(","):
        store, inner = store_of(part)
        prefix = part.removesuffix(inner)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            out.append((part, info.size))
            continue
        folder, pattern = (inner, None) if info.type == fs.FileType.Directory else (inner.rsplit("/", 1)[0] if "/" in inner else ".", inner.rsplit("/", 1)[-1])
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        own = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (fnmatch(f.base_name, pattern) if pattern else f.base_name.endswith(ending) and f.base_name[0] not in "._"))
        if not own:
            raise FileNotFoundError(part)
        out += [(prefix + p, size) for p, size in own]
    return out
