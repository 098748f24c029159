"""Archives are a driver matter: they are unpacked once to a folder that Spark can read, or packed from one file."""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path, PurePosixPath


def find_member(archive: str | Path, suffix: str) -> str:
    """The first member whose name ends with ``suffix``."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if name.endswith(suffix):
                return name
    raise FileNotFoundError(f"{archive} has no member ending with {suffix}")


def _safe(name: str) -> bool:
    parts = PurePosixPath(name).parts
    return not name.startswith(("__MACOSX/", "/")) and ".." not in parts


def extract_all(archive: str | Path, target: str | Path) -> Path:
    """Unpack once: a marker says that it was done. Mac metadata and paths that lead outside are left out."""
    target = Path(target)
    done = target / ".extracted"
    if not done.exists():
        target.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(archive) as z:
            z.extractall(target, [n for n in z.namelist() if _safe(n)])
        done.touch()
    return target


def extract_member(archive: str | Path, suffix: str, target: str | Path) -> Path:
    """Unpack one member to ``target`` unless a file of its size is there."""
    name, target = find_member(archive, suffix), Path(target)
    with zipfile.ZipFile(archive) as z:
        if not target.exists() or target.stat().st_size != z.getinfo(name).file_size:
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(name) as source, target.open("wb") as sink:
                shutil.copyfileobj(source, sink)
    return target


def pack(source: str | Path, archive: str | Path, name: str) -> Path:
    """An archive that holds one file as ``name``."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(source, name)
    return Path(archive)
