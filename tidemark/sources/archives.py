"""Members of archives: zip, tar and gzip, nested, within limits. Works on bytes, so it runs wherever the bytes are."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

BUFFER = 64 << 10
DEPTH = 8


class TooLarge(Exception):
    pass


@dataclass
class Limits:
    entry: int = 4 << 30
    total: int = 8 << 30
    used: int = 0
    skipped: list[tuple[str, str]] = field(default_factory=list)

    def read(self, stream, knob: str = "entry_bytes") -> bytes:
        """All of a stream, in pieces; too much is an error that names the setting."""
        out, n = [], 0
        while piece := stream.read(BUFFER):
            n += len(piece)
            self.used += len(piece)
            if n > self.entry:
                raise TooLarge(f"an entry is larger than correspondence.{knob} ({self.entry} bytes)")
            if self.used > self.total:
                raise TooLarge(f"entries are larger than correspondence.total_bytes ({self.total} bytes) together")
            out.append(piece)
        return b"".join(out)


def archive_kind(name: str) -> str | None:
    name = name.lower()
    if name.endswith((".tar", ".tgz", ".tar.gz")):
        return "tar"
    return "zip" if name.endswith(".zip") else "gzip" if name.endswith(".gz") else None


def unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or ":" in name.split("/")[0] or ".." in name.replace("\\", "/").split("/")


def members(name: str, data: bytes, limits: Limits) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of an archive's regular files, by name; unsafe names are skipped and noted."""
    kind = archive_kind(name)
    found: list[tuple[str, bytes]] = []
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if unsafe(info.filename):
                    limits.skipped.append((name, info.filename))
                    continue
                with z.open(info) as f:
                    found.append((info.filename, limits.read(f)))
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if not info.isfile() or unsafe(info.name):
                    if not info.isdir():
                        limits.skipped.append((name, info.name))
                    continue
                found.append((info.name.removeprefix("./"), limits.read(t.extractfile(info))))
    elif kind == "gzip":
        base = name.rsplit("/", 1)[-1]
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            found.append((base[: -len(".gz")], limits.read(f, "gzip_bytes")))
    yield from sorted(found)


def expanded(path: str, data: bytes, limits: Limits, depth: int = 0) -> Iterator[tuple[str, bytes, bool]]:
    """(path, bytes, is an archive) of a file and all that is inside it."""
    kind = archive_kind(path) if depth < DEPTH else None
    inner: list[tuple[str, bytes]] = []
    if kind:
        try:
            inner = list(members(path, data, limits))
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
            kind = None  # not what its name says: an opaque file
    yield path, data, bool(kind)
    for name, content in inner:
        first, _, rest = name.partition("/")
        yield from expanded(f"{path}/>{first}" + (f"/{rest}" if rest else ""), content, limits, depth + 1)
