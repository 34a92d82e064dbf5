"""Path algebra over URIs, for code that builds input and output names."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Path:
    scheme: str | None
    authority: str | None
    path: str

    @classmethod
    def from_url(cls, url: str) -> Path:
        s = urlsplit(url)
        return cls(s.scheme or None, s.netloc or None, s.path or ("/" if s.netloc else ""))

    @classmethod
    def from_path_string(cls, text: str) -> Path:
        if not text:
            raise ValueError("a path can't be empty")
        return cls.from_url(text) if "://" in text or text.startswith("file:") else cls(None, None, posixpath.normpath(text))

    @classmethod
    def from_scheme_auth_path(cls, scheme: str | None, authority: str | None, path: str) -> Path:
        if not path:
            raise ValueError("a path can't be empty")
        return cls(scheme, authority, path)

    def to_url(self) -> str:
        if self.scheme is None:
            return self.path
        return f"{self.scheme}://{self.authority or ''}{self.path}"

    def merge_paths(self, other: Path) -> Path:
        """``other``'s path below this one."""
        return Path(self.scheme, self.authority, posixpath.join(self.path, other.path.lstrip("/")))

    @property
    def is_url_path_absolute(self) -> bool:
        return self.path.startswith("/")

    @property
    def is_absolute(self) -> bool:
        return self.is_url_path_absolute

    @property
    def name(self) -> str:
        return posixpath.basename(self.path.rstrip("/"))

    @property
    def parent(self) -> Path | None:
        return None if self.is_root else Path(self.scheme, self.authority, posixpath.dirname(self.path.rstrip("/")))

    @property
    def is_root(self) -> bool:
        return self.path in ("/", "")
