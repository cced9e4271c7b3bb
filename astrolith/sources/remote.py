"""Files behind URLs: ranged HTTP reads, and a hook for other schemes.

A file is any object with read, seek and close.  What is registered here is pickled with the source,
so executors open URLs as the driver does.
"""

from __future__ import annotations

import io
import urllib.error
import urllib.request

from .. import errors
from .header import LIMITS

#: Bytes that are fetched ahead at a time.
AHEAD = 1 << 18


class HttpFile(io.RawIOBase):
    """A seekable file that fetches what is read by ranged requests.

    A server that ignores ranges sends the whole body, which is then held, up to the allocation
    limit.  The size comes from a HEAD request, else from the first answer's Content-Range.
    """

    def __init__(self, url: str, timeout: float = 60.0):
        super().__init__()
        self.url, self.timeout, self.at, self.whole, self.size = url, timeout, 0, None, None
        self.begin, self.held = 0, b""
        try:
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:  # noqa: S310
                self.size = int(r.headers["Content-Length"]) if r.headers["Content-Length"] else None
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise errors.NotFound(url) from None
        except urllib.error.URLError as e:
            raise errors.ReadFailed(f"{url}: {e.reason}") from None
        if self.size is None:
            self._fetch(0, 1)
        if self.size is None:
            raise errors.ReadFailed(f"{url}: no size")

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, size: int = -1) -> bytes:
        end = self.size if size is None or size < 0 else min(self.size, self.at + size)
        if end <= self.at:
            return b""
        if self.whole is not None:
            data = self.whole[self.at : end]
        else:
            if not self.begin <= self.at <= end <= self.begin + len(self.held):
                self.begin, self.held = self.at, self._fetch(self.at, max(end, min(self.size, self.at + AHEAD)))
            data = self.held[self.at - self.begin : end - self.begin]
        self.at += len(data)
        return data

    def _fetch(self, first: int, end: int) -> bytes:
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{end - 1}"})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                if r.status == 206:
                    total = (r.headers["Content-Range"] or "").rpartition("/")[2]
                    self.size = int(total) if total.isdigit() else self.size
                    return r.read()
                data = r.read(LIMITS["allocation"] + 1)
                if len(data) > LIMITS["allocation"]:
                    raise errors.LimitExceeded(self.url)
                self.whole, self.size = data, len(data)
                return data[first:end]
        except urllib.error.HTTPError as e:
            if e.code == 416:  # beyond the end
                return b""
            raise (errors.NotFound if e.code == 404 else errors.ReadFailed)(f"{self.url}: {e.code}") from None
        except urllib.error.URLError as e:
            raise errors.ReadFailed(f"{self.url}: {e.reason}") from None


#: By scheme: what opens a URL.
OPENERS = {"http": HttpFile, "https": HttpFile}


def register(scheme: str, opener) -> None:
    """Let opener(url) open the files of a scheme."""
    OPENERS[scheme.lower()] = opener


def scheme_of(path: str) -> str | None:
    """The scheme of a URL that is no local file."""
    scheme, colon, _ = path.partition("://")
    return scheme.lower() if colon and scheme.lower() != "file" else None


def open_url(url: str):
    opener = OPENERS.get(scheme_of(url) or "")
    if opener is None:
        raise errors.NotFound(f"nothing opens {url}; sources.content reads whole files through Spark")
    return opener(url)
