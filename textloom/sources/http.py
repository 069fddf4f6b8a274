"""One HTTP GET with limits, for the live fetcher."""

from __future__ import annotations

import socket
import urllib.error
import urllib.request

USER_AGENT = "textloom/0.1"
TIMEOUT_S = 10
MAX_REDIRECTS = 5
MAX_BYTES = 5 * 1024 * 1024


class Timeout(Exception):
    """No answer in time."""


class NetworkError(Exception):
    """The host could not be found or reached."""


class HttpError(Exception):
    """Too many redirects, too large a body, or a broken answer."""


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MAX_REDIRECTS
    max_repeats = MAX_REDIRECTS


def get(url: str, timeout: float = TIMEOUT_S, max_bytes: int = MAX_BYTES) -> tuple[int, str, str, str]:
    """``(status, body, final_url, content_type)``; error statuses are answers, failures raise."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
        answer = urllib.request.build_opener(_Redirects).open(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        if 300 <= e.code < 400:
            raise HttpError(str(e)) from e
        answer = e
    except (TimeoutError, socket.timeout) as e:
        raise Timeout(str(e)) from e
    except urllib.error.URLError as e:
        raise (Timeout if isinstance(e.reason, TimeoutError) else NetworkError)(str(e)) from e
    except (ValueError, OSError) as e:
        raise NetworkError(str(e)) from e
    try:
        with answer:
            body = answer.read(max_bytes + 1)
            if len(body) > max_bytes:
                raise HttpError("body too large")
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                text = body.decode(charset, "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            return answer.status, text, answer.geturl(), answer.headers.get("Content-Type", "")
    except (TimeoutError, socket.timeout) as e:
        raise Timeout(str(e)) from e
