"""Small reads over HTTP for ingest: a retry that backs off, and a cache of files with an age.

Meant for the driver or for one task per request; what is fetched lands as a file that Spark reads.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

DAY = 86_400


def get_json(url: str, params: dict | None = None, tries: int = 3, wait: float = 1.0, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The JSON at a URL; a busy server (429) and failures of the connection or the server are tried again after waits that
    double. None if all tries fail or the answer is another error."""
    full = url if not params else f"{url}?{urllib.parse.urlencode(params)}"
    for k in range(tries):
        try:
            with urllib.request.urlopen(full, timeout=timeout) as r:
                return json.loads(r.read().decode())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                return None
        except (OSError, ValueError):
            pass
        if k + 1 < tries:
            sleep(wait * 2**k)
    return None


def cached_json(path: str, fetch: Callable[[], object], days: float = 7, now: Callable[[], float] = time.time):
    """What is in the file if it is younger than `days`; else what fetch gives, which is written there. If that gives
    nothing, an old file still stands."""
    fresh = os.path.exists(path) and now() - os.path.getmtime(path) < days * DAY
    if not fresh:
        got = fetch()
        if got is not None:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            with open(f"{path}.part", "w") as f:
                json.dump(got, f)
            os.replace(f"{path}.part", path)
            return got
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)
