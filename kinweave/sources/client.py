"""A client of the music services, for `streaming.crawl.fetch` and the details of an entity.

It asks through any function from a URL to the body of the answer: `http` does so over the network, `recorded` from answers kept
in a table. Answers are held in memory for a day, at most so many of them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.values import MEMORY_TTL_SECONDS
from ..streaming.crawl import Transient, with_retry

MUSIC, PREVIEWS = "https://ws.audioscrobbler.com/2.0/", "https://itunes.apple.com/search"
#: Codes of answers that no further try changes: refused, unknown.
_FINAL, _UNKNOWN = {400, 401, 403, 404}, 6


def http(url: str, timeout: float = 10.0) -> str | None:
    """The body of a GET; None if it is refused or not there. Raises Transient for whatever may pass."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code in _FINAL:
            return None
        raise Transient(str(e)) from e
    except OSError as e:
        raise Transient(str(e)) from e


def recorded(answers: DataFrame) -> Callable[[str], str | None]:
    """Answers (url, body) that were kept; they go to the tasks with the function, so they are to be few."""
    held = {r["url"]: r["body"] for r in answers.select("url", "body").collect()}
    return held.get


class Memory:
    """The last `most` answers, each for `ttl` seconds."""

    def __init__(self, most: int = 10_000, ttl: float = MEMORY_TTL_SECONDS, now: Callable[[], float] = time.time):
        self.most, self.ttl, self.now, self.held = most, ttl, now, OrderedDict()

    def get(self, key: str, make: Callable[[], str | None]) -> str | None:
        at, value = self.held.get(key, (0.0, None))
        if key in self.held and self.now() - at < self.ttl:
            self.held.move_to_end(key)
            return value
        value = make()
        if value is not None:
            self.held[key] = (self.now(), value)
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return value


class Client:
    """Bodies of answers by service; parse them with `sources.service`, which does so for whole tables."""

    def __init__(self, get: Callable[[str], str | None] = http, key: str = "", memory: Memory | None = None, tries: int = 5, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.key, self.memory, self.tries, self.sleep = get, key, memory or Memory(), tries, sleep

    def _get(self, url: str) -> str | None:
        return self.memory.get(url, lambda: with_retry(lambda: self.fetch(url), self.tries, sleep=self.sleep))

    def _music(self, method: str, **given) -> str | None:
        return self._get(f"{MUSIC}?{urllib.parse.urlencode({'method': method, **given, 'api_key': self.key, 'format': 'json'}, quote_via=urllib.parse.quote)}")

    def info(self, artist: str) -> str | None:
        return self._music("artist.getinfo", artist=artist)

    def top_tracks(self, artist: str, limit: int = 5) -> str | None:
        return self._music("artist.gettoptracks", artist=artist, limit=limit)

    def similar(self, mbid: str | None, name: str | None, limit: int = 250) -> str | None:
        """By id, and by name if that finds nothing."""
        for given in ({"mbid": mbid} if mbid else None, {"artist": name} if name else None):
            body = self._music("artist.getsimilar", **given, limit=limit) if given else None
            if body and json.loads(body).get("error") != _UNKNOWN:
                return body
        return None

    def preview(self, artist: str, track: str) -> str | None:
        term = f"{artist} {track}".replace(" ", "+").replace("&", "and")
        return self._get(f"{PREVIEWS}?term={term}&media=music&entity=song&limit=1")
