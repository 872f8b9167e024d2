"""The entry points over HTTP: GET routes that answer with JSON.

`respond` is the whole service as a function; `serve` puts it behind Python's own server.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from . import api
from .config import Algorithm


class _Bad(ValueError):
    pass


def _rows(df: DataFrame) -> list[dict]:
    """Rows without what is null."""
    return [{k: v for k, v in json.loads(x).items() if v is not None} for x in df.toJSON().collect()]


def _options(q: dict[str, str], budget: bool = False) -> dict:
    out: dict = {"algorithm": q.get("algorithm", "bfs")}
    for name, kind in (("min_similarity", float), ("max_relations", int), *((("budget", int),) if budget else ())):
        if name in q:
            try:
                out[name] = kind(q[name])
            except ValueError:
                raise _Bad(f"{name} is no number") from None
    return out


def _need(q: dict[str, str], *names: str) -> list[str]:
    for n in names:
        if not q.get(n):
            raise _Bad(f"{n} is missing")
    return [q[n] for n in names]


def _path(lib: api.Library, q: dict[str, str]) -> dict:
    got = api.path_with_stats(lib, *_need(q, "from_id", "to_id"), **_options(q))
    steps = _rows(got["path"].drop("step"))
    out = {"artist_count": len(steps), "step_count": max(0, len(steps) - 1), "algorithm": Algorithm.parse(q.get("algorithm")).value, "search_stats": _rows(got["search_stats"])[0]}
    return out | ({"path": steps} if steps else {})


def _enhanced(lib: api.Library, q: dict[str, str]) -> dict:
    got = api.enhanced_path(lib, *_need(q, "from_id", "to_id"), **_options(q, True))
    status, stats = got["status"].first().asDict(), _rows(got["search_stats"])[0]
    named = got["path"].join(lib.entities.select("id", "name", "url"), "id", "left").orderBy("step").drop("step")
    out = {"status": status["status"], "data": None, "error": None, "search_stats": stats}
    if status["status"] == "success":
        nodes = _rows(got["nodes"])
        return out | {"data": {"primary_path": _rows(named), "nodes": nodes, "edges": _rows(got["edges"]), "total_artists": len(nodes)}}
    long = status["status"] == "path_too_long"
    message = f"The path has {status['path_length']} artists, more than the budget" if long else "There is no path"
    error = {"error_type": status["status"], "message": message, "path_length": status["path_length"], "minimum_budget_needed": status["minimum_budget_needed"]}
    return out | {"error": error | ({"primary_path": _rows(named)} if long else {})}


def _explore(lib: api.Library, q: dict[str, str], reverse: bool) -> dict:
    got = api.explore(lib, *_need(q, "artist_id"), reverse=reverse, **_options(q, True))
    nodes = _rows(got["nodes"])
    return {"center_artist": _rows(got["center"])[0], "nodes": nodes, "edges": _rows(got["edges"]), "total_found": len(nodes), "search_stats": _rows(got["search_stats"])[0]}


def _search(lib: api.Library, q: dict[str, str]) -> dict:
    if "q" not in q:
        raise _Bad("q is missing")
    found = _rows(api.search(lib, q["q"], int(q.get("limit", 10))))
    return {"query": q["q"], "results": found, "count": len(found)}


def respond(lib: api.Library, url: str) -> tuple[int, dict | list]:
    """(status code, answer) of a GET."""
    parts = urlsplit(url)
    q = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    routes = {
        "/health": lambda: {"status": "healthy", "message": "running"}, "/api/artists/search": lambda: _search(lib, q), "/api/path": lambda: _path(lib, q), "/api/enhanced_path": lambda: _enhanced(lib, q),
        "/api/explore": lambda: _explore(lib, q, False), "/api/explore_reverse": lambda: _explore(lib, q, True), "/api/stats": lambda: _rows(api.stats(lib))[0], "/api/artist/random": lambda: next(iter(_rows(api.random_entity(lib))), None),
    }
    try:
        if parts.path in routes:
            found = routes[parts.path]()
        elif parts.path.startswith("/api/artist/"):
            found = next(iter(_rows(api.details(lib, parts.path.removeprefix("/api/artist/")))), None)
        else:
            return 404, {"error": "no such route"}
    except ValueError as e:
        return 400, {"error": str(e)}
    return (404, {"error": "not found"}) if found is None else (200, found)


def serve(lib: api.Library, port: int = 3050, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            code, answer = respond(lib, self.path)
            body = json.dumps(answer).encode()
            self.send_response(code)
            for k, v in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
