"""HTTP over an export and over a run's status: read-only lookups as JSON.

`python -m tracelith.plans.service EXPORT [PORT]` serves /api/health, /api/overview, /api/questions (search, mixed, diverse, sort)
and /api/questions/<id>. What `status` returns, if it is given, is served under /api/status.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.plans.export import Service

#: Rows of one answer: a page, not a table.
PAGE = 1000


def rows(df: DataFrame, most: int = PAGE) -> list[dict]:
    return [json.loads(r.json) for r in df.select(F.to_json(F.struct("*")).alias("json")).take(most)]


def answer(service: Service, target: str, status: Callable[[], DataFrame] | None = None) -> tuple[int, object]:
    """HTTP code and body of a request target."""
    at, said = urlsplit(target), {k: v[-1] for k, v in parse_qs(urlsplit(target).query).items()}
    parts = [unquote(p) for p in at.path.strip("/").split("/")]
    try:
        if parts == ["api", "health"]:
            return 200, {"status": "ok"}
        if parts == ["api", "overview"]:
            return 200, service.overview()
        if parts == ["api", "questions"]:
            yes = lambda k: said.get(k, "").lower() in ("1", "true", "yes")
            return 200, rows(service.questions(said.get("search", ""), yes("mixed"), yes("diverse"), said.get("sort", "signal")))
        if len(parts) == 3 and parts[:2] == ["api", "questions"]:
            return 200, service.question(parts[2])
        if parts == ["api", "status"] and status is not None:
            return 200, rows(status())
    except KeyError as missing:
        return (400, {"detail": f"unknown sort {missing}"}) if parts == ["api", "questions"] else (404, {"detail": f"no question {missing}"})
    return 404, {"detail": f"nothing at {at.path}"}


def server(service: Service, port: int = 0, status: Callable[[], DataFrame] | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            code, body = answer(service, self.path, status)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


if __name__ == "__main__":
    spark = SparkSession.builder.appName("tracelith").getOrCreate()
    server(Service(spark, sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 8000).serve_forever()
