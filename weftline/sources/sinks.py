"""Where workers send their events: a log of lines, an HTTP endpoint, or both; and manifests by run."""

from __future__ import annotations

import json
import os
import re
import threading
import urllib.request
from urllib.parse import urlparse

from pyspark.sql import DataFrame

from weftline.sources.tables import load_json, write_json


class Lines:
    """Appends each event as one compact line with sorted keys, forced to disk."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, event: dict) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, sort_keys=True, separators=(",", ":")) + "\n")
            f.flush()
            os.fsync(f.fileno())


class Http:
    """Posts each event as JSON."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, seconds: float = 30) -> None:
        self.url, self.headers, self.seconds = url, headers or {}, seconds

    def __call__(self, event: dict) -> None:
        request = urllib.request.Request(self.url, json.dumps(event).encode(), self.headers | {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=self.seconds) as answer:
            answer.read()


class All:
    """Several sinks in turn."""

    def __init__(self, *sinks) -> None:
        self.sinks = sinks

    def __call__(self, event: dict) -> None:
        for sink in self.sinks:
            sink(event)


class Emitter:
    """Events of one run, numbered in the order in which they are sent, from any thread."""

    def __init__(self, run: str, sink) -> None:
        self.run, self.sink, self._n, self._lock = run, sink, 0, threading.Lock()

    def __call__(self, kind: str, **fields: object) -> dict:
        with self._lock:
            self._n += 1
            event = {"event_id": f"{self.run}:{self._n:06d}", "type": kind} | fields
            self.sink(event)
        return event


def send(events: DataFrame, sink) -> None:
    """Every row as an event, sent by the executors; a task that runs again sends its rows again."""

    def part(rows) -> None:
        for r in rows:
            sink(r.asDict(recursive=True))

    events.foreachPartition(part)


class Manifests:
    """Manifests of runs in a folder, and, where it is published, the URI each is found at."""

    def __init__(self, folder: str, public: str | None = None) -> None:
        self.folder, self.public = folder, None
        if public is not None:
            self.public = public.strip().rstrip("/")
            parsed = urlparse(self.public)
            if parsed.scheme not in ("http", "https", "s3", "gs") or not parsed.netloc:
                raise ValueError("a public folder is an http(s), s3 or gs URI")

    def _name(self, run: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*", run):
            raise ValueError(f"{run!r} names no run")
        return f"{run}.json"

    def put(self, run: str, manifest: dict) -> str:
        """Store a manifest; gives where it is found."""
        name = self._name(run)
        write_json(f"{self.folder}/{name}", manifest)
        return f"{self.public or self.folder}/{name}"

    def get(self, run: str) -> dict:
        return load_json(f"{self.folder}/{self._name(run)}")
