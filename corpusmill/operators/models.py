"""Clients of completion services, as models of generation.completed(). They fail closed: an error ends the job."""

from __future__ import annotations

import json
import urllib.request


class HttpModel:
    """One completion a request, not streamed: POST {url}/api/generate. options go into the request's body.

    A factory for executors: functools.partial(HttpModel, url, model); control.resolved() finds url and model.
    """

    def __init__(self, url: str, model: str, timeout: float = 120, **options):
        self.endpoint, self.timeout = f"{url.rstrip('/')}/api/generate", timeout
        self.fixed = {"model": model, "stream": False, **options}

    def complete(self, prompt: str, attempt: int) -> str:
        body = json.dumps({**self.fixed, "prompt": prompt}).encode()
        asked = urllib.request.Request(self.endpoint, body, {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            return json.load(answer).get("response", "")
