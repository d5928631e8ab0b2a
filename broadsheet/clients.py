"""Chat-completion client over the standard library, with a fall-back from a strict schema to plain JSON."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request

from broadsheet.errors import ExtractionFailure


def response_format(schema: dict, strict: bool) -> dict:
    return {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}} if strict else {"type": "json_object"}


def unsupported_format(status: int, body: str) -> bool:
    """Only a bad request that names the format means the server doesn't know strict schemas."""
    return status == 400 and bool(re.search(r"response_format|json_schema", body))


class ChatClient:
    """Callable prompt -> content; one attempt per call, errors bounded to 1000 characters."""

    def __init__(self, base_url: str, key: str, model: str, schema: dict, system: str, timeout: float = 300.0, opener=urllib.request.urlopen):
        self.url, self.key, self.model, self.schema, self.system, self.timeout, self.opener = base_url.rstrip("/") + "/chat/completions", key, model, schema, system, timeout, opener
        self.strict = True
        #: Request id, usage and mode of the last answer.
        self.last: dict = {}

    def _post(self, prompt: str, strict: bool) -> str:
        body = {
            "model": self.model, "response_format": response_format(self.schema, strict),
            "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}],
        }
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with self.opener(request, timeout=self.timeout) as answer:
            data = json.loads(answer.read())
            self.last = {"request_id": data.get("id"), "usage": data.get("usage"), "mode": "json_schema" if strict else "json_object"}
            return data["choices"][0]["message"]["content"]

    def __call__(self, prompt: str) -> str:
        try:
            try:
                return self._post(prompt, self.strict)
            except urllib.error.HTTPError as e:
                text = e.read().decode(errors="replace")
                if not (self.strict and unsupported_format(e.code, text)):
                    raise ExtractionFailure(re.sub(r"\s+", " ", f"HTTP {e.code}: {text}")[:1000]) from e
                self.strict = False
                return self._post(prompt, False)
        except (urllib.error.URLError, TimeoutError, KeyError, IndexError, ValueError) as e:
            raise ExtractionFailure(str(e)[:1000]) from e
