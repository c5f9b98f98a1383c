"""Connectors to extraction services: direct and batch, with retries and soft failures.

An extractor maps (name, prompt) jobs to (name, data, error) answers. HTTP goes through one
callable, so tests and other clients can stand in. Direct extraction can also run inside Spark:
partitions are the concurrency.
"""

from __future__ import annotations

import json
import logging
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from loquela import schema
from loquela.functions.text import repair_json_text

log = logging.getLogger(__name__)

#: (method, url, headers, body) -> (status, headers, body); raises OSError where the network fails.
Transport = Callable[[str, str, dict[str, str], bytes | None], tuple[int, dict[str, str], bytes]]


@dataclass(frozen=True)
class Job:
    name: str
    prompt: str
    chunk_hash: str = ""


@dataclass(frozen=True)
class Answer:
    name: str
    data: dict[str, Any] | None = None
    error: str | None = None


class Extractor(Protocol):
    def analyze(self, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]: ...


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=600) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def parse_object(text: str | None, required: Iterable[str] = schema.RESULT_FIELDS) -> dict[str, Any]:
    """One JSON object with the required keys (null values count); ValueError otherwise."""
    found = json.loads(repair_json_text(text))
    if not isinstance(found, dict):
        raise ValueError("the answer is not an object")
    if lacking := [k for k in required if k not in found]:
        raise ValueError(f"the answer lacks {', '.join(lacking)}")
    return found


def duration(text: str | None) -> float | None:
    """Seconds of texts like 6m0s or 20ms; None where there is none."""
    found = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text or "")
    return sum(float(n) * {"ms": 0.001, "h": 3600, "m": 60, "s": 1}[u] for n, u in found) if found else None


@dataclass(frozen=True)
class Retries:
    """Rate limits have a budget of their own; faults of the server or network fewer tries."""

    rate_limited: int = 8
    faults: int = 3
    first_wait: float = 25.0
    growth: float = 1.5
    longest: float = 180.0
    sleep: Callable[[float], None] = time.sleep

    def wait(self, k: int, headers: dict[str, str]) -> float:
        """Before the k-th repetition: what the service asks for, else growing steps."""
        for name in ("retry-after", "x-ratelimit-reset-tokens", "x-ratelimit-reset-requests"):
            value = headers.get(name)
            try:
                hint = float(value) if value else None
            except ValueError:
                hint = duration(value)
            if hint is not None and hint >= 1:
                return min(hint, self.longest)
        return min(self.first_wait * self.growth ** (k - 1), self.longest)

    def call(self, send: Callable[[], tuple[int, dict[str, str], bytes]]) -> bytes:
        limited = faults = 0
        while True:
            try:
                status, headers, body = send()
            except OSError as e:
                status, headers, body = 599, {}, str(e).encode()
            if status < 400:
                return body
            said = f"HTTP {status}: {body[:300].decode('utf-8', 'replace')}"
            if status == 429 and limited < self.rate_limited - 1:
                limited += 1
                self.sleep(self.wait(limited, headers))
            elif status >= 500 and faults < self.faults - 1:
                faults += 1
                self.sleep(float(2 ** (faults - 1)))
            else:
                raise RuntimeError(said)


def packs(jobs: list[Job], budget: int, max_output_tokens: int) -> list[list[Job]]:
    """Consecutive jobs within a token budget; one over it goes alone."""
    out: list[list[Job]] = []
    size = 0
    for job in jobs:
        cost = len(job.prompt) // 3 + max_output_tokens
        if not out or size + cost > budget:
            out.append([])
            size = 0
        out[-1].append(job)
        size += cost
    return out


@dataclass
class _Service:
    model: str
    api_key: str | None = None
    base_url: str = ""
    max_output_tokens: int = 8000
    concurrency: int = 2
    required: tuple[str, ...] = schema.RESULT_FIELDS
    json_schema: dict[str, Any] | None = None
    schema_name: str = "result"
    transport: Transport = http
    retries: Retries = field(default_factory=Retries)

    def _send(self, method: str, path: str, body: Any = None, kind: str = "application/json") -> bytes:
        data = body if isinstance(body, bytes) or body is None else json.dumps(body, ensure_ascii=False).encode()
        url = path if path.startswith("http") else f"{self.base_url.rstrip('/')}{path}"
        return self.retries.call(lambda: self.transport(method, url, {**self._headers(), "Content-Type": kind}, data))

    def _headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}

    def _one(self, job: Job) -> Answer:
        raise NotImplementedError

    def _softly(self, job: Job) -> Answer:
        try:
            return self._one(job)
        except (RuntimeError, ValueError, KeyError, IndexError, TypeError) as e:
            return Answer(job.name, error=str(e) or type(e).__name__)

    def analyze(self, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]:
        """Answers in job order; a job that fails is an answer with an error."""
        out = []
        with ThreadPoolExecutor(max_workers=max(1, self.concurrency)) as pool:
            for answer in pool.map(self._softly, jobs):
                out.append(answer)
                if on_answer:
                    on_answer(answer)
        return out


@dataclass
class ChatCompletions(_Service):
    """A chat-completions service, one request for each job."""

    def request(self, job: Job) -> dict[str, Any]:
        if self.json_schema:
            shape = {"type": "json_schema", "json_schema": {"name": self.schema_name, "strict": True, "schema": self.json_schema}}
        else:
            shape = {"type": "json_object"}
        return {"model": self.model, "messages": [{"role": "user", "content": job.prompt}], "max_tokens": self.max_output_tokens, "response_format": shape}

    def _one(self, job: Job) -> Answer:
        found = json.loads(self._send("POST", "/chat/completions", self.request(job)))
        return Answer(job.name, parse_object(found["choices"][0]["message"]["content"], self.required))


@dataclass
class ChatCompletionsBatch(ChatCompletions):
    """The same service's batches: packs within a token budget, uploaded, polled, downloaded.

    on_batch is told of each batch when it is made, with its jobs, so a later run can resume it.
    """

    budget: int = 700_000
    poll_seconds: float = 60.0
    on_batch: Callable[[str, list[Job]], None] | None = None

    def analyze(self, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]:
        out = []
        for pack in packs(jobs, self.budget, self.max_output_tokens):
            lines = "\n".join(json.dumps({"custom_id": j.name, "method": "POST", "url": "/v1/chat/completions", "body": self.request(j)}, ensure_ascii=False) for j in pack)
            mark = uuid.uuid4().hex
            form = f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{mark}\r\nContent-Disposition: form-data; name="file"; filename="jobs.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n{lines}\r\n--{mark}--\r\n'
            file = json.loads(self._send("POST", "/files", form.encode(), f"multipart/form-data; boundary={mark}"))
            made = json.loads(self._send("POST", "/batches", {"input_file_id": file["id"], "endpoint": "/v1/chat/completions", "completion_window": "24h"}))
            if self.on_batch:
                self.on_batch(made["id"], pack)
            out += self.collect(made["id"], pack, on_answer)
        return out

    def collect(self, batch_id: str, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]:
        """Wait for a batch and read it; jobs that it doesn't answer are errors."""
        while True:
            batch = json.loads(self._send("GET", f"/batches/{batch_id}"))
            if batch["status"] in ("completed", "failed", "expired", "cancelled"):
                break
            counts = batch.get("request_counts") or {}
            log.info("batch %s: %s of %s", batch_id, counts.get("completed", 0), counts.get("total", "?"))
            self.retries.sleep(self.poll_seconds)
        found: dict[str, Answer] = {}
        for key in ("output_file_id", "error_file_id"):
            if batch.get(key):
                for line in self._send("GET", f"/files/{batch[key]}/content").decode().splitlines():
                    if line.strip():
                        answer = self._line(json.loads(line))
                        found[answer.name] = answer
        out = [found.get(j.name) or Answer(j.name, error=f"batch {batch['status']}") for j in jobs]
        for answer in out:
            if on_answer:
                on_answer(answer)
        return out

    def _line(self, line: dict[str, Any]) -> Answer:
        name, reply = line["custom_id"], line.get("response") or {}
        try:
            if line.get("error") or reply.get("status_code") != 200:
                raise ValueError(json.dumps(line.get("error") or reply.get("body"), ensure_ascii=False)[:300])
            return Answer(name, parse_object(reply["body"]["choices"][0]["message"]["content"], self.required))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            return Answer(name, error=str(e))


@dataclass
class Messages(_Service):
    """A messages service with a JSON schema on its output; direct."""

    base_url: str = "https://api.anthropic.com/v1"

    def _headers(self) -> dict[str, str]:
        return {"x-api-key": self.api_key or "", "anthropic-version": "2023-06-01"}

    def request(self, job: Job) -> dict[str, Any]:
        shape = {"format": {"type": "json_schema", "schema": self.json_schema or schema.RESULT_JSON_SCHEMA}}
        return {"model": self.model, "max_tokens": self.max_output_tokens, "messages": [{"role": "user", "content": job.prompt}], "output_config": shape}

    def read(self, name: str, message: dict[str, Any]) -> Answer:
        if message.get("stop_reason") in ("refusal", "max_tokens"):
            return Answer(name, error=message["stop_reason"])
        text = next((b["text"] for b in message.get("content", []) if b.get("type") == "text"), None)
        return Answer(name, parse_object(text, ()))

    def _one(self, job: Job) -> Answer:
        return self.read(job.name, json.loads(self._send("POST", "/messages", self.request(job))))


@dataclass
class MessagesBatch(Messages):
    """The same service's batches."""

    poll_seconds: float = 30.0
    on_batch: Callable[[str, list[Job]], None] | None = None

    def analyze(self, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]:
        made = json.loads(self._send("POST", "/messages/batches", {"requests": [{"custom_id": j.name, "params": self.request(j)} for j in jobs]}))
        if self.on_batch:
            self.on_batch(made["id"], jobs)
        return self.collect(made["id"], jobs, on_answer)

    def collect(self, batch_id: str, jobs: list[Job], on_answer: Callable[[Answer], None] | None = None) -> list[Answer]:
        while (batch := json.loads(self._send("GET", f"/messages/batches/{batch_id}")))["processing_status"] != "ended":
            self.retries.sleep(self.poll_seconds)
        found = {}
        for line in self._send("GET", batch["results_url"]).decode().splitlines():
            if line.strip():
                row = json.loads(line)
                name, result = row["custom_id"], row["result"]
                try:
                    found[name] = self.read(name, result["message"]) if result["type"] == "succeeded" else Answer(name, error=result["type"])
                except (ValueError, KeyError) as e:
                    found[name] = Answer(name, error=str(e))
        out = [found.get(j.name) or Answer(j.name, error="not in the batch's results") for j in jobs]
        for answer in out:
            if on_answer:
                on_answer(answer)
        return out


def make_extractor(ai: dict[str, Any], key: str | None, synthesis: bool = False, **more: Any) -> Extractor:
    """The service that the settings name; a synthesis is one request with its own shape."""
    shape = schema.SYNTHESIS_JSON_SCHEMA if synthesis else schema.RESULT_JSON_SCHEMA
    common = {"model": ai["model"], "api_key": key, "max_output_tokens": ai["max_output_tokens"], "concurrency": 1 if synthesis else ai["concurrency"], **more}
    if ai["provider"] == "anthropic":
        kind = Messages if synthesis or ai["mode"] == "direct" else MessagesBatch
        return kind(json_schema=shape, **common)
    common |= {"base_url": ai["base_url"], "required": schema.SYNTHESIS_FIELDS if synthesis else schema.RESULT_FIELDS, "json_schema": shape if ai["structured_output"] else None, "schema_name": "synthesis" if synthesis else "result"}
    return ChatCompletionsBatch(budget=ai["batch_token_budget"], **common) if ai["mode"] == "batch" else ChatCompletions(**common)


def extract_in_spark(jobs: DataFrame, service: Extractor, concurrency: int = 2) -> DataFrame:
    """(name, data json, error) of a job table: each partition sends one request at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [service.analyze([Job(n, p)])[0] for n, p in zip(rows["name"], rows["prompt"], strict=True)]
            yield pd.DataFrame([(a.name, None if a.data is None else json.dumps(a.data, ensure_ascii=False), a.error) for a in found], columns=["name", "data", "error"])

    return jobs.select("name", "prompt").repartition(concurrency).mapInPandas(run, "name string, data string, error string")
