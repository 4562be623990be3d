"""Model, recognition and file engines behind small interfaces.

Engines are made once a Python worker.  The default extraction provider works by rules, so everything runs without
a network; HTTP providers take their ``post`` and ``get`` as arguments.  Calls are not repeated by the engine beyond one
reconnection: results should be kept (``session.keep``) before they are used twice."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Chat(Protocol):
    def chat_batch(self, prompts: list[list[dict]], response_format: dict | None = None) -> list[tuple[str | None, str | None]]:
        """(answer, error code) of each prompt, in order."""


class RuleProvider:
    """Rows of email addresses and phone numbers with the line they stand in, as a model would answer."""

    _FOUND = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")

    def chat_batch(self, prompts, response_format=None):
        out = []
        for messages in prompts:
            text = messages[-1]["content"].split("<<<\n", 1)[-1].rsplit("\n>>>", 1)[0]
            rows = []
            for m in self._FOUND.finditer(text):
                line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].split()
                rows.append([m[0], line[0] if line else m[0]])
            out.append((json.dumps({"rows": rows}, ensure_ascii=False), None))
        return out


# What an HTTP status means.
STATUS_CODES = {400: "E_LLM_003", 401: "E_LLM_004", 403: "E_LLM_004", 422: "E_LLM_003", 429: "E_LLM_005"}


def status_code(status: int) -> str:
    return STATUS_CODES.get(status, "E_LLM_006")


class HttpProvider:
    """A chat server; ``style`` openai or ollama.  ``post(url, headers, body, timeout)`` gives (status, decoded answer) and raises ConnectionError."""

    def __init__(self, base_url: str, model: str, post: Callable, api_key: str = "", style: str = "openai", seed: int | None = None, threads: int = 4, timeout: float = 90.0, extra: dict | None = None):
        self.base_url, self.model, self.post, self.api_key, self.style, self.seed, self.timeout, self.extra = base_url.rstrip("/"), model, post, api_key, style, seed, timeout, extra or {}
        self.threads = threads if style == "openai" else 1

    def _body(self, messages: list[dict], form: dict | None) -> tuple[str, dict]:
        if self.style == "ollama":
            return f"{self.base_url}/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": 0, **({"seed": self.seed} if self.seed is not None else {})}, **({"format": form} if form else {}), **self.extra}
        return f"{self.base_url}/chat/completions", {"model": self.model, "messages": messages, "temperature": 0, "stream": False, **({"seed": self.seed} if self.seed is not None else {}), **({"response_format": form} if form else {}), **self.extra}

    def _one(self, messages: list[dict], schema: dict | None) -> tuple[str | None, str | None]:
        forms: list[dict | None] = [None]
        if schema:
            forms = [schema, None] if self.style == "ollama" else [{"type": "json_schema", "json_schema": {"name": "rows", "schema": schema}}, {"type": "json_object"}, None]
        for form in forms:
            url, body = self._body(messages, form)
            for attempt in range(2):
                try:
                    status, answer = self.post(url, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}, body, self.timeout)
                    break
                except ConnectionError:
                    if attempt:
                        return None, "E_LLM_001"
            if status in (400, 422) and form is not None and re.search("response_format|format|schema", json.dumps(answer)):
                continue
            if status != 200:
                return None, status_code(status)
            try:
                text = answer["message"]["content"] if self.style == "ollama" else answer["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError):
                text = None
            return (text, None) if text else (None, "E_LLM_002")
        return None, "E_LLM_003"

    def chat_batch(self, prompts, response_format=None):
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda m: self._one(m, response_format), prompts))


def make_provider(kind: str, **settings: Any) -> Chat:
    """The provider of a name; other names are refused with E_LLM_003."""
    if kind == "rules":
        return RuleProvider()
    if kind in ("openai_compatible", "ollama"):
        return HttpProvider(style="ollama" if kind == "ollama" else "openai", **settings)
    raise ValueError("E_LLM_003: unknown provider " + kind)


SYSTEM = "Extract table rows from the text between the marks. Answer with JSON only: {\"rows\": [[...], ...]}. Leave out totals. Use a blank for a missing cell."


def prompt_column(text: Column, pass_index: Column, total: Column, description: str, examples: list[list[str]], schema_hint: str = "", markdown: Column | None = None) -> Column:
    """array of struct(role, content) for each pass: rules, examples, the pass counter and the text between marks."""
    system = SYSTEM + (f"\nFollow this JSON Schema:\n{schema_hint}" if schema_hint else "")
    note = F.lit("") if markdown is None else F.when(F.coalesce(markdown, F.lit(False)), "\nThe text is Markdown: each table row is a record.").otherwise("")
    user = F.concat(F.lit(f"{description}\n\nexamples:\n{json.dumps(examples, ensure_ascii=False)}\n\npass: "), pass_index.cast("string"), F.lit("/"), total.cast("string"), F.lit("\ntext:\n<<<\n"), text, F.lit("\n>>>\nDo not copy the examples."))
    return F.array(F.struct(F.lit("system").alias("role"), F.concat(F.lit(system), note).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def with_answers(df: DataFrame, messages: str, factory: Callable[[], Chat], schema: dict | None = None) -> DataFrame:
    """``answer`` and ``error_code`` added; the provider is made once a partition, batches keep their order."""
    kind = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error_code", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            prompts = [[dict(m) for m in p] for p in batch]
            yield pd.DataFrame(provider.chat_batch(prompts, schema), columns=["answer", "error_code"])

    return df.withColumn("__a", run(F.col(messages))).select("*", "__a.answer", "__a.error_code").drop("__a")


class Recognizer(Protocol):
    def recognize(self, image: bytes, crop: tuple[float, float, float, float] | None) -> dict:
        """{"rec_texts": [...], "rec_scores": [...], "rec_polys": [...]}; raises for a broken image."""


def recognize_images(df: DataFrame, image: str, factory: Callable[[], Recognizer], key: str) -> DataFrame:
    """``key``, ``payload`` (JSON) and ``error_code`` of each image: E_OCR_003 for a broken one, E_OCR_004 for one without text.  A failing image never fails the task."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("payload", T.StringType()), T.StructField("error_code", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch[image]):
                try:
                    found = engine.recognize(data, None)
                    rows.append((k, json.dumps(found, ensure_ascii=False), None if any(t.strip() for t in found.get("rec_texts", [])) else "E_OCR_004"))
                except Exception:
                    rows.append((k, None, "E_OCR_003"))
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, image).mapInPandas(run, schema)


class JobError(RuntimeError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code} {message}")
        self.code = code


class RemoteJob:
    """A remote recognition job: submit a document, poll, fetch its lines.  ``post`` and ``get`` give (status, body)."""

    def __init__(self, url: str, token: str, post: Callable, get: Callable, every: float = 5.0, limit: float = 1800.0, sleep: Callable[[float], None] = time.sleep, cancelled: Callable[[], bool] = lambda: False):
        self.url, self.token, self.post, self.get, self.every, self.limit, self.sleep, self.cancelled = url.rstrip("/"), token, post, get, every, limit, sleep, cancelled

    def _data(self, status: int, body: Any) -> dict:
        if status in (401, 403):
            raise JobError("E_OCR_012")
        if status != 200:
            raise JobError("E_OCR_011", str(status))
        if not isinstance(body, dict) or body.get("code", 0) not in (0, "0", None) or not isinstance(body.get("data"), dict):
            raise JobError("E_OCR_013")
        return body["data"]

    def run(self, document: bytes, name: str, options: dict | None = None) -> list[dict]:
        """The decoded lines of the result."""
        try:
            job = self._data(*self.post(f"{self.url}/jobs", {"Authorization": f"bearer {self.token}"}, {"file": document, "name": name, "options": options or {}}, 60))["jobId"]
            waited = 0.0
            while True:
                if self.cancelled() or waited > self.limit:
                    raise JobError("E_OCR_011", "cancelled or too long")
                state = self._data(*self.get(f"{self.url}/jobs/{job}", {"Authorization": f"bearer {self.token}"}))
                if state.get("state") == "failed":
                    raise JobError("E_OCR_013", str(state.get("errorMsg", "")))
                if state.get("state") == "done":
                    status, text = self.get(state["resultUrl"]["jsonUrl"], {})
                    if status != 200:
                        raise JobError("E_OCR_011", str(status))
                    return [json.loads(line) for line in text.splitlines() if line.strip()]
                self.sleep(self.every)
                waited += self.every
        except (ConnectionError, TimeoutError) as e:
            raise JobError("E_OCR_011", str(e)) from e
        except (KeyError, TypeError, ValueError) as e:
            raise JobError("E_OCR_013", str(e)) from e
