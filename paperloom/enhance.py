"""Optional improvement of Markdown by a language model, one client per task.

A failing call leaves the text as it was and adds a note, so a batch goes on.
"""

from __future__ import annotations

import json
import re
import urllib.request
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.arrow import S, batch, rows
from paperloom.functions.text import host_url
from paperloom.operators.chunking import chunk

TIMEOUT_S = 300
LONG, PART, OVERLAP = 15_000, 12_000, 200
_INDICATORS = [r"\|.*\|.*\n(?!\|[-\s:|]+)", r"(\S\t){2,}", r"[a-zA-Z]\^[0-9]", r"[a-zA-Z]_[0-9]", r"[^\x00-\x7F]{3,}"]


class Provider(Protocol):
    def generate(self, prompt: str) -> str: ...

    def is_available(self) -> bool: ...


class Echo:
    """Gives back the text it is asked about; for tests."""

    def generate(self, prompt: str) -> str:
        return prompt.partition("\n\n")[2]

    def is_available(self) -> bool:
        return True


def _post(url: str, body: dict, headers: dict[str, str] | None = None) -> dict:
    r = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(r, timeout=TIMEOUT_S) as f:
        return json.load(f)


@dataclass(frozen=True)
class LocalServer:
    """A model server on a host of one's own."""

    model: str
    host: str | None = None

    def generate(self, prompt: str) -> str:
        return _post(host_url(self.host) + "/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0.1}})["response"]

    def is_available(self) -> bool:
        try:
            with urllib.request.urlopen(host_url(self.host) + "/api/tags", timeout=5):
                return True
        except OSError:
            return False


@dataclass(frozen=True)
class ChatServer:
    """Any server with the usual chat completions interface."""

    model: str
    api_base: str
    api_key: str | None = None

    def generate(self, prompt: str) -> str:
        auth = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0.1}
        return _post(self.api_base.rstrip("/") + "/chat/completions", body, auth)["choices"][0]["message"]["content"]

    def is_available(self) -> bool:
        return bool(self.model and self.api_base)


@dataclass(frozen=True)
class ContentServer:
    """A hosted service that generates content for a key."""

    model: str
    api_key: str
    api_base: str = "https://generativelanguage.googleapis.com/v1beta"

    def generate(self, prompt: str) -> str:
        url = f"{self.api_base}/models/{self.model}:generateContent"
        return _post(url, {"contents": [{"parts": [{"text": prompt}]}]}, {"x-goog-api-key": self.api_key})["candidates"][0]["content"]["parts"][0]["text"]

    def is_available(self) -> bool:
        return bool(self.api_key)


def provider(name: str, model: str | None = None, host: str | None = None, api_key: str | None = None) -> Provider:
    """The provider of that name; a host given for a chat server is its address."""
    if name == "ollama":
        return LocalServer(model or "llama3.1", host)
    if name == "gemini":
        return ContentServer(model or "gemini-1.5-flash", api_key or "")
    if name in ("openai", "openai_compatible"):
        return ChatServer(model or "", host_url(host) if host else "https://api.openai.com/v1", api_key)
    if name == "echo":
        return Echo()
    raise ValueError(f"unknown provider {name}")


def needs_enhancement(text: Column) -> Column:
    """Whether anything in the text suggests that a model could help; a diagnostic, not a gate."""
    return text.rlike("|".join(f"(?:{p})" for p in _INDICATORS))


def _answer(p: Provider, task: str, text: str) -> str:
    return re.sub(r"\n?```$", "", re.sub(r"^```\n?", "", p.generate(f"{task}\n\n{text}").strip()))


def enhanced(p: Provider, text: str) -> str:
    """The text improved, or as it was with a note on what failed."""
    better, error = tried(p, text)
    return better if error is None else f"{better}\n\n<!-- enhancement failed: {error} -->"


def tried(p: Provider, text: str) -> tuple[str, str | None]:
    """(text, error): tables one by one, from the last to the first, then formulas and code of the whole."""
    if not text or not text.strip():
        return text, None
    try:
        lines, at, tables = text.split("\n"), 0, []
        for line in lines:
            s = line.strip()
            if s.startswith("|") and "|" in s[1:]:
                if tables and tables[-1][1] == at - 1:
                    tables[-1][1] = at + len(line)
                else:
                    tables.append([at, at + len(line)])
            at += len(line) + 1
        for a, b in reversed(tables):
            try:
                text = text[:a] + (_answer(p, "Repair this Markdown table. Return only the table.", text[a:b]) or text[a:b]) + text[b:]
            except Exception:  # noqa: BLE001 - a table that fails stays as it is
                pass
        if re.search(r"[\\^_{}]|(def |function |class |import |#include )", text):
            task = "Format the mathematics and code in this Markdown. Change nothing else. Return only the Markdown."
            # parts do not overlap in the result: each is asked about on its own
            parts = [text] if len(text) <= LONG else [c for _, c in chunk(text, PART, 0)]
            text = "".join(_answer(p, task, c) + ("\n\n" if c.endswith("\n\n") and len(parts) > 1 else "") for c in parts)
        return text, None
    except Exception as e:  # noqa: BLE001 - a model that fails must not end the batch
        return text, str(e)


def enhance(results: DataFrame, p: Provider, text: str = "markdown") -> DataFrame:
    """``results`` with its text improved, and ``enhance_error``: what failed, or null; all other columns as they are.

    A text that could not be improved stays as it was, with a note at its end.
    """
    names = results.columns

    def run(batches):
        for b in batches:
            out = []
            for d, t in rows(b, "doc_id", text):
                better, error = tried(p, t)
                out.append((d, better if error is None else f"{better}\n\n<!-- enhancement failed: {error} -->", error))
            yield batch(out, ["doc_id", "_better", "enhance_error"], [S, S, S])

    better = results.select("doc_id", text).mapInArrow(run, "doc_id string, _better string, enhance_error string")
    return results.join(better, "doc_id").withColumn(text, F.col("_better")).select(*names, "enhance_error")
