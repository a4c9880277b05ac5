"""What the engine asks of the outside, as plain callables, with offline defaults.

decoder(bytes) -> list of page texts; classifier(list of units) -> list of replies; embedder(texts, is_query) ->
vectors; synthesizer(query, evidence) -> text; client(topic) -> content parts; fetcher(url) -> html or None.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Callable


def hashed_embedder(texts: list[str], is_query: bool = False, size: int = 64) -> list[list[float]]:
    """Words hashed to signed places: the same text gives the same vector everywhere."""
    del is_query
    out = []
    for text in texts:
        vector = [0.0] * size
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            vector[h % size] += 1.0 if h >> 16 & 1 else -1.0
        out.append(vector)
    return out


def choose_embedder(configured: dict[str, Callable], wanted: str | None = None, variable: str = "CLAUSEMILL_EMBEDDER") -> tuple[str, Callable]:
    """Name and callable of a provider: the one asked for, else the one the environment names, else the first configured.

    A provider that is named and not configured is an error, and so is having none; nothing else stands in silently.
    """
    name = (wanted or os.environ.get(variable) or "").strip().lower()
    if name in ("", "auto", "embedding"):
        name = next(iter(configured), "")
    if name not in configured:
        raise LookupError(f"embedding provider {name!r} is not configured" if name else "no embedding provider is configured")
    return name, configured[name]


def first_answer(providers: list[tuple[str, Callable[[list[dict]], str]]], tries: int = 2, first_delay: float = 2.0, last_delay: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[dict]], str]:
    """A chat callable that asks providers in order and returns the first answer that is not empty.

    Each provider gets `tries` tries, with a doubling pause between them.  If none answers, an error names every failure.
    """
    if not providers:
        raise ValueError("no provider")

    def ask(messages: list[dict]) -> str:
        failures = []
        for name, call in providers:
            for k in range(tries):
                try:
                    text = call(messages) or ""
                    if text.strip():
                        return text
                    failures.append(f"{name}: empty answer (try {k + 1})")
                except Exception as error:  # noqa: BLE001  the next try or provider follows
                    failures.append(f"{name}: {type(error).__name__}: {error}")
                if k < tries - 1:
                    sleep(min(first_delay * 2**k, last_delay))
        raise RuntimeError("all providers failed [" + " | ".join(failures) + "]")

    return ask


def probe(providers: list[tuple[str, Callable[[list[dict]], str]]]) -> dict[str, str]:
    """ok, or the failure, of each provider asked by itself."""
    out = {}
    for name, call in providers:
        try:
            out[name] = "ok" if (call([{"role": "user", "content": "ping"}]) or "").strip() else "empty answer"
        except Exception as error:  # noqa: BLE001  the report is the result
            out[name] = f"{type(error).__name__}: {error}"
    return out


def chat(ask: Callable[[list[dict]], dict], tools: dict[str, Callable[..., object]], messages: list[dict], rounds: int = 5) -> list[dict]:
    """A conversation with tools: ask(messages) -> message with optional tool_calls [{id, name, arguments}]; at most `rounds` rounds of them."""
    history = list(messages)
    for _ in range(rounds):
        reply = ask(history)
        history.append(reply)
        calls = reply.get("tool_calls") or []
        if not calls:
            return history
        for call in calls:
            try:
                result = str(tools[call["name"]](**call.get("arguments", {})))
            except Exception as error:  # noqa: BLE001  the model is told
                result = f"error: {error}"
            history.append({"role": "tool", "tool_call_id": call["id"], "content": result})
    return history
