"""Pluggable model callables, and a deterministic one for dry runs."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Protocol


class Provider(Protocol):
    model: str

    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class DryRun:
    """Answers every prompt alike: with empty JSON where JSON is asked for."""

    model: str = "dry-run"

    def complete(self, prompt: str) -> str:
        return json.dumps({"entities": [], "edges": [], "summary_text": "[dry-run]"}) if "JSON" in prompt else "[dry-run]"

    def embed(self, text: str) -> list[float]:
        return [1.0] + [0.0] * 7


class Refused(RuntimeError):
    """A provider asks to be left alone for some seconds."""

    def __init__(self, seconds: float):
        super().__init__(f"try again in {seconds} s")
        self.seconds = seconds


@dataclass(frozen=True)
class Digest(DryRun):
    """A dry run whose answers are digests of the prompts, so that what a model was asked can be checked; names it gives are words of the entity's own."""

    model: str = "digest"

    def complete(self, prompt: str) -> str:
        said = hashlib.sha256(prompt.encode()).hexdigest()[:16]
        if "JSON" not in prompt:
            return said
        words = (re.search(r"^Entity: (.*)$", prompt, re.M) or ["", ""])[1].split() or [""]
        names = [line for line in prompt.splitlines() if line.startswith("- ")]
        plain = [re.sub(r" \[[^\]]*\]( \(aliases: .*\))?$", "", n[2:]) for n in names]
        top = prompt.splitlines()[-1].rsplit(" [", 1)[0]
        return json.dumps({
            "purpose": said, "blocks": [{"label": said[:4], "description": said[4:8]}] if "with two to five blocks" in prompt else [],
            "assumptions": [], "risks": [], "verified_by_names": words[:1], "discards_result_callees": words[-1:],
            "themes": [{"title": f"Of {top}", "statement": said, "confidence": 0.5, "upheld_by_entity_names": [top], "violated_by_entity_names": []}],
            "merges": [{"keep": plain[0], "absorb": n, "reason": ""} for n in plain[1:] if n.lower() == plain[0].lower()],
        })


@dataclass
class TokenBudget:
    """Admission by tokens a minute: mean and variance by Welford's rule, the 95th percentile of the last 100 calls, a slow start and a freeze after a refusal."""

    per_minute: int
    cold_seconds: float = 10.0
    cold_calls: int = 20
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    last: list[float] = field(default_factory=list)
    frozen_until: float = 0.0
    spent: list[tuple[float, float]] = field(default_factory=list)

    def observe(self, tokens: float, now: float) -> None:
        self.n += 1
        delta = tokens - self.mean
        self.mean += delta / self.n
        self.m2 += delta * (tokens - self.mean)
        self.last = [*self.last[-99:], tokens]
        self.spent.append((now, tokens))

    def variance(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0

    def p95(self) -> float:
        ranked = sorted(self.last)
        return ranked[min(len(ranked) - 1, int(0.95 * len(ranked)))] if ranked else 0.0

    def refused(self, now: float, seconds: float) -> None:
        self.frozen_until = max(self.frozen_until, now + seconds)

    def admits(self, now: float, started: float) -> bool:
        if now < self.frozen_until or (self.n < self.cold_calls and now - started < self.cold_seconds and self.n > 0):
            return False
        self.spent = [s for s in self.spent if s[0] > now - 60]
        return sum(t for _, t in self.spent) + self.p95() <= self.per_minute
