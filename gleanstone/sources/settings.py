"""Settings of a hub: environment over .env file over defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

TRUE, FALSE = frozenset(("1", "true", "yes", "on")), frozenset(("0", "false", "no", "off"))


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines; quotes around a value go, comments and other lines are passed over."""
    out = {}
    for line in text.splitlines():
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line):
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def items(text: str) -> list[str]:
    """Comma-separated values, each once, in order."""
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def repo_ref(text: str) -> tuple[str, str | None]:
    """org/repo, or org/repo@ref."""
    slug, _, ref = text.partition("@")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", slug) or ".." in slug:
        raise ValueError(f"not a repository: {text}")
    return slug, ref or None


def switch(text: str, default: bool) -> bool:
    word = text.strip().lower()
    return True if word in TRUE else False if word in FALSE else default


@dataclass
class Settings:
    repos: list[str] = field(default_factory=list)
    tainted_repos: list[str] = field(default_factory=list)
    tainted_refs: list[str] = field(default_factory=list)
    reranker: bool = False
    rrf_k: int = 60
    low_score: float = 0.1
    store: str = "hub-store"

    def effective_repos(self) -> list[str]:
        return [r for r in self.repos if repo_ref(r)[0] not in set(self.tainted_repos)]

    @classmethod
    def load(cls, env_file: str = "", environ: dict[str, str] | None = None, prefix: str = "HUB_") -> Settings:
        values = {**read_env(env_file), **(os.environ if environ is None else environ)}
        out = cls()
        for name in ("repos", "tainted_repos", "tainted_refs"):
            if (text := values.get(f"{prefix}{name.upper()}")) is not None:
                setattr(out, name, items(text))
        out.reranker = switch(values.get(f"{prefix}RERANKER", ""), out.reranker)
        for name, kind in (("rrf_k", int), ("low_score", float)):
            if text := values.get(f"{prefix}{name.upper()}"):
                try:
                    setattr(out, name, kind(text))
                except ValueError as e:
                    raise ValueError(f"{prefix}{name.upper()} must be a number: {text}") from e
        out.store = values.get(f"{prefix}STORE", out.store)
        return out
