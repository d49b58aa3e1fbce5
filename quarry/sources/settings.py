"""Settings with typed defaults, from the environment or from job arguments."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Settings:
    # The defaults of scoring, paging and limits.
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    page_size: int = 10
    max_page_size: int = 50
    max_query_length: int = 256
    requests_per_minute: int = 120
    max_depth: int = 2
    max_pages: int = 100
    delay_seconds: float = 1.0
    seed_urls: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()

    @staticmethod
    def load(env: Mapping[str, str] | None = None, **overrides: object) -> Settings:
        """Environment under the fields' names in capitals, then overrides; lists are separated by commas or lines."""
        env = os.environ if env is None else env
        found: dict[str, object] = {}
        for f in fields(Settings):
            raw = env.get(f.name.upper())
            if raw is not None:
                found[f.name] = tuple(x.strip() for x in raw.replace("\n", ",").split(",") if x.strip()) if f.type.startswith("tuple") else {"int": int, "float": float}[f.type](raw)
        return replace(Settings(), **found, **overrides)


@dataclass(frozen=True)
class CrawlJob:
    """What a crawl is asked for."""

    seed_urls: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    max_depth: int = 2
    max_pages: int = 100
    delay_seconds: float = 1.0

    @staticmethod
    def load(settings: Settings = Settings(), overrides: str | None = None, **arguments: object) -> CrawlJob:
        """Settings, then arguments that are not None, then the JSON object ``overrides`` (unknown keys are left out); seeds given as an argument
        win over both. Without an allowlist the hosts of the seeds are allowed."""
        names = [f.name for f in fields(CrawlJob)]
        given = {k: v for k, v in arguments.items() if v is not None}
        if unknown := given.keys() - set(names):
            raise TypeError(f"unknown arguments: {sorted(unknown)}")
        found = {k: getattr(settings, k) for k in names} | given
        found |= {k: v for k, v in json.loads(overrides or "{}").items() if k in names}
        if given.get("seed_urls"):
            found["seed_urls"] = given["seed_urls"]
        if not found["allowed_domains"]:
            found["allowed_domains"] = sorted({h for u in found["seed_urls"] if (h := (urlsplit(u).hostname or "").lower())})
        return CrawlJob(**found | {k: tuple(found[k]) for k in ("seed_urls", "allowed_domains")})


def page_request(query: str, page: int = 1, limit: int = 10, settings: Settings = Settings(), check_length: bool = True) -> tuple[str, int, int]:
    """(query, limit, offset) of a valid request; ValueError for a blank or overlong query, page under 1, or limit out of range."""
    if page < 1 or not 1 <= limit <= settings.max_page_size:
        raise ValueError("page must be at least 1 and limit in range")
    if not query.strip() or check_length and len(query) > settings.max_query_length:
        raise ValueError("query is blank or too long")
    return query, limit, (page - 1) * limit
