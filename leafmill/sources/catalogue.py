"""A server's list of models, read once on the driver."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from leafmill.config import PREFIX, EngineConfig
from leafmill.operators.limits import CEILING, FIELDS, KNOWN, UNKNOWN_LIMIT

SCHEMA = "pos int, id string, " + ", ".join(f"{f} long" for f in FIELDS)


def fetch(base_url: str, api_key: str, timeout: float = 10.0) -> list[dict] | None:
    """The entries of GET <base_url>/models; None for other schemes than http and https and for any failure. Limits are a
    hint, so no failure here may stop a run."""
    if not base_url.lower().startswith(("http://", "https://")):
        return None
    request = urllib.request.Request(f"{base_url.rstrip('/')}/models", headers={"Authorization": f"Bearer {api_key}", "Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            entries = json.load(answer).get("data")
    except Exception:  # noqa: BLE001
        return None
    return [x for x in entries if isinstance(x, dict)] if isinstance(entries, list) else None


def number(value) -> int | None:
    """Positive numbers, truncated; booleans aren't numbers."""
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0 else None


def rows(entries: list[dict]) -> list[tuple]:
    return [(i, str(x.get("id", "")), *(number(x.get(f)) for f in FIELDS)) for i, x in enumerate(entries)]


def catalogue(spark: SparkSession, entries: list[dict] | None) -> DataFrame:
    """Entries as a table for operators.limits.resolve_limits(); empty for None."""
    return spark.createDataFrame(rows(entries or []), SCHEMA)


def find_limit(model: str, entries: list[dict]) -> int | None:
    """resolve_limits()'s choice for one model, without a session: the entry of that name, else the first that contains
    it; of entries that have a limit."""
    wanted = model.lower()
    known = [(name.lower(), min(next(v for v in values if v), CEILING)) for _, name, *values in rows(entries) if any(values)]
    return next((v for name, v in known if name == wanted), next((v for name, v in known if wanted in name), None))


def resolve_limit(config: EngineConfig, environ: Mapping[str, str], ask: Callable[[str, str], list[dict] | None] = fetch) -> int:
    """The configured limit, else what the server of <PREFIX>BASE_URL says (asked only with an API key), else the table's."""
    if config.ctx_limit:
        return config.ctx_limit
    key, base = environ.get(f"{PREFIX}API_KEY"), environ.get(f"{PREFIX}BASE_URL")
    found = find_limit(config.model, ask(base, key) or []) if key and base else None
    return found or KNOWN.get(config.model, UNKNOWN_LIMIT)
