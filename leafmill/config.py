"""Settings: frozen, checked when made, from flags, environment and defaults in this order."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

PREFIX = "LEAFMILL_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
#: Attempts without an end; unlike None ("not given") it overrides a bound from the environment.
UNLIMITED = 0


class ConfigError(ValueError):
    """A setting that can't be used."""


def env(name: str, default=None, kind: Callable = str, environ: Mapping[str, str] | None = None):
    """The setting `name` from the environment; empty counts as unset, a value that can't be read is an error."""
    raw = (os.environ if environ is None else environ).get(PREFIX + name, "").strip()
    if not raw:
        return default
    try:
        return kind(raw)
    except ValueError as error:
        raise ConfigError(f"{PREFIX}{name}={raw!r}: {error}") from None


def flag(raw: str) -> bool:
    if raw.lower() not in (*TRUE, *FALSE):
        raise ValueError(f"expected one of {', '.join((*TRUE, *FALSE))}")
    return raw.lower() in TRUE


def positive(raw: str) -> float:
    value = float(raw)
    if not value > 0:
        raise ValueError("expected a positive number")
    return value


@dataclass(frozen=True, slots=True)
class RetryConfig:
    """max_attempts: UNLIMITED or a bound; delays in seconds; jitter as a fraction."""

    max_attempts: int = UNLIMITED
    initial_delay: float = 1.0
    max_delay: float = 900.0
    jitter: float = 0.25

    def __post_init__(self):
        if self.max_attempts < 0:
            raise ConfigError(f"max_attempts must be >= 1, or 0 for no bound, got {self.max_attempts}")
        if self.initial_delay < 0 or self.max_delay < self.initial_delay:
            raise ConfigError(f"need 0 <= initial_delay <= max_delay, got {self.initial_delay} and {self.max_delay}")
        if not 0 <= self.jitter <= 1:
            raise ConfigError(f"jitter must be in [0, 1], got {self.jitter}")


@dataclass(frozen=True, slots=True)
class NoCache:
    """What of the cache is not to be used, by resource."""

    render: bool = False
    text: bool = False
    resized: bool = False
    extract: bool = False
    format: bool = False
    summary: bool = False

    @classmethod
    def everything(cls) -> NoCache:
        return cls(*(True for _ in fields(cls)))

    def all(self) -> bool:
        return all(getattr(self, f.name) for f in fields(self))


@dataclass(frozen=True, slots=True)
class EngineConfig:
    model: str = "MiniMax-M3"
    dpi: int = 144
    pages: str | None = None
    with_summary: bool = True
    text_hint: bool = True
    fallback_to_text: bool = True
    stitch_mode: str = "heuristic"
    image_long_side: int = 1536
    image_min_long_side: int = 768
    image_quality: int = 85
    max_summary_chars: int = 800
    ctx_limit: int | None = None
    safety: float = 0.85
    request_timeout: float = 60.0
    #: Stands for the persona texts in the stored settings; None: a hash of them.
    persona_version: str | None = None
    retry: RetryConfig = field(default_factory=RetryConfig)
    no_cache: NoCache = field(default_factory=NoCache)
    #: Pages that fell back are tried again on the next run.
    retry_fallbacks: bool = True

    def __post_init__(self):
        for name, least in (("dpi", 1), ("image_long_side", 1), ("image_min_long_side", 1), ("max_summary_chars", 1)):
            if getattr(self, name) < least:
                raise ConfigError(f"{name} must be >= {least}, got {getattr(self, name)}")
        if not 1 <= self.image_quality <= 100:
            raise ConfigError(f"image_quality must be in 1..100, got {self.image_quality}")
        if self.image_long_side < self.image_min_long_side:
            raise ConfigError("image_long_side must not be under image_min_long_side")
        if not 0.1 <= self.request_timeout <= 600:
            raise ConfigError(f"request_timeout must be in 0.1..600 s, got {self.request_timeout}")
        if not 0 < self.safety <= 1:
            raise ConfigError(f"safety must be in (0, 1], got {self.safety}")
        if self.ctx_limit is not None and self.ctx_limit < 1:
            raise ConfigError(f"ctx_limit must be >= 1, got {self.ctx_limit}")

    @classmethod
    def load(cls, given: Mapping | None = None, environ: Mapping[str, str] | None = None) -> EngineConfig:
        """From `given` (None values count as not given), then the environment, then the defaults."""
        given = {k: v for k, v in (given or {}).items() if v is not None}
        kinds = {
            "model": str, "dpi": int, "image_long_side": int, "image_min_long_side": int, "image_quality": int, "max_summary_chars": int,
            "ctx_limit": int, "safety": float, "request_timeout": positive, "fallback_to_text": flag,
        }
        found = {k: v for k, kind in kinds.items() if (v := env(k.upper(), None, kind, environ)) is not None}
        retry = {"max_attempts": int, "initial_delay": float, "max_delay": float, "jitter": float}
        tries = {k: v for k, kind in retry.items() if (v := env(f"RETRY_{k.upper()}", None, kind, environ)) is not None}
        tries |= {k: given.pop(k) for k in retry if k in given}
        return cls(**found | given | {"retry": RetryConfig(**tries)})


def require_secret(name: str = "API_KEY", environ: Mapping[str, str] | None = None) -> str:
    """A secret from the environment; an error that says how to set it otherwise. It never enters a plan."""
    value = env(name, None, str, environ)
    if not value:
        raise ConfigError(f"{PREFIX}{name} is not set")
    return value


def safe_folder(path: str) -> str:
    """The path, if no part of it is `..`."""
    if ".." in path.replace("\\", "/").split("/"):
        raise ConfigError(f"folder must not contain '..': {path!r}")
    return path
