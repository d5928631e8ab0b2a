"""Typed configuration with strict checks; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import keyword
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from broadsheet.errors import ConfigurationError, CredentialError


def _words(term: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", term.casefold()))


@dataclass(frozen=True)
class QualityConfig:
    min_title_chars: int = 20
    exclude_url_patterns: tuple[str, ...] = ()
    exclude_title_terms: tuple[str, ...] = ()

    def __post_init__(self):
        terms = tuple(_words(t) for t in self.exclude_title_terms)
        if "" in terms or len(set(terms)) != len(terms):
            raise ConfigurationError("excluded title terms must be non-blank and differ")
        object.__setattr__(self, "exclude_title_terms", terms)
        if self.min_title_chars < 0:
            raise ConfigurationError("min_title_chars must not be negative")


@dataclass(frozen=True)
class ExtractionField:
    name: str
    description: str = ""
    regex: str | None = None
    allowed_values: tuple[str, ...] | None = None

    def __post_init__(self):
        if not self.name.isidentifier() or keyword.iskeyword(self.name):
            raise ConfigurationError(f"field name {self.name!r} is no identifier")
        if self.regex is not None:
            try:
                re.compile(self.regex)
            except re.error as e:
                raise ConfigurationError(f"field {self.name}: {e}") from e
        if self.allowed_values is not None:
            object.__setattr__(self, "allowed_values", tuple(self.allowed_values))
            if not self.allowed_values or len(set(self.allowed_values)) != len(self.allowed_values) or not all(self.allowed_values):
                raise ConfigurationError(f"field {self.name}: allowed values must be non-empty and differ")


@dataclass(frozen=True)
class SearchConfig:
    platform: str = ""
    window_days: int = 30
    page_size: int = 1000
    max_pages_per_window: int = 50
    max_retries: int = 3
    timeout_s: int = 300

    def __post_init__(self):
        for name in ("window_days", "page_size", "max_pages_per_window"):
            positive(name, getattr(self, name))
        if self.timeout_s < 300:
            raise ConfigurationError("timeout_s must be at least 300")


@dataclass(frozen=True)
class FetchConfig:
    user_agent: str = ""
    per_domain_delay_s: float = 5.0
    global_max_rps: float = 0.5
    timeout_s: int = 30
    max_response_bytes: int = 5_242_880
    min_text_chars: int = 500
    max_retries: int = 0
    respect_robots: bool = True

    def check_live(self) -> None:
        """Live fetching wants a contact in the agent string and no automatic retries."""
        if "@" not in self.user_agent and "://" not in self.user_agent:
            raise ConfigurationError("user_agent must name a contact")
        if self.max_retries:
            raise ConfigurationError("live fetching makes one attempt")


@dataclass(frozen=True)
class ModelConfig:
    model: str = ""
    max_requests_per_min: int = 20
    max_retries: int = 3
    max_input_tokens: int = 30_000
    screening_max_input_tokens: int | None = None
    extraction_max_input_tokens: int | None = None
    max_articles_per_batch: int = 20
    screening_version: str = "screen-1"
    extraction_version: str = "extract-1"

    def budget(self, phase: str) -> int:
        """Tokens of one prompt: the phase's own limit, else the shared one."""
        own = {"screening": self.screening_max_input_tokens, "extraction": self.extraction_max_input_tokens}[phase]
        return own if own is not None else self.max_input_tokens

    def version(self, phase: str) -> str:
        return {"screening": self.screening_version, "extraction": self.extraction_version}[phase]


@dataclass(frozen=True)
class TopicConfig:
    label: str
    query: str
    start_date: dt.date
    end_date: dt.date
    collection_ids: tuple[int, ...] = ()
    source_ids: tuple[int, ...] = ()
    languages: tuple[str, ...] = ("en",)
    domain_allowlist: tuple[str, ...] = ()
    priority_terms: tuple[str, ...] = ()
    quality: QualityConfig = field(default_factory=QualityConfig)
    fields: tuple[ExtractionField, ...] = ()
    relevance: str = ""

    def __post_init__(self):
        if self.end_date < self.start_date:
            raise ConfigurationError("end_date lies before start_date")
        if not self.collection_ids and not self.source_ids:
            raise ConfigurationError("a topic needs collections or sources")
        if len({f.name for f in self.fields}) != len(self.fields):
            raise ConfigurationError("field names must differ")


@dataclass(frozen=True)
class AppConfig:
    topics: dict[str, TopicConfig]
    search: SearchConfig = field(default_factory=SearchConfig)
    fetch: FetchConfig = field(default_factory=FetchConfig)
    model: ModelConfig = field(default_factory=ModelConfig)

    def topic(self, name: str) -> TopicConfig:
        if name not in self.topics:
            raise ConfigurationError(f"unknown topic {name}")
        return self.topics[name]


def positive(name: str, value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ConfigurationError(f"{name} must be a positive whole number")
    return value


def _build(cls, data: dict):
    if not isinstance(data, dict):
        raise ConfigurationError(f"{cls.__name__}: a mapping is needed")
    known = {f.name: f for f in dataclasses.fields(cls)}
    if extra := sorted(set(data) - set(known)):
        raise ConfigurationError(f"{cls.__name__}: unknown {', '.join(extra)}")
    values = {}
    for name, value in data.items():
        kind = str(known[name].type)
        if name == "topics":
            value = {k: _build(TopicConfig, v) for k, v in value.items()}
        elif name == "fields":
            value = tuple(_build(ExtractionField, v) for v in value)
        elif kind in ("QualityConfig", "SearchConfig", "FetchConfig", "ModelConfig"):
            value = _build(globals()[kind], value)
        elif "date" in kind and isinstance(value, str):
            value = dt.date.fromisoformat(value)
        elif kind.startswith("tuple") and value is not None:
            value = tuple(value)
        values[name] = value
    try:
        return cls(**values)
    except (TypeError, ValueError) as e:
        raise ConfigurationError(f"{cls.__name__}: {e}") from e


def load(path: str | Path) -> AppConfig:
    """Configuration from a JSON or YAML file (YAML where the parser is installed)."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigurationError(str(e)) from e
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("YAML files need the yaml package; use JSON") from e
        data = yaml.safe_load(text)
    else:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise ConfigurationError(str(e)) from e
    try:
        return _build(AppConfig, data)
    except ValueError as e:
        raise ConfigurationError(str(e)) from e


def credential(name: str, env_file: str | Path | None = None) -> str:
    """A secret from the environment, else from a file of NAME=value lines; blank counts as missing."""
    values = {}
    if env_file is not None and Path(env_file).exists():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, sep, value = line.partition("=")
            if sep and not key.strip().startswith("#"):
                values[key.strip().removeprefix("export ").strip()] = value.strip().strip("'\"")
    found = os.environ.get(name, "").strip() or values.get(name, "").strip()
    if not found:
        raise CredentialError(f"{name} is not set")
    return found


#: Topic used by the queries over the shared test tables.
SAMPLE_TOPIC = TopicConfig(
    label="Sample", query="revolving door", start_date=dt.date(2021, 3, 1), end_date=dt.date(2025, 10, 31), collection_ids=(1,), languages=("en", "en-ca", "eng"),
    priority_terms=("revolving door", "lobbyist", "ethics office"),
    quality=QualityConfig(min_title_chars=20, exclude_url_patterns=("/sports/", "/video/", "/photo/"), exclude_title_terms=("land swap", "ferry lease")),
    fields=(
        ExtractionField("person_name"), ExtractionField("private_org"), ExtractionField("private_time", regex=r"\d{4}(?:-\d{4})?"),
        ExtractionField("public_org"), ExtractionField("public_time", regex=r"\d{4}(?:-\d{4})?"),
        ExtractionField("jurisdiction", allowed_values=("Alberta", "British Columbia", "Manitoba", "New Brunswick", "Newfoundland and Labrador", "Nova Scotia", "Ontario", "Prince Edward Island", "Quebec", "Saskatchewan")),
    ),
)
