"""Which model reads which language: settings of a deployment over known profiles, and the plug-ins they give."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from .. import catalog
from ..operators import detect


@dataclass(frozen=True)
class Profile:
    """What is known of a kind of model: languages, labels, and windows in characters and tokens."""

    kind: str
    languages: tuple[str, ...]
    labels: Mapping[str, str]
    ignored: tuple[str, ...] = ()
    characters: int = 1024
    overlap: int = 128
    most_tokens: int | None = None
    window_tokens: int = 448
    overlap_tokens: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.characters or not 0 <= self.overlap_tokens < self.window_tokens:
            raise ValueError("a window must be larger than its overlap")
        if self.most_tokens is not None and self.window_tokens >= self.most_tokens:
            raise ValueError("a window must leave room for special tokens")


# The profiles that settings can name.
PROFILES: dict[str, Profile] = {
    **{f"spacy-{x}-sm-v1": Profile("spacy", (x,), catalog.SPACY_LABELS, catalog.SPACY_IGNORED, 900_000, 10_000) for x in ("en", "de", "nl")},
    "gliner-multilingual-pii-v1": Profile("gliner", ("en", "de"), catalog.GLINER_LABELS, most_tokens=512),
    "kserve-en-openpii-v1": Profile("kserve", ("en",), {"PRIVATE": "PRIVATE"}, most_tokens=512),
    "kserve-de-superclinical-v1": Profile("kserve", ("de",), catalog.GERMAN_LABELS, most_tokens=512),
}


@dataclass(frozen=True)
class Model:
    """A deployed model: its profile, where it answers (none for one that is loaded here), and its own score floor."""

    profile: str
    endpoint: str | None = None
    threshold: float = 0.0

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("a threshold is from 0 to 1")


@dataclass(frozen=True)
class Settings:
    """One mode for a deployment (disabled, local or remote), its models, and the model of each language."""

    mode: str = "disabled"
    models: Mapping[str, Model] = field(default_factory=dict)
    language_models: Mapping[str, str] = field(default_factory=dict)
    most_calls: int = 2048

    def __post_init__(self) -> None:
        if self.mode not in ("disabled", "local", "remote"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode == "disabled" and (self.models or self.language_models):
            raise ValueError("a disabled deployment has no models")
        if set(self.language_models.values()) != set(self.models) or (self.mode != "disabled" and not self.models):
            raise ValueError("every model must be some language's, and every language's model be there")
        if not 1 <= self.most_calls <= 10_000:
            raise ValueError("calls are bounded by 1 to 10000")
        for language, name in self.language_models.items():
            model = self.models[name]
            profile = PROFILES[model.profile]
            if not re.fullmatch("[a-z][a-z0-9-]{0,63}", name):
                raise ValueError("a model's name is lower-case letters, digits and dashes")
            if language not in profile.languages:
                raise ValueError(f"{model.profile} does not read {language}")
            if (profile.kind == "spacy") != (self.mode == "local") or (model.endpoint is None) != (self.mode == "local"):
                raise ValueError("local models are loaded here, remote ones have an endpoint")

    def recognizers(self, languages: tuple[str, ...], calls: Mapping[str, Callable[[str], list[tuple[str, int, int, float]]]], too_large: type[Exception] = ValueError) -> list[detect.SpanModel]:
        """Plug-ins of the models that read some of ``languages``; ``calls`` asks each model by name."""
        wanted = dict.fromkeys(self.language_models[x] for x in languages if x in self.language_models)
        out = []
        for name in wanted:
            p = PROFILES[self.models[name].profile]
            out.append(detect.remote(name, calls[name], dict(p.labels), p.ignored, too_large, p.characters, p.overlap, self.most_calls))
        return out


def from_dict(value: Mapping[str, Any]) -> Settings:
    """Settings from plain data; unknown fields are errors."""
    for kind, given in ((Settings, value), *((Model, m) for m in value.get("models", {}).values())):
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
    return Settings(**{**value, "models": {k: Model(**m) for k, m in value.get("models", {}).items()}})


def load(path: str) -> Settings:
    """Settings from a JSON file, or a YAML file where the yaml module is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))
