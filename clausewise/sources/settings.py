"""Settings as JSON objects of a catalog: markers, signer profile, prompt blocks, thresholds. All are small and read on the driver.

A missing, empty or unreadable object is the default.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict
from datetime import datetime, timezone

from ..operators.matcher import Decision
from .files import Catalog

#: Names of the objects.
MARKERS, PROFILE, PROMPTS, PROVIDERS = "markers.json", "signer_profile.json", "prompts.json", "llm_config.json"
#: Fixed value: the variable that names a model provider where the object does not.
PROVIDER_VARIABLE = "LLM_PROVIDER"
#: Where thresholds are looked for, in order; they are saved in the last place.
THRESHOLDS = ("settings/traffic_light.json", "traffic_light_config.json")
#: A profile without aliases.
NO_PROFILE = {"version": "1.0", "company_aliases": [], "signer_aliases": [], "updated_at": ""}


def _stored(catalog: Catalog | None, name: str):
    try:
        return catalog.read_json(name) if catalog is not None else None
    except ValueError:
        return None


def markers(catalog: Catalog | None, defaults: dict) -> dict:
    """The stored markers as they are, else the defaults."""
    return _stored(catalog, MARKERS) or dict(defaults)


def markers_of(catalog: Catalog | None, defaults: dict, language: str | None) -> dict:
    """A language's block of the markers, empty where it has none."""
    return markers(catalog, defaults).get("languages", {}).get((language or "").lower()[:2], {})


def profile(catalog: Catalog | None) -> dict:
    """The stored profile over the empty one."""
    return NO_PROFILE | (_stored(catalog, PROFILE) or {})


def save_profile(catalog: Catalog, value: dict, now: datetime | None = None) -> None:
    """Saves a profile with the time of saving."""
    stamp = (now or datetime.now(timezone.utc)).isoformat()
    catalog.write_json(PROFILE, value | {"updated_at": stamp})


def aliases(catalog: Catalog | None, language: str | None) -> dict[str, list[str]]:
    """Aliases of company and signer in a language; all of them where it has none. Blank ones go."""
    known, code = profile(catalog), (language or "").lower()[:2]

    def pick(key: str) -> list[str]:
        full = [a for a in known.get(key, []) if a.get("value", "").strip()]
        return [a["value"] for a in full if a.get("language") == code] or [a["value"] for a in full]

    return {"company": pick("company_aliases"), "signer": pick("signer_aliases")}


def prompts(catalog: Catalog | None, defaults: dict[str, str]) -> dict[str, str]:
    """Stored prompt blocks over the default ones."""
    return dict(defaults) | (_stored(catalog, PROMPTS) or {})


def thresholds(catalog: Catalog | None) -> Decision:
    """Thresholds from the first place that holds usable ones, else the default."""
    for name in THRESHOLDS:
        try:
            value = _stored(catalog, name)
            if value:
                return Decision(**value)
        except TypeError:  # unknown fields
            continue
    return Decision()


def save_thresholds(catalog: Catalog, value: Decision) -> None:
    catalog.write_json(THRESHOLDS[-1], asdict(value))


class Providers:
    """Model providers. Keys come from the environment only (``known`` maps a provider to its key's variable) and are never written; a catalog may hold which provider is preferred.

    All answers are read from one list, the best place first: the catalog's provider, the environment's, then all others with a key.
    """

    def __init__(self, catalog: Catalog | None, known: Mapping[str, str], env: Mapping[str, str] | None = None):
        self.catalog, self.known, self.env = catalog, dict(known), os.environ if env is None else env

    def prefer(self, provider: str) -> None:
        """Stores the name of the provider to use, and nothing else."""
        self.catalog.write_json(PROVIDERS, {"active_provider": provider.strip().lower()})

    def ranked(self) -> list[tuple[str, str, str]]:
        """(place, provider, key) of the providers with a key."""
        stored = _stored(self.catalog, PROVIDERS)
        named = [("catalog", stored.get("active_provider") if isinstance(stored, dict) else ""), ("environment", self.env.get(PROVIDER_VARIABLE, "")), *(("key", p) for p in self.known)]
        rows = [(place, p := str(name or "").strip().lower(), self.env.get(self.known.get(p, ""), "").strip()) for place, name in named]
        return [r for r in rows if r[2]]

    def key(self, provider: str) -> str:
        """A provider's key, else RuntimeError."""
        for _, name, key in self.ranked():
            if name == provider:
                return key
        raise RuntimeError(f"no key for the provider {provider}")

    def active(self) -> str:
        """The first provider that was chosen and has a key, else RuntimeError."""
        for place, name, _ in self.ranked():
            if place != "key":
                return name
        raise RuntimeError("no provider with a key")

    def configured(self) -> list[str]:
        """All providers with a key, the best first."""
        return list(dict.fromkeys(name for _, name, _ in self.ranked()))
