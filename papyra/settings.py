"""Settings from an environment file and the environment, checked; mail accounts from numbered variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    min_tags: int = 2
    max_tags: int = 4
    max_description_length: int = 128
    tag_similarity: float = 0.95
    cost_alert_threshold: float = 10.0
    email_check_interval: int = 300
    base_url: str = "http://localhost:8000"
    api_token: str = ""

    def problems(self) -> tuple[list[str], list[str]]:
        """What must be mended before a start, and what should be."""
        rules = [
            (self.environment not in ("development", "production", "testing"), "environment is unknown"), (not 1 <= self.min_tags <= self.max_tags, "min_tags is 1 to max_tags"),
            (self.max_description_length < 1, "max_description_length is positive"), (not 0 <= self.tag_similarity <= 1, "tag_similarity is 0 to 1"),
            (self.cost_alert_threshold < 0, "cost_alert_threshold is not negative"), (not 60 <= self.email_check_interval <= 3600, "email_check_interval is 60 to 3600"), (not self.api_token, "api_token is required")]
        return [text for bad, text in rules if bad], ["base_url is not encrypted"] if self.base_url.startswith("http://") else []


def env_file(path: str) -> dict[str, str]:
    """``KEY=value`` lines; blank lines and comments are skipped, quotes around a value are taken off."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """The environment goes before the file; names are those of the fields, in capitals. A value of the wrong type is an error."""
    env = os.environ if env is None else env
    given = {**(env_file(path) if path and Path(path).exists() else {}), **env}
    return Settings(**{f.name: type(f.default)(given[f.name.upper()]) for f in fields(Settings) if f.name.upper() in given})


def accounts(env: Mapping[str, str], slots: int = 3) -> list[dict]:
    """The mail accounts of the numbered slots that have a user and are not switched off."""
    out = []
    for k in range(1, slots + 1):
        of = lambda name, default="": env.get(f"EMAIL_ACCOUNT_{k}_{name}", default)  # noqa: E731, B023
        if of("USERNAME") and of("ENABLED", "true").lower() in ("true", "1", "yes"):
            out.append({"account": of("NAME", f"account {k}"), "server": of("SERVER"), "port": int(of("PORT", "993")), "username": of("USERNAME"), "folder": of("FOLDER", "INBOX")})
    return out
