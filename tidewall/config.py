"""Explicit policy settings. Nothing is read from the process environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Policy:
    """Switches and caps of every decision. Sizes are bytes."""

    home: str = "/home/u"
    git_hard_deny: bool = False
    allow_ip_literals: bool = False
    allow_sensitive: bool = False
    allow_malformed: bool = False
    extra_deny: tuple[str, ...] = field(default=())
    allow_paths: tuple[str, ...] = field(default=())
    event_cap: int = 8 << 20
    scan_cap: int = 5 << 20
    read_cap: int = 1 << 20
    fetch_cap: int = 5 << 20
    max_redirects: int = 5
    max_depth: int = 8
    #: Keep known oddities of the rules (see README); False repairs them.
    strict_quirks: bool = True
    #: Tool prefix whose own calls are not scanned again
    own_tools: tuple[str, ...] = ("mcp__tidewall__safe_fetch", "mcp__tidewall__safe_read", "mcp__tidewall__inspect")

    def __post_init__(self) -> None:
        for path in (*self.extra_deny, *self.allow_paths):
            if not path.startswith("/"):
                raise ValueError(f"path rules must be absolute: {path}")


#: Least cap that a setting may choose for scans and reads, and the most for reads and fetches
LEAST_CAP, MOST_CAP = 4096, 10 << 20


def env_flag(value: str | None) -> bool:
    """A switch given as text."""
    return (value or "").strip().lower() in {"1", "true", "yes", "on"}


def scan_cap(setting: int | None, default: int = 5 << 20) -> int:
    """A cap from a setting; too small ones are raised so that they can't switch scans off."""
    return max(LEAST_CAP, default if setting is None else setting)
