"""Configuration: YAML with defaults, checked before use, and durations."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from palisade.functions.catalogue import PATTERNS
from palisade.operators.detect import Allow
from palisade.operators.records import CONTENT_FIELDS, Compression, Routing


@dataclass(frozen=True)
class Config:
    compression: Compression = field(default_factory=Compression)
    sensitivity: str = "medium"
    action: str = "warn"
    allow: Allow = field(default_factory=Allow)

    def routing(self, scan_only: bool = False, compress_only: bool = False) -> Routing:
        return Routing(self.sensitivity, self.action, self.allow, self.compression, scan_only, compress_only)


def load(text: str) -> Config:
    """A configuration from YAML text; unknown keys are ignored, bad values raise ValueError."""
    import yaml

    data = yaml.safe_load(text) or {}
    c, s = data.get("compress") or {}, data.get("scan") or {}
    allow = s.get("allow") or {}
    compression = Compression(
        max_content_length=int(c.get("max_content_length") or 0),
        strip_fields=tuple(c.get("strip_fields") or ()),
        content_fields=tuple(c.get("content_fields") or CONTENT_FIELDS),
        max_messages=int(c.get("max_messages") or 0),
        max_array_items=int(c.get("max_array_items") or 0),
    )
    config = Config(compression, s.get("sensitivity") or "medium", s.get("action") or "warn", Allow(tuple(allow.get("hosts") or ()), tuple(allow.get("patterns") or ())))
    if config.action not in ("warn", "block"):
        raise ValueError(f"action {config.action!r} is neither warn nor block")
    if config.sensitivity not in ("low", "medium", "high"):
        raise ValueError(f"sensitivity {config.sensitivity!r} is not low, medium or high")
    known = {p[0] for p in PATTERNS}
    for p in config.allow.patterns:
        if p not in known:
            raise ValueError(f"{p!r} in allow.patterns is no detector")
    if any(not h.strip() for h in config.allow.hosts):
        raise ValueError("an empty host in allow.hosts would fit every address")
    return config


def routing(text: str | None, scan_only: bool = False, compress_only: bool = False) -> Routing:
    """How lines are processed under a configuration; without one they are scanned only."""
    if text is None:
        return Routing(scan_only=True, compress_only=compress_only)
    return load(text).routing(scan_only, compress_only)


def load_allow(text: str) -> Allow:
    """The allow-list of a configuration for the hook; on any error nothing is allowed, and scanning goes on."""
    return hook_allow(text)[0]


def hook_allow(text: str, sensitivity: str = "medium", mode: str = "warn", name: str = "configuration") -> tuple[Allow, list[str]]:
    """(allow-list, warnings) of a configuration for the hook, which takes nothing else from it.

    An unreadable one allows nothing and warns. One that states a sensitivity or an action other than what holds warns that they are ignored.
    """
    import yaml

    try:
        config = load(text)
        stated = (yaml.safe_load(text) or {}).get("scan") or {}
    except Exception as e:  # noqa: BLE001  fail closed
        return Allow(), [f"{name}: {e} -- nothing is allowed"]
    ignored = ("sensitivity" in stated or "action" in stated) and (config.sensitivity, config.action) != (sensitivity, mode)
    return config.allow, [f"{name}: scan.sensitivity and scan.action are ignored by the hook, only scan.allow is applied"] if ignored else []


def default_hook_path() -> str | None:
    """Where the hook's configuration is looked for; None without a home."""
    home = os.environ.get("HOME")
    return os.path.join(home, ".config", "palisade", "hook.yaml") if home else None


def read_hook_allow(path: str | None = None, sensitivity: str = "medium", mode: str = "warn") -> tuple[Allow, list[str]]:
    """hook_allow of a file of the driver; without a path, of the default one if it is there."""
    if path is None:
        path = default_hook_path()
        if path is None or not os.path.exists(path):
            return Allow(), []
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as e:
        return Allow(), [f"{path}: {e} -- nothing is allowed"]
    return hook_allow(text, sensitivity, mode, path)


def parse_duration(text: str) -> int | None:
    """Seconds of durations such as 1h30m; None if malformed or nothing."""
    if not re.fullmatch(r"([0-9]+[hms])+", text):
        return None
    total = sum(int(n) * {"h": 3600, "m": 60, "s": 1}[u] for n, u in re.findall(r"([0-9]+)([hms])", text))
    return total or None
