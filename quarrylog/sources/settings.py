"""Settings: loaded, clamped and saved; a filter is the part that queries use."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, replace

from quarrylog.operators.filters import FilterSpec

from .capture import CaptureError, CaptureSpec

DEFAULT_COMMAND = "logcat -v threadtime -b main"
# Least and largest of each number.
LIMITS = {"font_size": (10, 20), "row_height": (16, 32), "width": (960, 3840), "height": (560, 2160)}
RECENT = 10


@dataclass(frozen=True)
class Settings:
    font_size: int = 12
    row_height: int = 20
    width: int = 1280
    height: int = 800
    recent_files: tuple[str, ...] = ()
    command: str = DEFAULT_COMMAND
    last_filter: FilterSpec = field(default_factory=FilterSpec)

    def normalized(self) -> Settings:
        """Numbers within limits, recent files different and at most ten, a command that parses or else the default."""
        clamped = {k: min(max(getattr(self, k), lo), hi) for k, (lo, hi) in LIMITS.items()}
        try:
            command = CaptureSpec.parse(self.command).normalized()
        except CaptureError:
            command = DEFAULT_COMMAND
        return replace(self, **clamped, command=command, recent_files=tuple(dict.fromkeys(f for f in self.recent_files if f))[:RECENT])


def loads(text: str) -> Settings:
    raw = tomllib.loads(text)
    spec = raw.pop("last_filter", None)
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Settings.__dataclass_fields__}
    return Settings(**known, **({"last_filter": FilterSpec.from_json(json.dumps(spec))} if spec else {})).normalized()


def dumps(settings: Settings) -> str:
    quote = json.dumps
    head = [f"{k} = {getattr(settings, k)}" for k in LIMITS]
    head += [f"recent_files = [{', '.join(map(quote, settings.recent_files))}]", f"command = {quote(settings.command)}"]
    spec = json.loads(settings.last_filter.to_json())
    plain = [f"{k} = {quote(v)}" for k, v in spec.items() if not isinstance(v, dict)]
    tables = [line for k, v in spec.items() if isinstance(v, dict) for line in (f"[last_filter.{k}]", *(f"{a} = {quote(b)}" for a, b in v.items()))]
    return "\n".join([*head, "[last_filter]", *plain, *tables, ""])


def bookmarks_toml(lines: list[int]) -> str:
    """The sidecar of a source's bookmarks."""
    return f"version = 1\nlines = {sorted(set(x for x in lines if x > 0))}\n"


def load_bookmarks(text: str) -> list[int]:
    raw = tomllib.loads(text)
    return sorted({x for x in raw.get("lines", []) if x > 0}) if raw.get("version") == 1 else []
