"""robots.txt rules: the longest matching rule decides, an allowing one on ties."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Robots:
    rules: tuple[tuple[str, bool], ...] = ()
    delay: float | None = None

    def allows(self, path: str) -> bool:
        matched = [(len(rule), allowed) for rule, allowed in self.rules if _pattern(rule).match(path or "/")]
        return max(matched)[1] if matched else True


def _pattern(rule: str) -> re.Pattern[str]:
    end = rule.endswith("$")
    return re.compile(".*".join(map(re.escape, (rule[:-1] if end else rule).split("*"))) + ("$" if end else ""))


def parse_robots(text: str, agent: str) -> Robots:
    """The rules for an agent, else those for ``*``; delays are between 0 and 300 seconds."""
    name = agent.partition("/")[0].strip().lower()
    groups: dict[str, list[tuple[str, bool]]] = {}
    delays: dict[str, float] = {}
    agents: list[str] = []
    open_group = False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_group else [value.lower()]
            open_group = True
            groups.setdefault(value.lower(), [])
            continue
        open_group = False
        for a in agents or ["*"]:
            if key in ("allow", "disallow") and value:
                groups.setdefault(a, []).append((value, key == "allow"))
            elif key == "crawl-delay":
                try:
                    delays[a] = min(300.0, max(0.0, float(value)))
                except ValueError:
                    pass
    own = next((a for a in groups if a != "*" and a in name), "*")
    return Robots(tuple(groups.get(own, ())), delays.get(own, delays.get("*")))
