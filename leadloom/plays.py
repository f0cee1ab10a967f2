"""Market plays: what a campaign looks for, as plain configuration passed to operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from leadloom import fixed


@dataclass(frozen=True)
class Play:
    """Only the parts of a play that data operators read; keywords are lower case."""

    code: str
    target_naf_prefixes: tuple[str, ...] = ()
    target_naf_codes: tuple[str, ...] = ()
    excluded_naf_codes: tuple[str, ...] = ()
    excluded_naf_prefixes: tuple[str, ...] = ()
    cpv_prefixes: tuple[str, ...] = fixed.DEFAULT_CPV_PREFIXES
    positive_keywords: tuple[str, ...] = fixed.DEFAULT_AWARD_KEYWORDS
    negative_keywords: tuple[str, ...] = ()
    pain_hypothesis: str | None = None
    buyer_roles: tuple[tuple[str, int, tuple[str, ...]], ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.DEFAULT_WEIGHTS))
    penalties: dict[str, int] = field(default_factory=dict)
    readiness: dict[str, Any] = field(default_factory=dict)
    offer_name: str | None = None

    def penalty(self, name: str, default: int) -> int:
        return self.penalties.get(name, default)


def from_config(config: dict[str, Any]) -> Play:
    """Normalise a play dictionary: codes without dots in upper case, keywords in lower case."""
    values = dict(config)
    for key in ("target_naf_codes", "excluded_naf_codes"):
        values[key] = tuple(code.replace(".", "").upper() for code in values.get(key, ()))
    for key in ("positive_keywords", "negative_keywords"):
        if key in values:
            values[key] = tuple(word.lower() for word in values[key])
    return Play(**values)


FIELD_SERVICE = from_config(fixed.FIELD_SERVICE_PLAY)
FIELD_OPERATIONS_UK = from_config(fixed.FIELD_OPERATIONS_UK)
FIELD_OPERATIONS_FR = from_config(fixed.FIELD_OPERATIONS_FR)
PLAYS = {play.code: play for play in (FIELD_OPERATIONS_UK, FIELD_OPERATIONS_FR, FIELD_SERVICE)}
