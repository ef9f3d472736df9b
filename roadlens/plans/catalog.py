"""All queries of the library by name, with SQL of the same meaning."""

from __future__ import annotations

from . import fleet, intake, journeys, learning, live, talk  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
