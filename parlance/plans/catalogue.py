"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from parlance.plans import calls, live, ordered, search, vault  # noqa: F401
from parlance.registry import ORACLES, QUERIES  # noqa: F401
