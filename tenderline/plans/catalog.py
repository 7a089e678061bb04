"""All registered queries and their SQL."""

from __future__ import annotations

from tenderline.plans import drawings, engineering, normalising, quotes, quoting, records, reporting, texts

_MODULES = (quoting, engineering, reporting, records, normalising, drawings, quotes, texts)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "recommended_plant"
