"""All registered queries: name -> (Spark query, comparison SQL or None)."""

from __future__ import annotations

from inkgauge.plans import catalog_audit, catalog_full, catalog_jsonld, catalog_pages, catalog_repair, catalog_runs, catalog_stream, catalog_text

CATALOG: dict = {}
for _part in (catalog_text, catalog_pages, catalog_jsonld, catalog_runs, catalog_repair, catalog_audit, catalog_full, catalog_stream):
    CATALOG.update(_part.QUERIES)
