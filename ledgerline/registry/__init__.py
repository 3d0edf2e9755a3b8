"""All queries by name, and the SQL that checks them."""

from ledgerline.registry import bom, ledger, lineage, quality, stages, state
from ledgerline.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bom", "ledger", "lineage", "quality", "stages", "state"]
