"""Readers of the engine's tables, and the binding of its shapes to the star-schema tables."""

from lodestar.sources.bindings import curves, interactions, item_profile, table, token_sequences, vectors
from lodestar.sources.files import content_id, scan_files, scan_status, select_existing

__all__ = ["content_id", "curves", "interactions", "item_profile", "scan_files", "scan_status", "select_existing", "table", "token_sequences", "vectors"]
