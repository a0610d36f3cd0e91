"""The library's tables that cut lineage (../scratch.py), under the name that the corpus operators use."""

from __future__ import annotations

from ..scratch import drop_scratch, fresh_path, mark, materialize, remember_table, shared_dir, ship

__all__ = ["drop_scratch", "fresh_path", "mark", "materialize", "remember_table", "shared_dir", "ship"]
