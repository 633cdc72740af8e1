"""Lineage cuts of the training-data operators: tables in the shared checkpoint folder."""

from ..storage import mark, release, shared_dir, written

__all__ = ["mark", "release", "shared_dir", "written"]
