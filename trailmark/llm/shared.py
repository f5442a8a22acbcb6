"""Helpers of the operators: lineage cuts in the shared folder and connected components."""

from trailmark.operators.graph import connected_components
from trailmark.session import discard, shared_folder, written

__all__ = ["connected_components", "discard", "shared_folder", "written"]
