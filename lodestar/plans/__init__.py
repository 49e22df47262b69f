"""All queries of the engine and their SQL; importing the modules registers them."""

from .queries import ORACLE, QUERIES  # isort: skip
from . import graphs, readers, updates

__all__ = ["ORACLE", "QUERIES", "graphs", "readers", "updates"]
