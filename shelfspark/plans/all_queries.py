"""All queries of the catalog, and their SQL."""

from . import catalog, dom, fields, hierarchy, images, tagger, writes  # noqa: F401  each registers its own
from .registry import ORACLE, QUERIES  # noqa: F401
