"""Every registered query with its check SQL."""

from catalog.base import ORACLES, QUERIES  # noqa: F401
from catalog import ranking, scalars, relational, analyses, data  # noqa: F401,E402
