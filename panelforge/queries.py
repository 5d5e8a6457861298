"""All registered queries of the library (the training-data subpackage registers its own)."""

from panelforge.catalog import aggregates, cleaning, joins, linear, panels, resampling, sampling, sources, vectors, windows, workloads  # noqa: F401
from panelforge.registry import QUERIES, SQL  # noqa: F401
