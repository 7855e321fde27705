"""Registered queries, one module per area of the operator inventory."""

from coverlake.queries import (binning, cleaning, conformal, evaluation, io_queries, search, splits,  # noqa: F401
                               models, universe, valuation)
