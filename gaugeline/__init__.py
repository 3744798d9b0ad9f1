"""Analytics over sensor readings on Spark."""

from .model import MISSING, Readings
from .operators.errors import BUILTIN, ErrorDefinition
from .operators.filters import FilterSpec, apply_filter, reject_reasons
from .operators.updates import Update, apply_updates
from .plans.query import Query

__all__ = [
    "BUILTIN", "ErrorDefinition", "FilterSpec", "MISSING", "Query", "Readings", "Update", "apply_filter",
    "apply_updates", "reject_reasons",
]
