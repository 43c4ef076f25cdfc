"""The registry of named operators: what there is, what a session supports, and making one by its name."""

from .registry import Operator, Report, create, names, operator, support

__all__ = ["Operator", "Report", "create", "names", "operator", "support"]
