"""Forward-chaining rules over DataFrames."""

from .functions.expr import call, eq, f, lit, this, v
from .operators.rulebase import Rulebase, productions
from .operators.session import Session
from .plans.model import Action, FactType, RuleError, acc, and_, cond, exists, insert, not_, or_, query, retract, rule, test

__all__ = ["Action", "FactType", "RuleError", "Rulebase", "Session", "acc", "and_", "call", "cond", "eq", "exists", "f", "insert", "lit", "not_", "or_", "productions", "query", "retract", "rule", "test", "this", "v"]
