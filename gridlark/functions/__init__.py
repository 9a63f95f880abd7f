"""The expression language: syntax, functions, and compilation to Spark columns."""

from gridlark.functions.compile import CompiledExpression, Scope, compile_expression
from gridlark.functions.registry import STANDARD, ExpressionFunction, FunctionRegistry
from gridlark.functions.syntax import ErrorKind, ExpressionError, names, parse, to_source, try_parse
from gridlark.functions.types import ExprType

__all__ = [
    "STANDARD",
    "CompiledExpression",
    "ErrorKind",
    "ExprType",
    "ExpressionError",
    "ExpressionFunction",
    "FunctionRegistry",
    "Scope",
    "compile_expression",
    "names",
    "parse",
    "to_source",
    "try_parse",
]
