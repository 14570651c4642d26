"""The query language: text to tokens to a typed tree."""

from .parser import ParseError, parse, parse_matchers
from .tree import kind_of

__all__ = ["ParseError", "kind_of", "parse", "parse_matchers"]
