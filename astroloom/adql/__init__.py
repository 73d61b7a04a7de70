"""ADQL: lexer, parser, gate and rendering to one Spark SQL statement."""

from .translate import ConeHint, Translation, translate

__all__ = ["ConeHint", "Translation", "translate"]
