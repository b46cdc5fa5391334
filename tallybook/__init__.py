"""Multi-module sales bookkeeping as lazy PySpark DataFrame plans."""

from tallybook.books import Books

__all__ = ["Books"]
