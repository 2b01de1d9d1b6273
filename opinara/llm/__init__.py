"""Operators for preparing training text: each module holds one operator.

Nothing else in the library imports this package. Task code is shipped by value, so executors need
the third-party modules an operator names, but not this package.
"""

from ..session import ship_by_value

ship_by_value(__name__)
