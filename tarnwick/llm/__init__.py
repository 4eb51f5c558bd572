"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` applies them to the driver's tables and derives the digest columns of the contracts.
"""
