"""Operators of a training-data pipeline over text tables.

Each module holds one operator with its own general interface; ``entries`` maps the
``opN_<name>`` queries to thin wrappers around them.
"""
