"""Operators for preparing training data at corpus scale.

One module per operator; ``queries.py`` registers them for the driver tables.
Nothing else in the package imports this subpackage, so it can be removed as a
whole. All operators take plain DataFrames plus column names, use only those
columns, and leave every other column alone, whatever its name.
"""
