"""Training-data operators: ten DataFrame operators and their registered queries.

Nothing else in the library imports this subpackage.
"""
