"""Training-data operators: ten self-contained components over text and vector tables.

Nothing else in the library imports this subpackage.
"""
