"""Training-data operators: ten corpus-scale operations on document tables.

Nothing else in the library imports this subpackage.
"""
