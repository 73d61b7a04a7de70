"""Training-data operators: ten corpus-scale text operators and their queries.

Nothing else in the package imports this subpackage; it can be deleted whole.
Each module holds one operator (general interface, real outputs) and, below
it, the thin contract query that derives digest columns from the operator.
"""
