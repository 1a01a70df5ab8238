"""Training-data pipeline operators.

One module for each operator, ``registry`` lists their queries and SQL. Nothing
else in the library imports this subpackage; it can be deleted as a whole.
"""
