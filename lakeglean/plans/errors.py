class QueryError(ValueError):
    """A query, option or schema that can't be used; raised before any plan is built."""
