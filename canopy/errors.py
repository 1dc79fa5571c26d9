"""What can go wrong with a query."""


class QueryError(Exception):
    """A query that cannot be answered."""


class QuerySyntaxError(QueryError):
    """The text is no query."""


class UnsupportedQueryError(QueryError):
    """A query that the compatible semantics have no result for."""


class UnexpectedTypeError(QueryError):
    """A value where a node is needed, or the other way round."""


class InvalidArgumentsError(QueryError):
    """Operands that an operator does not take."""


class InvalidVariableReferenceError(QueryError):
    """A variable that no binding in reach defines."""


class InvalidUnnestArgumentError(QueryError):
    """unnest takes one subquery, in a binding."""
