"""What a query can be refused for."""


class CypherError(Exception):
    """Any refusal of a query."""


class ParseError(CypherError):
    """The text is no statement."""


class SemanticError(CypherError):
    """The statement has no meaning: names, types or places are wrong."""


class NotSupported(CypherError):
    """A statement that could have a meaning, but not here."""


class ConstraintError(CypherError):
    """Data or a definition that goes against a constraint."""
