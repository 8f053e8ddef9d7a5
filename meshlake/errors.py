"""Errors of the store and its query language."""


class StoreError(RuntimeError):
    """Base of all errors of the store."""


class DimensionMismatch(StoreError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class NodeNotFound(StoreError):
    def __init__(self, node: int):
        super().__init__(f"no node {node}")
        self.node = node


class QueryParseError(StoreError):
    pass
