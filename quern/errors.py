"""What statements can fail with."""


class EngineError(Exception):
    """Base of all errors the engine raises itself."""


class SyntaxFailure(EngineError): ...


class TableNotFound(EngineError): ...


class TableExists(EngineError): ...


class ColumnNotFound(EngineError): ...


class AmbiguousColumn(EngineError): ...


class IndexNotFound(EngineError): ...


class IndexExists(EngineError): ...


class InvalidValueCount(EngineError): ...


class StringOverflow(EngineError): ...


class IncompatibleType(EngineError): ...


class PrimaryKeyRepeat(EngineError): ...


class NullValue(EngineError): ...


class DatabaseNotFound(EngineError): ...


class DatabaseExists(EngineError): ...


class TransactionAborted(EngineError): ...
