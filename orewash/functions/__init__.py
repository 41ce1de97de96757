from orewash.functions.values import blank_to_null, double_of, integer_of, text_of, timestamp_of, typed

__all__ = ["blank_to_null", "double_of", "integer_of", "text_of", "timestamp_of", "typed"]
