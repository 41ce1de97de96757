"""orewash: raw landing files in, trusted star schema out, on plain Spark DataFrames."""

from orewash.specs import EVENTS, SPECS, TRANSACTIONS, USERS, DatasetSpec, spec_for

__all__ = ["EVENTS", "SPECS", "TRANSACTIONS", "USERS", "DatasetSpec", "spec_for"]
