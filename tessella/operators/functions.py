"""User functions: plain Python functions over columns, or over tables, with checked arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import as_column

#: How deep user functions may call each other.
DEPTH = 64


class UserFunction:
    """A reusable expression with typed parameters and one typed output. It sees its arguments only, never the caller's
    columns, and nothing of it runs outside the JVM: calling it builds a column."""

    running: list[str] = []

    def __init__(self, name: str, parameters: dict[str, str], returns: str, body: Callable[..., Column]):
        self.name, self.parameters, self.returns, self.body = name, parameters, returns, body

    def __call__(self, *args) -> Column:
        if len(args) != len(self.parameters):
            raise TypeError(f"{self.name} takes {len(self.parameters)} arguments")
        if self.name in UserFunction.running or len(UserFunction.running) >= DEPTH:
            raise RecursionError(f"{self.name} calls itself, or calls are nested over {DEPTH} deep")
        UserFunction.running.append(self.name)
        try:
            return self.body(*[as_column(a).cast(kind) for a, kind in zip(args, self.parameters.values(), strict=True)]).cast(self.returns)
        finally:
            UserFunction.running.pop()


def table_function(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A function from table to table in a chain."""
    return df.transform(f)


def parameter(values: dict[str, object], name: str, kind: str) -> Column:
    """A parameter of the run as a column of its type; one that is not given is an error."""
    if name not in values:
        raise KeyError(f"parameter {name} is not given")
    return F.lit(values[name]).cast(kind)


def runtime_value(name: str, mapping: str | None = None) -> Column:
    """What is known of a run: "current_datetime", or "mapping_path" (the path of the job's own definition, as given)."""
    if name == "current_datetime":
        return now()
    if name != "mapping_path" or mapping is None:
        raise KeyError(name)
    return F.lit(mapping)


def now() -> Column:
    """The time at which the plan is built: one literal for the whole run."""
    from datetime import datetime

    return F.lit(datetime.now().isoformat(timespec="seconds"))
