"""User functions see their arguments only and may not call themselves."""

import pytest
from pyspark.sql import functions as F

from tessella.operators.functions import UserFunction, now


def test_calls_and_types(spark):
    half = UserFunction("half", {"x": "double"}, "double", lambda x: x / 2)
    quarter = UserFunction("quarter", {"x": "double"}, "double", lambda x: half(half(x)))
    assert spark.range(1).select(quarter(F.lit(10))).first()[0] == 2.5
    with pytest.raises(TypeError):
        half(1, 2)


def test_cycles_are_refused(spark):
    loop = UserFunction("loop", {"x": "int"}, "int", lambda x: loop(x))
    with pytest.raises(RecursionError):
        loop(F.lit(1))
    assert UserFunction.running == []


def test_now_is_one_literal(spark):
    c = now()
    assert len({r[0] for r in spark.range(4, numPartitions=4).select(c).collect()}) == 1
