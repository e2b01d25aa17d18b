"""Aggregates of the user's own in Python, in two phases.

An aggregator has a state that takes in values, and states that merge, so rows combine
before anything is shuffled: a task sends one state for each key that it meets (and when it
holds very many keys, what it has so far).  A key with a third of all rows is then as many
states as there are tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

HELD_KEYS = 50_000  # states that a task holds at once


@dataclass(frozen=True)
class Aggregator:
    """`start` makes an empty state, `add` takes in a value, `merge` puts two states together and
    `finish` gives the result, of the Spark type `returns`.  Nulls are added like other values;
    `add` and `merge` may change the state that they are given first."""

    start: Callable[[], Any]
    add: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    returns: str


def partial_states(df: DataFrame, key: str, value: Column, aggregator: Aggregator) -> DataFrame:
    """key and pickled `state` of the rows that a task has seen; rows with a null key are left out."""
    rows = df.select(key, value.alias("_value")).where(F.col(key).isNotNull())
    field = rows.schema[key]
    schema = StructType([field, StructField("state", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def sent() -> pa.RecordBatch:
            columns = [list(states), [pickle.dumps(s) for s in states.values()]]
            states.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                states[k] = aggregator.add(states[k] if k in states else aggregator.start(), v)
            if len(states) >= HELD_KEYS:
                yield sent()
        if states:
            yield sent()

    return rows.mapInArrow(run, schema)


def group_merge(df: DataFrame, key: str, value: Column, aggregator: Aggregator, name: str = "value") -> DataFrame:
    """Lookup of a user aggregate per key: key and the result as `name`.  Rows with a null key make
    no group.  States of a key are merged as they stream by, in no given order."""
    states = partial_states(df, key, value, aggregator)
    result = StructType.fromDDL(f"`{name}` {aggregator.returns}").fields[0]
    schema = StructType([states.schema[key], result])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_, state, out = None, None, []

        def moved() -> pa.RecordBatch:
            columns = zip(*out)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and k == key_:
                    state = (aggregator.merge(state[0], pickle.loads(s)),)
                    continue
                if state is not None:
                    out.append((key_, aggregator.finish(state[0])))
                key_, state = k, (pickle.loads(s),)
            if len(out) >= 1024:
                yield moved()
        if state is not None:
            out.append((key_, aggregator.finish(state[0])))
        if out:
            yield moved()

    return states.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
