"""Properties over generated inputs of the pieces that need no cluster."""

import io

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.sources import avro


@settings(max_examples=80, deadline=None)
@given(st.lists(st.fixed_dictionaries({"n": st.integers(-(2**63), 2**63 - 1), "s": st.none() | st.text(), "b": st.binary(), "a": st.lists(st.none() | st.floats(allow_nan=False))})))
def test_avro_round_trip(rows):
    schema = {"type": "record", "name": "r", "fields": [{"name": "n", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "b", "type": "bytes"}, {"name": "a", "type": {"type": "array", "items": ["null", "double"]}}]}
    data = avro.container(rows, schema, block=3) + avro.container(rows[:1], schema)
    assert list(avro.records(data)) == rows + rows[:1]


@given(st.integers(-(2**63), 2**63 - 1))
def test_avro_numbers(n):
    assert avro._long(io.BytesIO(avro._put_long(n))) == n
