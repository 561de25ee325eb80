"""MessagePack rows."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources.msgpack import from_msgpack, pack, to_msgpack, unpack

PLAIN = st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=40)
VALUES = st.recursive(PLAIN, lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20), max_leaves=30)


@given(VALUES)
@settings(deadline=None, max_examples=300)
def test_values_come_back(value):
    data = pack(value)
    assert unpack(data) == value
    with pytest.raises(ValueError):
        unpack(data + b"\x00")
    with pytest.raises(ValueError):
        unpack(data[:-1])


@pytest.mark.parametrize(
    ("value", "data"),
    [
        (0, b"\x00"), (127, b"\x7f"), (128, b"\xcc\x80"), (256, b"\xcd\x01\x00"), (1 << 16, b"\xce\x00\x01\x00\x00"), (-1, b"\xff"), (-33, b"\xd0\xdf"), (-200, b"\xd1\xff\x38"), ("a", b"\xa1a"), ("a" * 32, b"\xd9\x20" + b"a" * 32),
        (b"ab", b"\xc4\x02ab"), ([1, [2]], b"\x92\x01\x91\x02"), ({"k": None}, b"\x81\xa1k\xc0"), ([0] * 16, b"\xdc\x00\x10" + b"\x00" * 16), ("x" * 70_000, b"\xdb\x00\x01\x11\x70" + b"x" * 70_000), (1.5, b"\xcb" + struct.pack(">d", 1.5)),
    ],
)
def test_bytes_are_those_of_the_format(value, data):
    assert pack(value) == data and unpack(data) == value


def test_single_floats_and_unknown_kinds():
    assert unpack(b"\xca" + struct.pack(">f", 0.5)) == 0.5
    for bad in (b"\xc1", b"\xd4\x01\x02", b""):
        with pytest.raises(ValueError):
            unpack(bad)
    with pytest.raises(TypeError):
        pack(object())
    with pytest.raises(ValueError):
        pack(1 << 64)


def test_rows(spark):
    df = spark.createDataFrame([(1, "x", [1.0, None], True, None), (None, None, None, None, b"\x00")], "a long, b string, c array<double>, d boolean, e binary")
    assert from_msgpack(to_msgpack(df), df.schema).collect() == df.collect()
    assert [tuple(r) for r in from_msgpack(to_msgpack(df.select("a")), df.select("b", "a").schema).collect()] == [(None, 1), (None, None)]
