import base64
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specframe.sources import codec


@pytest.mark.parametrize(("x", "halves"), [(1, [7, 1]), (16, [6, 0, 1]), (0, [8]), (256, [5, 0, 0, 1]), (-1, [15, 15])])
def test_half_bytes(x, halves):
    assert codec.encode_int(x) == halves
    assert codec.decode_ints(halves) == [x]


@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=30))
def test_half_byte_streams(xs):
    stream = [h for x in xs for h in codec.encode_int(x)]
    assert codec.decode_ints(codec._unpack(codec._pack(stream))) == xs


def test_known_bytes():
    assert codec.encode_slof([1, 2, 4]).hex() == "40e3e1e000000000406ebeaeffff"
    assert codec.encode_pic([5e6, 6.5e5, 2e6, 1.2e7]).hex() == "204b4c4301be920848e1200b17b0"
    assert codec.decode_pic(bytes.fromhex("204b4c4301be920848e1200b17b0")).tolist() == [5e6, 6.5e5, 2e6, 1.2e7]


@settings(max_examples=50)
@given(st.lists(st.floats(50, 2000), max_size=40).map(sorted))
def test_linear_round_trip(mz):
    assert np.allclose(codec.decode_linear(codec.encode_linear(mz)), mz, atol=1e-4)


@settings(max_examples=50)
@given(st.lists(st.floats(0, 1e7), max_size=40))
def test_slof_and_pic_round_trip(i):
    assert np.allclose(codec.decode_slof(codec.encode_slof(i)), i, rtol=1e-3, atol=1e-3)
    assert codec.decode_pic(codec.encode_pic(i)).tolist() == [int(x + 0.5) for x in i]


def test_leading_zeros_of_pic():
    assert codec.decode_pic(codec.encode_pic([0, 0, 0, 856, 0])).tolist() == [0, 0, 0, 856, 0]


def test_arrays():
    data = struct.pack("<3f", 1, 2.5, 3)
    assert codec.decode(base64.b64encode(data).decode(), ["MS:1000521", codec.PLAIN]).tolist() == [1, 2.5, 3]
    assert codec.decode(base64.b64encode(zlib.compress(struct.pack("<2q", 7, -1))).decode(), ["MS:1000522", codec.ZLIB]).tolist() == [7, -1]
    assert codec.decode(None, []).tolist() == []
    with pytest.raises(ValueError, match="text"):
        codec.decode("QUJD", [codec.ASCII])
    with pytest.raises(ValueError, match="no known type"):
        codec.decode("QUJD", ["MS:9"])
    for kinds in (["MS:1000523"], ["MS:1000523", codec.ZLIB], [codec.LINEAR], [codec.PIC], ["MS:1002746"]):
        assert np.allclose(codec.decode(codec.encode([100.0, 200.0, 300.0], kinds), kinds), [100, 200, 300])
