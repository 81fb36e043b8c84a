from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsearch.functions import codecs

IDS = [34, 67, 89, 454, 2345738]
TFS = [12, 10, 3, 4, 1]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame([(IDS, TFS)], "ids array<bigint>, tfs array<bigint>")


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_roundtrip(lists, codec):
    enc = lists.select(codecs.encode_ids(codec, F.col("ids")).alias("i"), codecs.encode_counts(codec, F.col("tfs")).alias("t"))
    got = enc.select(codecs.decode_ids(codec, F.col("i")), codecs.decode_counts(codec, F.col("t"))).head()
    assert list(got[0]) == IDS and list(got[1]) == TFS


def test_bytes(lists):
    got = lists.select(
        F.lower(F.hex(codecs.encode_ids("vbe", F.col("ids")))),
        F.lower(F.hex(codecs.encode_ids("elias-gamma", F.col("ids")))),
        codecs.gaps(F.slice("ids", 1, 4)),
    ).head()
    assert got[0] == "a2a19602ed010f12c4"
    assert got[1] == "000000050460882e016e0000047928a0"
    assert got[2] == [34, 33, 22, 365]


def test_long_numbers(spark):
    big = [0, 127, 128, 2**31, 2**40 + 5, 2**53 + 1]
    df = spark.createDataFrame([(big,)], "n array<bigint>")
    built_in = df.select(codecs.vbe_encode(F.col("n")).alias("b")).head()[0]
    assert bytes(built_in) == codecs._vbe(np.array(big)) and codecs._vbe_numbers(bytes(built_in)).tolist() == big


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2**50), max_size=60))
def test_gamma_roundtrip(numbers):
    assert codecs._gamma_numbers(codecs._gamma(np.array(numbers, np.int64))).tolist() == numbers
    assert codecs._vbe_numbers(codecs._vbe(np.array(numbers, np.int64))).tolist() == numbers


def test_gamma_edges():
    assert codecs._gamma(np.array([], np.int64)) == b"\0\0\0\0"
    assert codecs._gamma_numbers(b"\0\0").tolist() == []
    with pytest.raises(ValueError):
        codecs._gamma(np.array([0]))
    whole = codecs._gamma(np.array([9, 9, 9], np.int64))
    assert codecs._gamma_numbers(whole[:-1]).tolist() == [9, 9]


def test_unknown_codec():
    with pytest.raises(ValueError):
        codecs.encode_ids("zip", F.col("x"))
