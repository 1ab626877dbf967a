"""What a worker keeps between tasks changes no encoding, and columns of any name pass."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common, encode, lattice

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_frequent_strings_are_cut_once():
    """Strings asked for again and again are made once, however many others pass by; values stay those of the strings."""
    made = []
    kept = lattice.Recent(lambda words: (made.extend(words), [w * 2 for w in words])[1], most=40)
    for i in range(50):
        words = [b"often", *(b"%d-%d" % (i, j) for j in range(9))]
        of = kept.add(words)
        assert all(of[w] == w * 2 for w in words)
        assert len(kept.known) + len(kept.older) <= 40 + 20
    assert made.count(b"often") == 1


def test_tasks_share_what_they_know():
    assert encode.best_of(common.PIECE_MODEL) is encode.best_of(common.PIECE_MODEL)
    v, rng = lattice.vocabulary(common.PIECE_MODEL), random.Random(5)
    words = [bytes(rng.choice(b"aehst n\xc3\xa9") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    for w, ids in zip(words, lattice.best_segmentations(v, words), strict=True):
        assert encode.best_of(common.PIECE_MODEL).add([w])[w] == ids
        assert b"".join(v.pieces[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)) == w


def test_encode_and_decode_bear_quotes_in_names(spark):
    common.ready(spark)
    rows = spark.createDataFrame([(1, "one two", 5), (2, None, 6), (3, "a" * 40_000, 7)], "doc_id long, text string, x int").withColumnRenamed("x", "c`d.e")
    got = encode.decode(encode.encode(rows), into="back`s").collect()
    assert len(got) == 3 and all(r["back`s"] == r["text"] and r["c`d.e"] == r["doc_id"] + 4 for r in got)


def test_texts_of_ids_are_made_without_a_python_object_a_piece():
    """Nulls, empty lists, slices and bytes that aren't UTF-8, as by joining the pieces one by one."""
    import pyarrow as pa

    v, rng = lattice.vocabulary(common.PIECE_MODEL), random.Random(9)
    rows = [[rng.choice([*v.ids.values()]) for _ in range(rng.randrange(6))] for _ in range(60)] + [None, [], [int(v.byte_ids[255])] * 3]
    rows += [[v.ids[b" "], v.ids[b"\xc3"]] if b"\xc3" in v.ids else [int(v.byte_ids[0xC3])] * 2, None, [v.ids[b" the"]]]
    want = [None if x is None else b"".join(v.pieces[i] for i in x)[1:].decode("utf-8", "replace") for x in rows]
    ids, pieces = pa.array(rows, pa.list_(pa.int32())), encode.piece_bytes(common.PIECE_MODEL)
    assert encode.texts_of(ids, pieces).to_pylist() == want
    for a in range(len(rows)):
        assert encode.texts_of(ids.slice(a, 2), pieces).to_pylist() == want[a : a + 2]
