import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.operators.scalar import canonical_json, e_state, finite, flatten_mappings, round_half_even
from ledgerlake.operators.statistics import pava


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(1, 4)), min_size=1, max_size=12))
def test_pava_is_the_pooled_fit(rows):
    y, w = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    fit = pava(y, w)
    # closed form: max over starts of the min over ends of weighted means
    n = len(y)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(fit, want, atol=1e-9)


def test_states_of_null_and_nan(spark):
    rows = [(0.7, 1.0), (0.5, 5.0), (0.7, 5.0), (float("nan"), 5.0), (None, 5.0), (0.6, 4.0)]
    d = spark.createDataFrame(rows, "y double, d double")
    assert [r[0] for r in d.select(e_state(F.col("y"), F.col("d"))).collect()] == ["correct", "error", "U", "U", "U", "correct"]
    assert [r[0] for r in d.select(e_state(F.col("y"), F.col("d"), nan_is_error=True)).collect()][3] == "error"
    assert [r[0] for r in d.select(finite(F.col("y"))).collect()] == [True, True, True, False, False, True]


def test_rounding_is_pythons(spark):
    xs = [0.12345, 2.67505, 0.00005, 1.00015, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(round_half_even("x")).collect()]
    assert got[:4] == [round(x, 4) for x in xs[:4]] and got[4] != got[4]


def test_mappings_flatten_with_shifted_and_unequal_segments(spark):
    seg = lambda a, b, u, v, author: {"chain_id": "A", "unp_start": u, "unp_end": v, "start": {"author_residue_number": author, "residue_number": a}, "end": {"author_residue_number": None, "residue_number": b}}
    payload = json.dumps({"1abc": {"UniProt": {"P1": {"mappings": [seg(1, 70, 35, 104, None), seg(1, 70, 31, 103, 5)]}}}})
    got = flatten_mappings(spark.createDataFrame([(payload,), (None,), ("{}",)], "payload string")).orderBy("segment").collect()
    assert [(r.entry, r.accession, r.first, r.unp_start, r.author_first, r.needs_alignment) for r in got] == [("1abc", "P1", 1, 35, None, False), ("1abc", "P1", 1, 31, 5, True)]


def test_canonical_json_sorts_and_escapes(spark):
    d = spark.createDataFrame([({"b": "é", "a": None},), (None,)], "m map<string,string>")
    assert [r[0] for r in d.select(canonical_json("m")).collect()] == ['{"a":null,"b":"\\u00e9"}', None]
