import math

import numpy as np
import pyarrow as pa
import pytest

from semisketch.functions import vectors as vec
from semisketch.functions.vectors import Encoding, string_matrices, token_matrices
from semisketch.operators.fingerprint import fingerprint, fingerprint_rows, parse_lengths


def decay_by_hand(text, length, decay=0.1):
    v, out = float(ord(text[0])), [0.0] * length
    out[ord(text[0]) % length] += 1
    for c in text[1:]:
        v = v * (1 - decay) + ord(c) * decay
        s = v * length / 10
        out[int(s) % length] += 1 - (s - int(s))
        out[int(s + 1) % length] += s - int(s)
    return out


@pytest.mark.parametrize("window", [1, 3, 7, 1 << 20])
def test_decay_across_windows(monkeypatch, window):
    monkeypatch.setattr(vec, "WINDOW_CHARS", window)
    texts = ["GATC", "a", "Motörhead 𝄞 long enough to be cut", "zz" * 40]
    (m,) = string_matrices(texts, [13], Encoding())
    np.testing.assert_allclose(m, [decay_by_hand(t, 13) for t in texts], atol=1e-9)
    (p,) = string_matrices(texts, [13], Encoding(string="pair_sum"))
    for row, t in zip(p, texts):
        hand = [0.0] * 13
        for a in [ord(t[0])] + [ord(x) + ord(y) for x, y in zip(t, t[1:])]:
            hand[a % 13] += 1
        np.testing.assert_allclose(row, hand)


@pytest.mark.parametrize("numeric", ["ME", "ML", "smooth", "simple"])
@pytest.mark.parametrize("dialect", ["v1", "v2"])
def test_vectors_sum_to_one_or_zero(numeric, dialect):
    tokens = ["i0", "i1", "i-7", "f0.02", "f-2.6", "i13", "s12e3", "btrue", "bfalse", "u", "s", "sword", "l"]
    for m in token_matrices(pa.array(tokens), [2, 13, 50], Encoding(dialect, numeric)):
        sums = m.sum(axis=1)
        assert np.all(np.isclose(sums, 1) | (m == 0).all(axis=1))


def one(token, **settings):
    return token_matrices(pa.array([token]), [13], Encoding(**settings))[0][0]


def test_dialects_differ_below_zero():
    # position -2.6 falls on cell 10 when wrapped as a fraction, on 11 when cut first
    assert one("f-2.6", dialect="v1", numeric="simple").argmax() == 10
    assert one("f-2.6", dialect="v2", numeric="simple").argmax() == 11


def test_v2_smooth_keeps_negative_shares():
    v = one("f-2.6", dialect="v2", numeric="smooth")
    assert v[11] == pytest.approx(1.6) and v[12] == pytest.approx(-0.6)


def test_exponent_of_small_numbers():
    # 0.02 is 2e-2 in v2 and 0.2e-1 in v1
    assert one("f0.02", dialect="v2")[-2] > 0 and one("f0.02", dialect="v1")[-1] > 0


def test_tokens_without_content():
    first = [1.0] + [0.0] * 12
    for token in ("s", "u", "s0.0", "sInf"):
        assert one(token, dialect="v2").tolist() == first
    for token in ("s0", "f0.0", "bfalse", "l"):
        assert one(token, dialect="v2").tolist() == [0.0] * 13
    for token in ("s", "u", "s0.0", "i0"):
        assert one(token, dialect="v1").tolist() == [0.0] * 13


def test_text_and_number_agree():
    assert one("s42", dialect="v2").tolist() == one("i42", dialect="v2").tolist()


def test_lengths():
    assert parse_lengths("13, 11 11,1,x") == [11, 13]
    with pytest.raises(ValueError):
        parse_lengths("1,x")


def test_product_sums_to_statements_and_sees_order(docs):
    texts = {"a": '{"k":["alpha","beta","gamma","delta"]}', "b": '{"k":["alpha","gamma","beta","delta"]}'}
    rows = {r.doc_id: r for r in fingerprint(docs(texts), 13, decimals=None).collect()}
    assert math.isclose(sum(rows["a"].fp), rows["a"].statements)
    assert not np.allclose(rows["a"].fp, rows["b"].fp)
    rows = {r.doc_id: r for r in fingerprint(docs(texts), 13, combine="average", decimals=None).collect()}
    assert np.allclose(rows["a"].fp, rows["b"].fp)


def test_partitioning_changes_nothing(docs):
    texts = {str(i): f'{{"k":[{i},"x{i}"],"n":{{"m":{i * 1.5}}}}}' for i in range(50)}
    some = fingerprint(docs(texts).repartition(7), "5,13", decimals=6)
    rest = fingerprint(docs(texts).coalesce(1), "5,13", decimals=6)
    key = lambda r: (r.doc_id, r.L)
    assert sorted(some.collect(), key=key) == sorted(rest.collect(), key=key)


def test_equal_ids_stay_apart(spark, docs):
    both = docs({"a": '{"x":1}'}).unionByName(docs({"a": '{"x":2}'}))
    assert fingerprint(both, 13).count() == 2


def test_row_mode(docs):
    texts = {"list": "[1,2]", "flat": '{"a":"12","b":[1,2],"c":{"d":true}}', "none": '{"x":""}'}
    rows = fingerprint_rows(docs(texts), 13).collect()
    assert [(r.doc_id, r.statements) for r in rows] == [("flat", 4)]
    assert abs(sum(rows[0].fp)) < 0.02
