import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import symbology as S


def test_tables_are_sound():
    assert len(S.CODE128) == 107 == len(set(S.CODE128)) and all(sum(map(int, w)) == 11 for w in S.CODE128[:-1])
    assert len({S._ean_digit(d, k) for d in range(10) for k in "LGR"}) == 30
    assert all(c.count("1") == 2 for c in S.ITF)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=20), st.integers(0, 10**12 - 1))
def test_round_trips(text, n):
    assert S.read_code128(S.code128(text)) == text
    digits = f"{n:012d}"
    assert S.read_ean13(S.ean13(digits)) == digits + str(S.gs1_digit(digits))
    assert S.read_itf(S.itf(digits)) == digits


def test_damage_is_seen():
    m = S.code128("hello")
    assert S.read_code128(m[:20] + ("0" if m[20] == "1" else "1") + m[21:]) is None
    assert S.ean13("4006381333931") is not None and S.ean13("4006381333932") is None and S.code128("é") is None


def test_reed_solomon_corrects_up_to_half_its_parity():
    rng = random.Random(1)
    for parity, poly, first in ((10, 0x11D, 0), (8, 0x12D, 1), (2, 0x11D, 0)):
        rs = S.ReedSolomon(parity, poly, first)
        for _ in range(60):
            data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 60)))
            code = bytearray(rs.encode(data))
            for p in rng.sample(range(len(code)), min(len(code), rng.randint(0, parity // 2))):
                code[p] ^= rng.randrange(1, 256)
            assert rs.decode(bytes(code)) == data


def test_columns_agree_with_functions_and_need_no_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = ["", "a", "Hi ~ there", "é", "a\n", "12", "123", "400638133393", "4006381333931", "4006381333932", "12a456789012", None]
    texts += ["".join(rng.choice("0123456789") for _ in range(n)) for n in (2, 8, 10, 12, 12, 12, 20)]
    one = {"code128": (S.code128, S.read_code128), "ean13": (S.ean13, S.read_ean13), "itf": (S.itf, S.read_itf)}
    for kind, (write, read) in one.items():
        marks = [m for t in texts if t is not None and (m := write(t)) is not None]
        marks += [m[:i] + rng.choice("01x") + m[i + 1 :] for m in marks for i in rng.sample(range(len(m)), 8)] + ["", "1", "101011101", None]
        df = spark.createDataFrame([(t, None) for t in texts] + [(None, m) for m in marks], "t string, m string")
        out = df.select("t", "m", S.encode(F.col("t"), kind).alias("e"), S.read(F.col("m"), kind).alias("r"))
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        for r in out.collect():
            assert r.e == (None if r.t is None else write(r.t)), (kind, r.t)
            assert r.r == (None if r.m is None else read(r.m)), (kind, r.m)
