"""Linear bar codes as strings of modules (1 bar, 0 space), and Reed-Solomon codes; bar codes as expressions over columns too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published symbologies: element widths, bar first.
CODE128 = (
    "212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132 221231 "
    "213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313 231113 231311 "
    "112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 314111 221411 431111 "
    "111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 "
    "124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 "
    "211232 2331112"
).split()
EAN_LEFT = "3211 2221 2122 1411 1132 1231 1114 1312 1213 3112".split()
EAN_PARITY = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
ITF = "00110 10001 01001 11000 00101 10100 01100 00011 10010 01010".split()
START_B, STOP = 104, 106


def _modules(widths: str, first: str = "1") -> str:
    return "".join((first if i % 2 == 0 else "10"[int(first)]) * int(w) for i, w in enumerate(widths))


def code128(text: str) -> str | None:
    """Code set B; None for characters outside it."""
    if any(not 32 <= ord(c) <= 126 for c in text):
        return None
    values = [START_B, *(ord(c) - 32 for c in text)]
    check = (values[0] + sum(i * v for i, v in enumerate(values[1:], 1))) % 103
    return "".join(_modules(CODE128[v]) for v in [*values, check, STOP])


def read_code128(modules: str) -> str | None:
    """The text of a code set B symbol; None if it is damaged."""
    stop = _modules(CODE128[STOP])
    body = modules[: -len(stop)]
    if not modules.endswith(stop) or len(body) % 11:
        return None
    known = {_modules(w): i for i, w in enumerate(CODE128[:STOP])}
    values = [known.get(body[i : i + 11]) for i in range(0, len(body), 11)]
    if len(values) < 2 or None in values or values[0] != START_B:
        return None
    data, check = values[1:-1], values[-1]
    if (START_B + sum(i * v for i, v in enumerate(data, 1))) % 103 != check or any(v > 94 for v in data):
        return None
    return "".join(chr(v + 32) for v in data)


def _ean_digit(d: int, kind: str) -> str:
    left = _modules(EAN_LEFT[d], "0")
    right = left.translate(str.maketrans("01", "10"))
    return {"L": left, "R": right, "G": right[::-1]}[kind]


def gs1_digit(s: str) -> int:
    return -sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(reversed(s))) % 10


def ean13(s: str) -> str | None:
    """12 digits, to which the check digit is added, or 13 with a right one."""
    if not s.isdigit() or len(s) not in (12, 13):
        return None
    s = s if len(s) == 13 else s + str(gs1_digit(s))
    if gs1_digit(s[:12]) != int(s[12]):
        return None
    left = "".join(_ean_digit(int(d), k) for d, k in zip(s[1:7], EAN_PARITY[int(s[0])], strict=True))
    return "101" + left + "01010" + "".join(_ean_digit(int(d), "R") for d in s[7:]) + "101"


def read_ean13(m: str) -> str | None:
    if len(m) != 95 or m[:3] != "101" or m[45:50] != "01010" or m[92:] != "101":
        return None
    left = {_ean_digit(d, k): (d, k) for d in range(10) for k in "LG"}
    right = {_ean_digit(d, "R"): d for d in range(10)}
    a, b = [left.get(m[3 + 7 * i : 10 + 7 * i]) for i in range(6)], [right.get(m[50 + 7 * i : 57 + 7 * i]) for i in range(6)]
    if None in a or None in b:
        return None
    parity = "".join(k for _, k in a)
    if parity not in EAN_PARITY:
        return None
    s = str(EAN_PARITY.index(parity)) + "".join(str(d) for d, _ in a) + "".join(map(str, b))
    return s if gs1_digit(s[:12]) == int(s[12]) else None


def itf(s: str) -> str | None:
    """Interleaved 2 of 5 of an even number of digits; wide elements are three modules."""
    if not s.isdigit() or len(s) % 2:
        return None
    out = "1010"
    for a, b in zip(s[::2], s[1::2], strict=True):
        for x, y in zip(ITF[int(a)], ITF[int(b)], strict=True):
            out += "1" * (3 if x == "1" else 1) + "0" * (3 if y == "1" else 1)
    return out + "11101"


def read_itf(m: str) -> str | None:
    if not m.startswith("1010") or not m.endswith("11101"):
        return None
    runs, out = [], ""
    for c in m[4:-5]:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    if len(runs) % 10:
        return None
    for i in range(0, len(runs), 10):
        for part in (runs[i : i + 10 : 2], runs[i + 1 : i + 10 : 2]):
            code = "".join("1" if n == 3 else "0" for _, n in part)
            if code not in ITF:
                return None
            out += str(ITF.index(code))
    return out


class ReedSolomon:
    """Over GF(256) with generator 2 and the given reducing polynomial; roots start at alpha^first."""

    def __init__(self, parity: int, poly: int = 0x11D, first: int = 0) -> None:
        self.parity, self.first = parity, first
        self.exp, self.log = [0] * 512, [0] * 256
        x = 1
        for i in range(255):
            self.exp[i], self.log[x] = x, i
            x = x << 1 ^ (poly if x & 128 else 0)
        for i in range(255, 512):
            self.exp[i] = self.exp[i - 255]
        self.generator = [1]
        for i in range(parity):
            self.generator = self._times(self.generator, [1, self.exp[first + i]])

    def mul(self, a: int, b: int) -> int:
        return self.exp[self.log[a] + self.log[b]] if a and b else 0

    def _times(self, p: list[int], q: list[int]) -> list[int]:
        out = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                out[i + j] ^= self.mul(a, b)
        return out

    def _at(self, p: list[int], x: int) -> int:
        y = 0
        for c in p:
            y = self.mul(y, x) ^ c
        return y

    def encode(self, data: bytes) -> bytes:
        rest = list(data) + [0] * self.parity
        for i in range(len(data)):
            if k := rest[i]:
                for j, g in enumerate(self.generator):
                    rest[i + j] ^= self.mul(g, k)
        return bytes(data) + bytes(rest[len(data) :])

    def decode(self, code: bytes) -> bytes | None:
        """The data, with up to parity / 2 wrong bytes put right; None beyond that."""
        word = list(code)
        synd = [self._at(word, self.exp[self.first + i]) for i in range(self.parity)]
        if any(synd):
            loc, old, b, gap, size = [1], [1], 1, 1, 0  # locators with the constant term first
            for n in range(self.parity):
                d = synd[n]
                for i in range(1, size + 1):
                    d ^= self.mul(loc[i] if i < len(loc) else 0, synd[n - i])
                if not d:
                    gap += 1
                    continue
                k = self.mul(d, self.exp[255 - self.log[b]])
                new = loc + [0] * max(0, len(old) + gap - len(loc))
                for i, v in enumerate(old):
                    new[i + gap] ^= self.mul(k, v)
                if 2 * size <= n:
                    old, b, gap, size = loc, d, 1, n + 1 - size
                else:
                    gap += 1
                loc = new
            where = [p for p in range(len(word)) if self._at(loc[::-1], self.exp[(255 - (len(word) - 1 - p)) % 255]) == 0]
            if size > self.parity // 2 or len(where) != size:
                return None
            # error values from the syndromes: a small linear system, by elimination
            powers = [len(word) - 1 - p for p in where]
            rows = [[self.exp[(self.first + i) * e % 255] for e in powers] + [synd[i]] for i in range(size)]
            for c in range(size):
                pivot = next((r for r in range(c, size) if rows[r][c]), None)
                if pivot is None:
                    return None
                rows[c], rows[pivot] = rows[pivot], rows[c]
                inv = self.exp[255 - self.log[rows[c][c]]]
                rows[c] = [self.mul(v, inv) for v in rows[c]]
                for r in range(size):
                    if r != c and rows[r][c]:
                        k = rows[r][c]
                        rows[r] = [v ^ self.mul(k, w) for v, w in zip(rows[r], rows[c], strict=True)]
            for p, r in zip(where, rows, strict=True):
                word[p] ^= r[-1]
            if any(self._at(word, self.exp[self.first + i]) for i in range(self.parity)):
                return None
        return bytes(word[: len(word) - self.parity])


# The same as expressions over columns, which need no Python on executors. Digits are those of ASCII.


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(values: list, i: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i)


def _bits(m: Column, start: Column | int, n: int) -> Column:
    """The number that ``n`` modules from ``start`` (from 0) on spell."""
    return F.conv(F.substr(m, F.lit(start) + 1, F.lit(n)), 2, 10).cast("int")


def _joined(n: Column, each) -> Column:
    """``each`` of 0 to n - 1 in one string; null if one of them is."""
    parts = F.transform(F.sequence(F.lit(0), n - 1), each)
    return F.when(n <= 0, F.lit("")).otherwise(_let(parts, lambda p: F.when(~F.exists(p, lambda v: v.isNull()), F.array_join(p, ""))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def _code128_column(s: Column) -> Column:
    values = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - 32)
    known = [_modules(w) for w in CODE128]
    check = lambda values: ((START_B + _sum(F.transform(values, lambda v, i: v.cast("bigint") * (i + 1)))) % 103).cast("int")
    body = lambda values: F.array_join(F.transform(values, lambda v: _at(known, v)), "")
    return F.when(~s.rlike("[^ -~]"), _let(values, lambda v: F.concat(F.lit(known[START_B]), body(v), _at(known, check(v)), F.lit(known[STOP]))))


def _read_code128_column(m: Column) -> Column:
    stop = _modules(CODE128[STOP])
    known = {int(_modules(w), 2): i for i, w in enumerate(CODE128[:STOP])}
    table = [known.get(i) for i in range(1 << 11)]
    n = F.floor((F.length(m) - len(stop)) / 11).cast("int")
    whole = m.rlike("^[01]+\\z") & m.endswith(stop) & ((F.length(m) - len(stop)) % 11 == 0) & (n >= 2)
    values = F.when(whole, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(_at(table, _bits(m, i * 11, 11)), F.lit(-1))))

    def text(values: Column) -> Column:
        data = F.slice(values, 2, F.greatest(F.size(values) - 2, F.lit(0)))
        check = (START_B + _sum(F.transform(data, lambda v, i: v.cast("bigint") * (i + 1)))) % 103
        sound = (F.get(values, F.lit(0)) == START_B) & ~F.exists(data, lambda v: (v < 0) | (v > 94)) & (check == F.get(values, F.size(values) - 1))
        return F.when(sound, F.array_join(F.transform(data, lambda v: F.char(v + 32)), ""))

    return _let(values, text)


def _gs1_column(s: Column) -> Column:
    """The check digit of the first 12 digits."""
    d = lambda i: F.substring(s, i + 1, 1).cast("int")
    return F.pmod(-sum((d(i) * (3 if i % 2 else 1) for i in range(1, 12)), d(0)), F.lit(10))


def _ean13_column(s: Column) -> Column:
    def marks(full: Column) -> Column:
        d = lambda i: F.substring(full, i + 1, 1).cast("int")
        left = [_at([_ean_digit(x, EAN_PARITY[f][i]) for f in range(10) for x in range(10)], d(0) * 10 + d(i + 1)) for i in range(6)]
        right = [_at([_ean_digit(x, "R") for x in range(10)], d(i)) for i in range(7, 13)]
        return F.concat(F.lit("101"), *left, F.lit("01010"), *right, F.lit("101"))

    def whole(s: Column) -> Column:
        return F.when(F.length(s) == 12, F.concat(s, _gs1_column(s).cast("string"))).when(F.substring(s, 13, 1).cast("int") == _gs1_column(s), s)

    return _let(_let(F.when(s.rlike("^[0-9]{12,13}\\z"), s), whole), marks)


def _read_ean13_column(m: Column) -> Column:
    left = {int(_ean_digit(d, k), 2): d + 10 * (k == "G") for d in range(10) for k in "LG"}
    right = {int(_ean_digit(d, "R"), 2): d for d in range(10)}
    firsts = {sum((k == "G") << i for i, k in enumerate(p)): n for n, p in enumerate(EAN_PARITY)}

    def digits(m: Column) -> Column:
        a = [_at([left.get(i) for i in range(128)], _bits(m, 3 + 7 * i, 7)) for i in range(6)]
        b = [_at([right.get(i) for i in range(128)], _bits(m, 50 + 7 * i, 7)) for i in range(6)]
        first = _at([firsts.get(i) for i in range(64)], sum((F.when(v >= 10, 1 << i).when(v < 10, 0) for i, v in enumerate(a)), F.lit(0)))
        return F.concat(*(v.cast("string") for v in (first, *(v % 10 for v in a), *b)))

    s = _let(F.when(m.rlike("^101[01]{42}01010[01]{42}101\\z"), m), digits)
    return _let(s, lambda s: F.when(F.substring(s, 13, 1).cast("int") == _gs1_column(s), s))


def _itf_column(s: Column) -> Column:
    ok = s.rlike("^([0-9]{2})+\\z")
    pairs = [itf(f"{i:02d}")[4:-5] for i in range(100)]
    body = _joined(F.when(ok, (F.length(s) / 2).cast("int")), lambda i: _at(pairs, F.substr(s, i * 2 + 1, F.lit(2)).cast("int")))
    return F.when(ok, F.concat(F.lit("1010"), body, F.lit("11101")))


def _read_itf_column(m: Column) -> Column:
    ok = m.startswith("1010") & m.endswith("11101")
    body = F.when(ok, F.substr(m, F.lit(5), F.length(m) - 9))
    wide = F.transform(F.regexp_extract_all(body, F.lit("(?s)((.)\\2*)"), F.lit(1)), lambda r: (F.length(r) == 3).cast("int"))
    digits = {int(w, 2): str(i) for i, w in enumerate(ITF)}
    table = [digits.get(i) for i in range(32)]

    def digit(w: Column, h: Column) -> Column:  # bars and spaces of ten runs in turn
        at = F.floor(h / 2).cast("int") * 10 + h % 2
        return _at(table, sum((F.get(w, at + 2 * j) * (16 >> j) for j in range(1, 5)), F.get(w, at) * 16))

    return _let(wide, lambda w: F.when(F.size(w) % 10 == 0, _joined((F.size(w) / 5).cast("int"), lambda h: digit(w, h))))


ENCODERS = {"code128": _code128_column, "ean13": _ean13_column, "itf": _itf_column}
READERS = {"code128": _read_code128_column, "ean13": _read_ean13_column, "itf": _read_itf_column}


def encode(col: Column, kind: str) -> Column:
    """The modules of each text; null where the symbology cannot hold it."""
    return _let(col, ENCODERS[kind])


def read(col: Column, kind: str) -> Column:
    return _let(col, READERS[kind])
