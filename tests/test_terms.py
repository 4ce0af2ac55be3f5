"""Answer terms: pairs that mean the same, pairs that don't, and random terms against numeric evaluation."""

import math
import random
from fractions import Fraction

import pytest

from rolltally.functions import terms
from rolltally.functions.terms import answer_key

# Two ways of writing one answer, divided by a bar.
EQUAL = r"""
\frac{2}{\sqrt{2}} | \sqrt{2}
1+\sqrt{2} | \sqrt{2}+1
x^2+1 | 1+x^2
2\cdot3 | 6
\frac{x}{2} | 0.5x
2x+3 | 3+2x
1e3 | 1000
5! | 120
\pm 3 | 3,-3
\sqrt[3]{8} | 2
\sqrt{\frac{1}{4}} | 0.5
5\text{ cm} | 5
\frac{1}{1+\sqrt{2}} | \sqrt{2}-1
(x+1)^2 | x^2+2x+1
(x+1)(x-1) | x^2-1
2\pi r | 2r\pi
\frac{\pi}{2} | 0.5\pi
\pi^2 | \pi\cdot\pi
\sqrt{2}^2 | 2
2^{\pi} | 2^\pi
\sqrt{8} | 2\sqrt{2}
\frac{\sqrt{2}}{2} | \frac{1}{\sqrt{2}}
\sqrt{2}\sqrt{3} | \sqrt{6}
\frac{6}{4} | 1.5
1\frac{1}{2} | \frac{3}{2}
-\frac{1}{2} | \frac{-1}{2}
2^{-1} | 0.5
x^{-1} | \frac{1}{x}
a+b | b+a
ab+1 | 1+ba
2(3+4) | 14
-(x-1) | 1-x
\frac{2x+2}{2} | x+1
\frac{x+1}{x-1} | \frac{2x+2}{2x-2}
\sqrt{x+1} | (x+1)^{\frac{1}{2}}
\sqrt{x+1} | \sqrt{1+x}
\frac{\frac{1}{2}}{3} | 1/6
10^{-2} | 0.01
3\times 10^{8} | 300000000
\sqrt{1000000000} | 10000\sqrt{10}
\frac{1}{0.00000001234567} | \frac{100000000000000}{1234567}
-x^2 | -1x^2
2^3^2 | 512
\sqrt{12}+\sqrt{27} | 5\sqrt{3}
\frac{1}{\sqrt{3}+\sqrt{2}} | \sqrt{3}-\sqrt{2}
\frac{3}{2\sqrt{3}} | \frac{\sqrt{3}}{2}
e^{2} | e^2
\sin(x) | \sin x
\sin(x+1) | \sin(1+x)
\cos\theta | \cos(\theta)
\ln(2) | \ln 2
2\sin x | \sin(x)\cdot2
\alpha+\beta | \beta+\alpha
x_1+x_2 | x_2+x_1
x_{12} - 1 | -1+x_{12}
(1, \frac{4}{2}) | (1.0, 2)
\{2, 1, 1\} | \{1,2\}
(-\infty, 2] | \left(-\infty,\frac{4}{2}\right]
2\pm\sqrt{3} | 2-\sqrt{3}, 2+\sqrt{3}
1,234,567 | 1234567
50\% | 50%
x = 3 | 3
y=2x+1 | 1+2x
\text{Monday} | monday
X + 1 | x+1
(x+y)z | xz+yz
\frac{a+b}{2} | \frac{b}{2}+\frac{a}{2}
90^\circ | 90
3:4 | \frac{3}{4}
\sqrt{-4} | 2i
4\sqrt{\frac{1}{2}} | 2\sqrt{2}
\frac{10^{20}}{10^{18}} | 100
\sqrt[4]{16} | 2
8^{\frac{1}{3}} | 2
π | \pi
3×4 | 12
√12 | 2\sqrt{3}
x² | x^2
5 − 7 | -2
\frac12 | \dfrac{1}{2}
(x+1)^3 | (x+1)(x+1)^2
\frac{x^3}{x} | x^2
2^{10} | 1024
\mathrm{km} | km
$\frac{7}{2}$ | 3.5
1.50\text{ m}^2 | 1.5
\left(\frac{1}{2}\right)^{3} | 0.125
12\,000 | 12000
"""
UNEQUAL = r"""
\pi^2 | \pi
\frac{1}{\pi} | \pi
\pi^2 | \frac{1}{\pi}
2^{\pi} | 2\pi
\sqrt{2}^2 | \sqrt{2}
\frac{2}{\sqrt{2}} | 2\sqrt{2}
\frac{1}{\sqrt{2}} | \sqrt{2}
\sqrt{2}+1 | \sqrt{2}-1
x^2 | 2x
x+1 | x-1
(x+1)^2 | x^2+1
\frac{x}{2} | \frac{2}{x}
-x^2 | (-x)^2
2^3 | 3^2
2^{x} | x^2
\sqrt{x^2} | x
\sqrt{x+1} | \sqrt{x}+1
\sin(2x) | 2\sin x
\sin x | \cos x
\sin(x)^2 | \sin(x^2)
\ln 2 | 2
\log_2 8 | \log 8
ab | a+b
2ab | 2a+b
x_1 | x_2
x_{12} | x_1 2
x2 | 2x
(1,2) | (2,1)
(1,2) | [1,2]
(0,1] | [0,1)
\{1,2\} | \{1,3\}
\{1\} | 1
3,-3 | 3
\pm 3 | 3
\pm 3 | -3
1,234 | 1, 234
50\% | 50
50\% | 0.5
1/0 | 0
1/0 | 2/0
0.333 | 1/3
0.333333 | 0.333334
10^{400} | 10^{401}
\frac{1}{0.00000001234567} | 81000059
\sqrt{1000000000} | 31622.776602
\sqrt[3]{9} | 3
\sqrt[3]{2} | \sqrt{2}
\sqrt{-4} | 2
\sqrt{-4} | -2
5! | 5
5! | 25
1e3 | 1e4
1e3 | 13
1.2.3 | 1.23
E | F
Monday | Tuesday
north | thorn
no | on
x | y
X_1 | X
a<b | a>b
x>1 | x\ge1
x \in [0,1] | [0,1]
\overline{AB} | AB
3 \text{ or } 4 | 34
3 \text{ and } 4 | 3, 4
5\text{ cm} | 5\text{ cm}+1
1:2:3 | 1:6
f(x)=2x | 2x
a=b=c | a=c
2\frac{1}{3} | \frac{2}{3}
2\frac{x}{3} | 2+\frac{x}{3}
\infty | -\infty
\frac{\pi}{2} | \frac{\pi}{3}
\frac{x+1}{x-1} | \frac{x-1}{x+1}
\frac{1}{x+1} | \frac{1}{x}+1
e^x | x^e
|x| | x
\binom{4}{2} | \frac{4}{2}
i | 1
\sqrt{3}i | \sqrt{3}
4\sqrt{5} | 5\sqrt{4}
\sin2 | sin*2
007 | 70
2-3 | 23
-0.000001 | 0.000001
""".replace("|x| | x\n", "\\|x\\| | x\n")


def pairs(text):
    return [tuple(x.strip() for x in line.split(" | ")) for line in text.strip().splitlines()]


def test_tables_are_large():
    assert len(pairs(EQUAL)) >= 80 and len(pairs(UNEQUAL)) >= 80


@pytest.mark.parametrize("a, b", pairs(EQUAL))
def test_equal(a, b):
    assert answer_key(a) == answer_key(b) is not None


@pytest.mark.parametrize("a, b", pairs(UNEQUAL))
def test_unequal(a, b):
    assert answer_key(a) != answer_key(b)
    assert answer_key(a, True) != answer_key(b, True)


def random_term(rng, depth):
    """A term as text and as a function of x, y and z that are sure to tell two terms apart."""
    if depth == 0 or rng.random() < 0.2:
        kind = rng.randrange(4)
        if kind == 0:
            n = rng.randint(0, 12)
            return str(n), lambda v: n
        if kind == 1:
            n = rng.choice([2, 3, 8, 12])
            return rf"\sqrt{{{n}}}", lambda v: math.sqrt(n)
        s = rng.choice(["x", "y", r"\pi "])
        return s, lambda v: math.pi if s[0] == "\\" else v[s]
    (a, f), (b, g) = random_term(rng, depth - 1), random_term(rng, depth - 1)
    kind = rng.randrange(5)
    if kind == 0:
        return f"({a}+{b})", lambda v: f(v) + g(v)
    if kind == 1:
        return f"({a}-{b})", lambda v: f(v) - g(v)
    if kind == 2:
        return rf"({a})\cdot ({b})", lambda v: f(v) * g(v)
    if kind == 3:
        n = rng.randint(2, 9)
        return rf"\frac{{{a}}}{{{n}}}", lambda v: f(v) / n
    return f"({a})^2", lambda v: f(v) ** 2


def test_keys_agree_with_values():
    """Terms without quotients of sums have equal keys exactly where their values are equal at random points."""
    rng = random.Random(5)
    at = [{"x": rng.uniform(0.5, 2), "y": rng.uniform(0.5, 2)} for _ in range(3)]
    made = [random_term(rng, rng.randint(0, 3)) for _ in range(1500)]
    by_key, by_value = {}, {}
    for text, f in made:
        key = answer_key(text)
        if not key or key[0] == "t" and len(text) > 2:  # too long to multiply out
            continue
        value = tuple(float(f"{f(v):.9g}") + 0.0 for v in at)
        if key.startswith("n:"):
            value = tuple(round(x, 6) + 0.0 for x in value)
        if any(abs(x) > 1e6 or abs(x) < 1e-6 for x in value):
            continue
        by_key.setdefault(key, set()).add(value)
        by_value.setdefault(value, set()).add(key)
    assert len(by_key) > 300
    close = lambda values: all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for v in values for a, b in zip(v, min(values), strict=True))
    assert all(close(v) for v in by_key.values())
    assert all(len(k) == 1 for k in by_value.values())


def test_square_free_part():
    rng = random.Random(1)
    for n in [*range(1, 500), *(rng.randrange(1, 10**12) for _ in range(200)), (10**9 + 7) ** 2, (10**9 + 7) * 10**6]:
        outer, rest = terms.square_free(n)
        assert outer * outer * rest == n
        if n < 500:
            assert all(rest % (d * d) for d in range(2, 23))


def test_hard_texts_end_soon():
    for text in ["(" * 20_000 + "x" + ")" * 20_000, "{" * 50_000, "2^" * 400 + "2", "x+" * 30_000 + "x", "9" * 20_000, "9" * 5000 + "/7", "(x+y+z)^{16}", "+".join(f"x_{{{i}}}" for i in range(3000)),
                 "\\frac" * 9000, "\\sqrt" * 9000, "1!" * 400, "(a+b)" * 300, "\x00\x01", "-" * 9000 + "1", "2^{2^{2^{2^{2^{2}}}}}", "1e999", ",".join("x" * 5000), "9" * 999 + "!", "(1," * 5000 + "1" + ")" * 5000]:
        assert answer_key(text) is not None
    assert answer_key("-" * 9000 + "1") == "n:1.000000" and answer_key("9" * 5000) == answer_key("+0" + "9" * 5000 + ".0")


def test_numbers_round_half_up():
    assert answer_key("1/3") == "n:0.333333" and answer_key("-2/3") == "n:-0.666667" and answer_key("0.0000005/1") == "n:0.000001" and answer_key("-0.0000001/1") == "n:0.000000"
    assert terms.number_key(Fraction(-5, 2)) == "n:-2.500000"
