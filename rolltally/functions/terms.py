"""Normal form of a written answer: sums of products, so that equal terms have equal keys.

A term is a sum of monomials, each a rational factor, the square root of a square-free number and powers of names (pi, letters, and what can't be multiplied out: a
sum in a denominator, a root of a sum, a function of something). Tokens are folded into it with two stacks (operators by precedence), so nesting has no limit.
What is no such term is compared by its text.

Applied to distinct texts only (see ``answers.answer_key``): plain numbers and words never come here, and each worker remembers the keys it made.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

#: One monomial's names with exponents, and its radicand -> factor.
Term = dict[tuple[tuple[tuple[str, Fraction], ...], int], Fraction]

#: Beyond these a term isn't multiplied out: its text decides.
MOST_MONOMIALS = 256
MOST_BITS = 1 << 13
#: Square factors are divided out up to this prime; what is left of larger radicands counts as square-free unless it is a square.
MOST_DIVISOR = 1 << 17

ONE = Fraction(1)


class NotATerm(Exception):
    """The text is no term of this form."""


def number(value: Fraction) -> Term:
    return {((), 1): value} if value else {}


def name(symbol: str, exponent: Fraction = ONE) -> Term:
    return {(((symbol, exponent),), 1): ONE}


def constant(term: Term) -> Fraction | None:
    """The value of a term that is a rational number, else null."""
    return Fraction(0) if not term else term.get(((), 1)) if len(term) == 1 else None


def added(a: Term, b: Term, factor: int = 1) -> Term:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + factor * v
    if len(out) > MOST_MONOMIALS:
        raise NotATerm
    return {k: v for k, v in out.items() if v}


def multiplied(a: Term, b: Term) -> Term:
    if len(a) * len(b) > MOST_MONOMIALS:
        raise NotATerm
    out: Term = {}
    for (names_a, root_a), x in a.items():
        for (names_b, root_b), y in b.items():
            powers = dict(names_a)
            for symbol, e in names_b:
                powers[symbol] = powers.get(symbol, 0) + e
            both = math.gcd(root_a, root_b)
            key = (tuple(sorted((s, e) for s, e in powers.items() if e)), root_a * root_b // both**2)
            out[key] = out.get(key, 0) + x * y * both
    if any(max(v.numerator.bit_length(), v.denominator.bit_length()) > 2 * MOST_BITS for v in out.values()):
        raise NotATerm
    return {k: v for k, v in out.items() if v}


def divided(a: Term, b: Term) -> Term:
    if not b:
        raise NotATerm
    if len(b) == 1:
        ((names, root), factor), = b.items()
        return multiplied(a, {(tuple((s, -e) for s, e in names), root): 1 / (factor * root)})
    if a and a.keys() == b.keys() and len({a[k] / b[k] for k in a}) == 1:
        return number(next(a[k] / b[k] for k in a))
    if len(b) == 2 and not any(names for names, _ in b):  # two square roots: rational after the conjugate
        (first, x), (second, y) = sorted(b.items())
        return multiplied(multiplied(a, {first: x, second: -y}), number(1 / (x * x * first[1] - y * y * second[1])))
    lead = b[min(b)]
    return multiplied(a, multiplied(number(1 / lead), name(f"({written({k: v / lead for k, v in b.items()})})", Fraction(-1))))


@lru_cache(1 << 12)
def square_free(n: int) -> tuple[int, int]:
    """(s, r) with n = s * s * r and r square-free."""
    out, rest, d = 1, 1, 2
    while d * d * d <= n and d <= MOST_DIVISOR:
        while n % (d * d) == 0:
            n //= d * d
            out *= d
        if n % d == 0:
            n //= d
            rest *= d
        d += 1 if d == 2 else 2
    root = math.isqrt(n)
    return (out * root, rest) if root * root == n else (out, rest * n)


def _integer_root(n: int, k: int) -> int | None:
    """The k-th root of ``n`` if it is whole."""
    if n < 2:
        return n
    low, high = 1, 1 << (n.bit_length() // k + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**k <= n else (low, mid - 1)
    return low if low**k == n else None


def rooted(a: Term, k: int) -> Term:
    """The k-th root of ``a``."""
    if not 1 <= k <= 64:
        raise NotATerm
    if k == 1 or not a:
        return a
    opaque = lambda: name(f"({written(a)})", Fraction(1, k))
    if len(a) > 1:
        return opaque()
    ((names, root), factor), = a.items()
    if root != 1 or any((e / k).denominator == 1 for _, e in names):  # the root of a square of a name is its absolute value
        return opaque()
    out: Term = {(tuple((s, e / k) for s, e in names), 1): ONE}
    negative, factor = factor < 0, abs(factor)
    if k == 2:
        outer, inner = square_free(factor.numerator * factor.denominator)
        out = multiplied(out, {((), inner): Fraction(outer, factor.denominator)})
        return multiplied(out, name("i")) if negative else out
    whole = _integer_root(factor.numerator, k), _integer_root(factor.denominator, k)
    if None in whole or (negative and k % 2 == 0):
        return opaque()
    return multiplied(out, number(Fraction(*whole) * (-1 if negative else 1)))


def raised(a: Term, exponent: Term) -> Term:
    power = constant(exponent)
    if power is None:
        return name(f"({written(a)})^({written(exponent)})")
    if power.denominator != 1:
        return raised(rooted(a, power.denominator), number(Fraction(power.numerator)))
    n = int(power)
    if n < 0:
        return divided(number(ONE), raised(a, number(Fraction(-n))))
    if not n:
        if not a:
            raise NotATerm
        return number(ONE)
    if len(a) > 1 and n > 16:
        return name(f"({written(a)})", Fraction(n))
    if n * max((max(abs(v.numerator).bit_length(), v.denominator.bit_length()) + r.bit_length() for (_, r), v in a.items()), default=1) > MOST_BITS:
        raise NotATerm
    out, square = number(ONE), a
    while n:
        if n & 1:
            out = multiplied(out, square)
        n >>= 1
        if n:
            square = multiplied(square, square)
    return out


def written(term: Term) -> str:
    """The monomials in order, each as factor, names and root."""
    parts = []
    for (names, root), factor in sorted(term.items()):
        powers = [s if e == 1 else f"{s}^{e}" for s, e in names]
        parts.append("*".join([str(factor), *powers, *([f"√{root}"] if root != 1 else [])]))
    return "+".join(parts) or "0"


# ---- from text to term

# Names of Greek letters and of functions.
GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega varphi varepsilon infty".split())
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh ln log exp lg".split())
# Signs that stand for others.
SIGNS = {"−": "-", "–": "-", "×": "*", "·": "*", "⋅": "*", "÷": "/", "π": "\\pi\0", "∞": "\\infty\0", "²": "^{2}", "³": "^{3}", "√": "\\sqrt\0"}

_TOKEN = re.compile(
    r"(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<command>\\[A-Za-z]+)|(?P<word>[A-Za-z]{3,})|(?P<letter>[A-Za-z])(?:_(?:\{(?P<sub>[A-Za-z0-9]+)\}|(?P<index>[A-Za-z0-9])))?"
    r"|(?P<sign>[-+*/^!(){}%])|(?P<gap>\0)"
)
_INDEX = re.compile(r"\0?\[(\d{1,2})\]")
#: What a function without brackets may be applied to: one number or name that nothing binds closer.
_ARGUMENT = re.compile(r"\0?(?:[({]|(?:\d+(?:\.\d+)?|[A-Za-z]|\\[a-z]+)(?=[-+)}]|\Z))")
_MOST_DIGITS = 300
_PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "^": 4}
#: Marks on the operator stack below which nothing is folded: a bracket, the radicand of a root, the argument of a function, the halves of a fraction.
_OPENING = {"(": ")", "{": "}"}


class _Fold:
    """Two stacks: values, and operators that wait for their right side."""

    def __init__(self) -> None:
        self.values: list[Term] = []
        self.waiting: list[tuple] = []  # (operator,), (bracket, "("), or (prefix, its arguments yet to come, ...)
        self.operand = False  # whether a value has just ended

    def apply(self, operator: str) -> None:
        if len(self.values) < (1 if operator == "neg" else 2):
            raise NotATerm
        b = self.values.pop()
        if operator == "neg":
            self.values.append(added({}, b, -1))
            return
        a = self.values.pop()
        self.values.append({"+": added, "-": lambda x, y: added(x, y, -1), "*": multiplied, "/": divided, "^": raised}[operator](a, b))

    def operate(self, operator: str) -> None:
        if not self.operand:
            if operator not in "+-":
                raise NotATerm
            if operator == "-":
                self.waiting.append(("neg",))
            return
        while self.waiting and len(self.waiting[-1]) == 1:
            above = _PRECEDENCE[self.waiting[-1][0]]
            if above < _PRECEDENCE[operator] or operator == "^":  # powers are taken from the right
                break
            self.apply(self.waiting.pop()[0])
        self.waiting.append((operator,))
        self.operand = False

    def begin(self) -> None:
        """A value begins: next to another one it is multiplied."""
        if self.operand:
            self.operate("*")

    def value(self, term: Term) -> None:
        self.begin()
        self.values.append(term)
        self.end()

    def end(self) -> None:
        """A value ended: it may be the last argument of roots, functions and fractions."""
        self.operand = True
        while self.waiting and self.waiting[-1][0] == "prefix":
            _, what, missing = self.waiting.pop()
            if missing > 1:
                self.waiting.append(("prefix", what, missing - 1))
                self.operand = False
                return
            if what == "frac":
                self.apply("/")
            elif isinstance(what, int):
                self.values.append(rooted(self.values.pop(), what))
            else:
                self.values.append(name(f"{what}({written(self.values.pop())})"))

    def open(self, bracket: str) -> None:
        self.begin()
        self.waiting.append(("bracket", bracket))
        self.operand = False

    def close(self, bracket: str) -> None:
        if not self.operand:
            raise NotATerm
        while self.waiting and len(self.waiting[-1]) == 1:
            self.apply(self.waiting.pop()[0])
        if not self.waiting or self.waiting[-1][0] != "bracket" or _OPENING[self.waiting.pop()[1]] != bracket:
            raise NotATerm
        self.end()

    def prefix(self, what: str | int, arguments: int) -> None:
        self.begin()
        self.waiting.append(("prefix", what, arguments))
        self.operand = False

    def result(self) -> Term:
        if not self.operand:
            raise NotATerm
        while self.waiting:
            if len(self.waiting[-1]) != 1:
                raise NotATerm
            self.apply(self.waiting.pop()[0])
        if len(self.values) != 1:
            raise NotATerm
        return self.values[0]


def term_of(text: str) -> Term:
    """The term that ``text`` (without white space and layout) writes; raises ``NotATerm``."""
    fold, at = _Fold(), 0
    while at < len(text):
        token = _TOKEN.match(text, at)
        if token is None:
            raise NotATerm
        at = token.end()
        kind, said = token.lastgroup, token.group()
        if kind in ("sub", "index"):
            fold.value(name(f"{token['letter']}_{token['sub'] or token['index']}"))
        elif kind == "number":
            if len(said) > _MOST_DIGITS or (fold.operand and text[token.start() - 1].isalnum()):  # 1.2.3, x2
                raise NotATerm
            fold.value(number(Fraction(said)))
        elif kind in ("letter", "word"):
            if kind == "word" and (said in FUNCTIONS or text[at : at + 1] == "("):
                raise NotATerm
            fold.value(name(said))
        elif kind == "sign":
            if said in _OPENING:
                fold.open(said)
            elif said in ")}":
                fold.close(said)
            elif said == "!":
                n = constant(fold.values.pop()) if fold.operand else None
                if n is None or n.denominator != 1 or not 0 <= n <= 1000:
                    raise NotATerm
                fold.values.append(number(Fraction(math.factorial(int(n)))))
            elif said == "%":
                fold.value(name("%"))
            elif said in _PRECEDENCE:
                fold.operate(said)
            else:
                raise NotATerm
        elif kind == "command":
            command = said[1:]
            if command == "frac":
                fold.prefix("frac", 2)
            elif command == "sqrt":
                index = _INDEX.match(text, at)
                at = index.end() if index else at
                fold.prefix(int(index[1]) if index else 2, 1)
            elif command in ("cdot", "times"):
                fold.operate("*")
            elif command == "div":
                fold.operate("/")
            elif command in GREEK:
                fold.value(name(command))
            elif command in FUNCTIONS and _ARGUMENT.match(text, at):
                fold.prefix(command, 1)
            else:
                raise NotATerm
    return fold.result()


# ---- keys

_UNIT = re.compile(r"(?<=[\d})])(?:\\[ ,;:!]|\s|~)*\\(?:text|textrm|mathrm|mbox)\{[^{}\d]*\}(?:\^\{?\d\}?)?\Z")
_LAYOUT = (
    (re.compile(r"\\left(?![a-z])|\\right(?![a-z])|\\displaystyle"), ""),
    (re.compile(r"\\(?:text|textbf|textit|textrm|mathrm|mathbf|mbox|operatorname)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\^\{?(?:\\circ|\\degree)\}?|\\degree|°"), ""),
    (re.compile(r"\\%"), "%"),
    (re.compile(r"\\[dtc]frac"), r"\\frac"),
    (re.compile(r"\\frac(\d)(\d)"), r"\\frac{\1}{\2}"),
    (re.compile(r"\\frac(\d)\{"), r"\\frac{\1}{"),
    (re.compile(r"\\frac(\{[^{}]*\})(\d)"), r"\\frac\1{\2}"),
    (re.compile(r"\\sqrt(\d)"), r"\\sqrt{\1}"),
    (re.compile(r"^[a-zA-Z](?:_\{?\w+\}?)?=(?=[^=])"), ""),
    (re.compile(r"(?<=[)}\w])\.\Z"), ""),
)
_SIGN = re.compile("[" + "".join(SIGNS) + "]")
_THOUSANDS = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?")
_WHOLE = re.compile(r"([+-]?)(\d+)(?:\.0*)?")
_RATIO = re.compile(r"([+-]?\d+(?:\.\d+)?):([+-]?\d+(?:\.\d+)?)")
_SCIENTIFIC = re.compile(r"([+-]?\d+(?:\.\d+)?)[eE]([+-]?\d{1,3})")
_MIXED = re.compile(r"([+-]?)(\d+)(\\frac\{\d+\}\{\d+\})")
_SPACE = re.compile(r"\s+")
_PLUS_MINUS = re.compile(r"\\pm(?![a-z])|±")


def _layout_gone(text: str) -> str:
    for pattern, to in _LAYOUT:
        text = pattern.sub(to, text)
    return text


def number_key(value: Fraction) -> str:
    """Six decimals, half up, as ``decimal(38,6)`` has them, for numbers of any size."""
    millionths = math.floor(abs(value) * 10**6 + Fraction(1, 2))
    return f"n:{'-' if value < 0 and millionths else ''}{millionths // 10**6}.{millionths % 10**6:06d}"


def _one_case(term: Term) -> Term:
    """Names in small letters, except where a term has both cases of a name."""
    names = {s for monomial, _ in term for s, _ in monomial}
    if all(s == s.lower() or s.lower() in names for s in names):
        return term
    lowered = {s.lower() for s in names}
    if len(lowered) != len(names):
        return term
    return {(tuple(sorted((s.lower(), e) for s, e in monomial)), root): v for (monomial, root), v in term.items()}


def term_key(text: str) -> str | None:
    """Key of a single term, null where ``text`` is none."""
    whole = _WHOLE.fullmatch(text)
    if whole:  # without a limit on its digits
        digits = whole[2].lstrip("0") or "0"
        return f"n:{'-' if whole[1] == '-' and digits != '0' else ''}{digits}.000000"
    ratio, power, mixed = _RATIO.fullmatch(text), _SCIENTIFIC.fullmatch(text), _MIXED.fullmatch(text)
    try:
        if ratio:
            term = divided(number(Fraction(ratio[1])), number(Fraction(ratio[2])))
        elif power:
            term = number(Fraction(power[1]) * Fraction(10) ** int(power[2]))
        elif mixed:
            term = added(number(Fraction(mixed[2])), term_of(mixed[3]))
            term = added({}, term, -1) if mixed[1] == "-" else term
        else:
            term = term_of(text)
        key = _key_of(term)
    except (NotATerm, ValueError):  # also numbers of thousands of digits
        return None
    return key


def _key_of(term: Term) -> str:
    value = constant(term)
    if value is not None:
        return number_key(value)
    term = _one_case(term)
    if len(term) == 1:
        ((names, root), factor), = term.items()
        if root == factor == 1 and len(names) == 1 and names[0][1] == 1 and names[0][0].isalpha() and len(names[0][0]) == 1:
            return f"t:{names[0][0]}"
    return f"e:{written(term)}"


def _split(text: str) -> list[str]:
    """Parts between the commas outside of brackets."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{\x01":
            depth += 1
        elif c in ")]}\x02":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]]


def _bracketed(text: str) -> bool:
    """Whether the first bracket closes at the end."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{\x01") - (c in ")]}\x02")
        if not depth:
            return i == len(text) - 1
    return False


#: Lists nested deeper than this compare by their text.
MOST_LEVELS = 8


def _item_key(text: str, level: int) -> str:
    return (list_key(text, level + 1) if level < MOST_LEVELS else None) or term_key(text) or f"t:{text.lower()}"


def list_key(text: str, level: int = 0) -> str | None:
    """Key of a tuple, interval, set or bare list, null where ``text`` is none. Sets and bare lists have no order."""
    if text[:1] in ("(", "[", "{", "\x01") and text[-1:] in (")", "]", "}", "\x02") and _bracketed(text):
        items = _split(text[1:-1])
        opened, closed = {"\x01": "{"}.get(text[0], text[0]), {"\x02": "}"}.get(text[-1], text[-1])
        if len(items) > 1 or text[0] == "\x01":
            keys = [_item_key(x, level) for x in items]
            keys = sorted(set(keys)) if opened == "{" else keys
            return f"l:{opened}{','.join(keys)}{closed}"
        return None
    items = _split(text)
    if len(items) == 1 and len(_PLUS_MINUS.findall(text)) == 1:
        items = [_PLUS_MINUS.sub(sign, text) for sign in "+-"]
    return f"l:{','.join(sorted(_item_key(x, level) for x in items))}" if len(items) > 1 else None


def normal_text(text: str, evaluation: bool) -> str:
    """Voting: no white space, small letters. Evaluation: no dollar signs and blanks, small letters, stripped."""
    return text.replace("$", "").replace(" ", "").lower().strip() if evaluation else _SPACE.sub("", text).lower()


_COMMAND_GAP = re.compile(r"(\\[A-Za-z]+)\s+(?=[A-Za-z0-9])")
_CONTROL = re.compile(r"[\0-\x02]")


def _bare(answer: str) -> str:
    """The answer without white space, layout, units and thousands separators; set brackets as control characters."""
    text = re.sub(r"\\[!,;: ]|\$", "", _UNIT.sub("", answer).replace("{,}", ",")).strip()
    if _THOUSANDS.fullmatch(text):
        text = text.replace(",", "")
    text = _layout_gone(_SPACE.sub("", _COMMAND_GAP.sub("\\1\0", text)))
    return _SIGN.sub(lambda m: SIGNS[m.group()], text).replace("\\{", "\x01").replace("\\}", "\x02")


def _answer_key(answer: str, evaluation: bool) -> str | None:
    marked = any(c in answer for c in "\\=°$")
    text = normal_text(_layout_gone(answer) if marked else answer, evaluation)
    if not text:
        return None
    if not _CONTROL.search(answer):
        bare = _bare(answer)
        if not re.fullmatch(r"[A-Za-z]{2,}", bare):
            key = list_key(bare) or term_key(bare)
            if key:
                return key
    return f"t:{text}"


_remembered = lru_cache(1 << 16)(_answer_key)


def answer_key(answer: str, evaluation: bool = False) -> str | None:
    """Key of an answer; null for one without any text. Keys of short answers are remembered."""
    return (_remembered if len(answer) <= 256 else _answer_key)(answer, evaluation)
