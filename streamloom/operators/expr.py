"""The rule language: parsed to a tree and compiled to a Column by the types of the fields."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>[A-Za-z_]\w*(?:\.\w+)*)|(?P<op>=~|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:(),]))"
)
_REGEX = re.compile(r"\s*/((?:[^/\\]|\\.)*)/")
#: Operators from loosest to tightest; all join from the left.
LEVELS = (("||",), ("&&",), ("==", "!=", "=~"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


class RuleError(ValueError):
    """A rule that does not parse or names an unknown field or function."""


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> tuple[str, str] | None:
        m = _TOKEN.match(self.text, self.at)
        return (m.lastgroup, m[m.lastgroup]) if m else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        m = _TOKEN.match(self.text, self.at)
        if not m or want is not None and m[m.lastgroup] != want:
            raise RuleError(f"expected {want or 'a value'} at {self.at} of {self.text!r}")
        self.at = m.end()
        return m.lastgroup, m[m.lastgroup]

    def whole(self):
        tree = self.choice()
        if self.text[self.at :].strip():
            raise RuleError(f"unexpected text at {self.at} of {self.text!r}")
        return tree

    def choice(self):
        test = self.level(0)
        if self.peek() != ("op", "?"):
            return test
        self.take("?")
        yes = self.choice()
        self.take(":")
        return ("if", test, yes, self.choice())

    def level(self, n: int):
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while (t := self.peek()) and t[0] == "op" and t[1] in LEVELS[n]:
            self.take()
            if t[1] == "=~":
                m = _REGEX.match(self.text, self.at)
                if not m:
                    raise RuleError(f"expected a /pattern/ at {self.at} of {self.text!r}")
                self.at = m.end()
                left = ("match", left, m[1].replace("\\/", "/"))
            else:
                left = ("op", t[1], left, self.level(n + 1))
        return left

    def unary(self):
        kind, text = self.take()
        if text in ("!", "-") and kind == "op":
            return ("not" if text == "!" else "neg", self.unary())
        if text == "(" and kind == "op":
            inner = self.choice()
            self.take(")")
            return inner
        if kind == "num":
            return ("lit", float(text) if re.search("[.eE]", text) else int(text))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if self.peek() == ("op", "("):
                self.take("(")
                args = []
                while self.peek() != ("op", ")"):
                    args.append(self.choice())
                    if self.peek() == ("op", ","):
                        self.take(",")
                self.take(")")
                return ("call", text, args)
            return ("lit", {"true": True, "false": False, "nil": None}[text]) if text in ("true", "false", "nil") else ("var", text)
        raise RuleError(f"unexpected {text!r} in {self.text!r}")


def _num(x: tuple[Column, str]) -> Column:
    col, kind = x
    return col if kind == "num" else col.cast("string").try_cast("double") if kind == "str" else col.cast("double")


def _str(x: tuple[Column, str]) -> Column:
    return x[0].cast("string")


#: Name: (function of typed arguments, kind of the result).
FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "string.length": (lambda s: F.length(_str(s)), "num"),
    "string.contains": (lambda s, x: F.contains(_str(s), _str(x)), "bool"),
    "string.startsWith": (lambda s, x: F.startswith(_str(s), _str(x)), "bool"),
    "string.endsWith": (lambda s, x: F.endswith(_str(s), _str(x)), "bool"),
    "string.substring": (
        lambda s, a, b=None: F.substring(_str(s), _num(a).cast("int") + 1, (_num(b) - _num(a)).cast("int") if b else F.length(_str(s))),
        "str",
    ),
    "string.indexOf": (lambda s, x: F.instr(_str(s), _str(x)) - 1, "num"),
    "string.split": (lambda s, x: F.split(_str(s), _str(x)), "list"),
    "string.join": (lambda s, x: F.array_join(s[0], x[0]), "str"),
    "string.replace_all": (lambda s, a, b: F.regexp_replace(_str(s), _str(a), _str(b)), "str"),
    "reverse": (lambda *s: F.concat(*[F.reverse(_str(x)) for x in s]), "str"),
    **{f"math.{n}": (lambda x, f=getattr(F, n): f(_num(x)), "num") for n in ("abs", "sqrt", "log10", "sin", "cos", "tan")},
    "math.log": (lambda x: F.ln(_num(x)), "num"),
    "math.pow": (lambda x, y: F.pow(_num(x), _num(y)), "num"),
    "long": (lambda x: _num(x).cast("bigint"), "num"),
    "double": (lambda x: _num(x).cast("double"), "num"),
    "str": (lambda x: _str(x), "str"),
}


def register_function(name: str, f: Callable[..., Column], kind: str = "str") -> None:
    """Adds a function to the rule language; it gets (Column, kind) pairs."""
    if kind not in ("num", "str", "bool", "list"):
        raise ValueError(f"unknown kind {kind!r}")
    FUNCTIONS[name] = (f, kind)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "num"
    return "list" if isinstance(data_type, T.ArrayType) else "str"


def truthy(value: Column, kind: str) -> Column:
    """Null is false; numbers count above zero (fractions above 1e-6), text unless empty or ``null``."""
    if kind == "bool":
        test = value
    elif kind == "num":
        test = value > F.lit(1e-6)
    elif kind == "list":
        test = value.isNotNull()
    else:
        test = ~value.isin("", "null")
    return F.coalesce(test, F.lit(False))


def compile_rule(text: str, schema: T.StructType) -> tuple[Column, str]:
    """Column and kind of a rule over the fields of ``schema``, whose case does not matter.

    A text field that meets a number counts as the number it spells, or null.
    """
    known = {f.name.upper(): f for f in schema.fields}

    def build(tree) -> tuple[Column, str]:
        what = tree[0]
        if what == "lit":
            v = tree[1]
            return F.lit(v), "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "null" if v is None else "num"
        if what == "var":
            if tree[1].upper() not in known:
                raise RuleError(f"unknown field {tree[1]} in {text!r}")
            f = known[tree[1].upper()]
            return F.col(f"`{f.name}`"), kind_of(f.dataType)
        if what == "call":
            if tree[1] not in FUNCTIONS:
                raise RuleError(f"unknown function {tree[1]} in {text!r}")
            run, kind = FUNCTIONS[tree[1]]
            return run(*map(build, tree[2])), kind
        if what == "match":
            return F.rlike(_str(build(tree[1])), F.lit(f"^(?:{tree[2]})$")), "bool"
        if what == "not":
            return ~truthy(*build(tree[1])), "bool"
        if what == "neg":
            return -_num(build(tree[1])), "num"
        if what == "if":
            yes, no = build(tree[2]), build(tree[3])
            kind = yes[1] if yes[1] == no[1] or no[1] == "null" else no[1] if yes[1] == "null" else "str"
            cast = (lambda x: _str(x)) if kind == "str" else (lambda x: x[0])
            return F.when(truthy(*build(tree[1])), cast(yes)).otherwise(cast(no)), kind
        op, left, right = tree[1], build(tree[2]), build(tree[3])
        if op in ("&&", "||"):
            a, b = truthy(*left), truthy(*right)
            return (a & b) if op == "&&" else (a | b), "bool"
        if op in ("==", "!=") and "null" in (left[1], right[1]):
            other = right if left[1] == "null" else left
            test = other[0].isNull() if other[1] != "null" else F.lit(True)
            return test if op == "==" else ~test, "bool"
        if op == "+" and "str" in (left[1], right[1]) and not (left[1] == "num" or right[1] == "num"):
            return F.concat(_str(left), _str(right)), "str"
        numeric = "num" in (left[1], right[1]) or op in "+-*/%"
        a, b = (_num(left), _num(right)) if numeric else (left[0], right[0]) if left[1] == right[1] else (_str(left), _str(right))
        if op in ("/", "%"):
            b = F.when(b != 0, b)
        made = {
            "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b,
            ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[op]()
        return made, "num" if op in "+-*/%" else "bool"

    return build(_Parser(text).whole())


def drop_rows(df: DataFrame, rule: str | None) -> DataFrame:
    """Rows for which ``expr:...`` is true go; no rule keeps all."""
    if not rule or not rule.strip():
        return df
    if not rule.strip().startswith("expr:"):
        raise RuleError(f"a filter rule starts with expr: {rule!r}")
    return df.where(~truthy(*compile_rule(rule.strip()[5:], df.schema)))


def change_only(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before in their key; the first always stays."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    named = df.withColumns({"_before": F.lag(value).over(w), "_nth": F.row_number().over(w)})
    return named.where((F.col("_nth") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_nth")
