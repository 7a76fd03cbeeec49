"""SQL text of plans. Operators are written once against a dialect; SPARK is what runs, DUCK is the same query for checks.

Only spelling differs between the two: lambdas, arrays, structs and a few function names.
"""

from __future__ import annotations

import functools
import re
import zlib


class Dialect:
    def __init__(self, spark: bool, names: dict[str, str] | None = None):
        self.spark, self.names, self.steps, self.cuts = spark, names or {}, {}, set()

    def step(self, name: str, make, cut: bool = False) -> str:
        """A query over a named intermediate relation; `make` gives its SQL the first time it is asked for.

        With `cut` it is written out once: long chains of arithmetic would otherwise be inlined into each other. For Spark `make`
        may give (relation, function of pandas groups by capture_id, schema) instead of SQL.
        """
        if name not in self.steps:
            sql = make()
            self.steps[name] = sql
            if cut:
                self.cuts.add(name)
        return f"SELECT * FROM {self.names.get('', '')}{name}"

    def t(self, table: str) -> str:
        """A base table."""
        return self.names.get(table, table)

    def fn(self, v: str, body: str) -> str:
        return f"{v} -> {body}" if self.spark else f"lambda {v}: {body}"

    def map(self, a: str, v: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({a}, {self.fn(v, body)})"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({a}, {self.fn(v, body)})"

    def any(self, a: str, v: str, body: str) -> str:
        return f"exists({a}, {self.fn(v, body)})" if self.spark else f"(len(list_filter({a}, lambda {v}: {body})) > 0)"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def has(self, a: str, x: str) -> str:
        return f"{'array_contains' if self.spark else 'list_contains'}({a}, {x})"

    def append(self, a: str, x: str) -> str:
        return f"{'array_append' if self.spark else 'list_append'}({a}, {x})"

    def get(self, a: str, i: str | int) -> str:
        """Element i (from 1) or null."""
        return f"get({a}, ({i}) - 1)" if self.spark else f"({a})[{i}]"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})" if self.spark else f"[{', '.join(x)}]"

    def none(self, kind: str) -> str:
        return f"cast(array() AS array<{kind}>)" if self.spark else f"CAST([] AS {kind}[])"

    def struct(self, **x: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")" if self.spark else "{" + ", ".join(f"'{k}': {v}" for k, v in x.items()) + "}"

    def gather(self, x: str) -> str:
        """All values of a group, sorted."""
        return f"array_sort(collect_list({x}))" if self.spark else f"list_sort(list({x}))"

    def top(self, a: str) -> str:
        """The largest element or null."""
        return f"array_max({a})" if self.spark else f"list_sort({a}, 'DESC')[1]"

    def sort(self, a: str) -> str:
        return f"array_sort({a})" if self.spark else f"list_sort({a})"

    def uniq(self, a: str) -> str:
        return f"array_distinct({a})" if self.spark else f"list_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"{'array_intersect' if self.spark else 'list_intersect'}({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')" if self.spark else f"array_to_string({a}, '{sep}')"

    def slice(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})" if self.spark else f"({a})[1:{n}]"

    def slice_to(self, a: str, n: str) -> str:
        return f"slice({a}, 1, {n})" if self.spark else f"({a})[1:{n}]"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0.0D, (s, v) -> s + v)" if self.spark else f"coalesce(list_sum({a}), 0.0)"

    def fold(self, a: str, start: str, acc: str, x: str, body: str) -> str:
        """Left fold; in the second dialect accumulator and elements have one type."""
        return f"aggregate({a}, {start}, ({acc}, {x}) -> {body})" if self.spark else f"list_reduce({a}, lambda {acc}, {x}: {body}, {start})"

    def range(self, a: str, b: str) -> str:
        """Whole numbers a to b, none if b < a."""
        return f"(CASE WHEN {b} < {a} THEN cast(array() AS array<int>) ELSE sequence(cast({a} AS int), cast({b} AS int)) END)" if self.spark else f"range(CAST({a} AS INTEGER), CAST({b} AS INTEGER) + 1)"

    def explode(self, a: str, name: str) -> str:
        return f"explode({a}) AS {name}" if self.spark else f"unnest({a}) AS {name}"

    def rx(self, s: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(p)}, {g})"

    def rx_all(self, s: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(p)}, {g})"

    def rx_sub(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, {self.lit(p)}, '{r}')" if self.spark else f"regexp_replace({s}, {self.lit(p)}, '{r}', 'g')"

    def like(self, s: str, p: str) -> str:
        return f"({s} RLIKE {self.lit(p)})" if self.spark else f"regexp_matches({s}, {self.lit(p)})"

    def lit(self, p: str) -> str:
        """A string literal that keeps backslashes."""
        p = p.replace("'", "''")
        return "r'" + p.replace("''", "\\'") + "'" if self.spark and "'" not in p else "'" + (p.replace("\\", "\\\\").replace("''", "\\'") if self.spark else p) + "'"

    def split(self, s: str, p: str) -> str:
        return f"split({s}, {self.lit(p)})" if self.spark else f"regexp_split_to_array({s}, {self.lit(p)})"

    def num(self, s: str) -> str:
        return f"try_cast({s} AS double)"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)" if self.spark else f"sha256({s})"

    def round_half_up(self, x: str, scale: int = 0) -> str:
        """Rounds halves towards positive infinity."""
        k = 10**scale
        return f"floor({x} + 0.5)" if not scale else f"floor(({x}) * {k} + 0.5) / {k}.0"


def step(plan=None, *, cut: bool = False):
    """A plan whose result other plans use by name."""
    if plan is None:
        return functools.partial(step, cut=cut)

    @functools.wraps(plan)
    def named(d: Dialect) -> str:
        return d.step(plan.__name__, lambda: plan(d), cut)

    return named


def layered(d: Dialect, source: str, layers: list[dict[str, str]]) -> str:
    """Named expressions on top of a query, each layer seeing the ones below."""
    sql = source
    for k, layer in enumerate(layers):
        inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({sql}) s"
        sql = d.step(f"layer_{zlib.crc32(inner.encode()):08x}", lambda inner=inner: inner, k % 3 == 2 or k + 1 == len(layers))
    return sql


def doubles(sql: str) -> str:
    """Decimal literals as doubles, outside of strings: both engines then compute in double precision."""
    parts = re.split(r"('(?:[^'\\\\]|\\\\.|'')*')", sql)
    return "".join(p if k % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for k, p in enumerate(parts))


def check_sql(plan) -> str:
    """The plan as one statement of the second dialect."""
    d = Dialect(False)
    last = plan(d)
    return doubles("WITH " + ", ".join(f"{k} AS ({v})" for k, v in d.steps.items()) + " " + last if d.steps else last)
