"""SQL text for the two engines that run the same definitions: Spark, and DuckDB as the oracle."""

from __future__ import annotations

import re


class Spark:
    name = "spark"

    def s(self, text: str) -> str:
        """A string literal without escapes."""
        return f"r'{text}'"

    def match(self, e: str, p: str) -> str:
        return f"({e} rlike {self.s(p)})"

    def _to(self, r: str, shift: int = 0) -> str:
        return self.s(re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + shift}", r.replace("$", r"\$")))

    def sub(self, e: str, p: str, r: str) -> str:
        return f"regexp_replace({e}, {self.s(p)}, {self._to(r)})"

    def sub1(self, e: str, p: str, r: str) -> str:
        """Replaces the first match only."""
        flag = "(?i)" if p.startswith("(?i)") else ""
        return f"regexp_replace({e}, {self.s(r'(?s)' + flag + r'\A(.*?)(?:' + p[len(flag) :] + ')')}, concat('$1', {self._to(r, 1)}))"

    def find(self, e: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({e}, {self.s(p)}, {g})"

    def findall(self, e: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({e}, {self.s(p)}, {g})"

    def count(self, e: str, p: str) -> str:
        return f"cast(regexp_count({e}, {self.s(p)}) as bigint)"

    def split(self, e: str, p: str) -> str:
        return f"split({e}, {self.s(p)})"

    def filter(self, a: str, cond: str) -> str:
        return f"filter({a}, x -> {cond})"

    def map(self, a: str, e: str) -> str:
        return f"transform({a}, x -> {e})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {sep})"

    def distinct_sorted(self, a: str) -> str:
        return f"sort_array(array_distinct({a}))"

    def range(self, a: str, b: str) -> str:
        """Integers a..b-1; empty if b <= a."""
        return f"if({b} > {a}, sequence(cast({a} as int), cast({b} - 1 as int)), cast(array() as array<int>))"

    def slice(self, a: str, first: str, n: str) -> str:
        return f"slice({a}, {first}, {n})"

    def at(self, a: str, i: str) -> str:
        """Element i from 1, null beyond the end."""
        return f"try_element_at({a}, cast({i} as int))"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def concat_lists(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def explode(self, src: str, keep: str, a: str, pos: str, val: str) -> str:
        """select keep, position from 0, element."""
        return f"select {keep}, cast({pos} as bigint) as {pos}, {val} from (select {keep}, {a} as list_ from {src}) lateral view posexplode(list_) as {pos}, {val}"

    def let(self, name: str, value: str, body: str) -> str:
        """body with name bound to value, which is then computed once."""
        return f"transform(array({value}), {name} -> {body})[0]"

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def collect(self, v: str, order: str) -> str:
        return f"transform(sort_array(collect_list(struct({order} as o, {v} as v))), x -> x.v)"

    def agg_join(self, v: str, sep: str, order: str) -> str:
        return f"array_join({self.collect(v, order)}, {sep})"

    def first_by(self, v: str, order: str) -> str:
        return f"min_by({v}, {order})"

    def distinct_of(self, a: str) -> str:
        """Aggregate: how many distinct elements the lists have."""
        return f"cast(size(array_distinct(flatten(collect_list({a})))) as bigint)"

    def base36(self, e: str) -> str:
        return f"lower(conv(cast({e} as string), 10, 36))"

    def code(self, ch: str) -> str:
        return f"cast(ascii({ch}) as bigint)"

    def fold(self, a: str, start: str, step: str) -> str:
        """Left fold with acc and x."""
        return f"aggregate({a}, {start}, (acc, x) -> {step})"

    def chars(self, e: str) -> str:
        return f"filter(split({e}, ''), x -> x <> '')"

    def least_of(self, a: str) -> str:
        return f"array_min({a})"

    def sum_of(self, a: str) -> str:
        return f"aggregate({a}, cast(0 as double), (acc, x) -> acc + x)"


class Duck(Spark):
    name = "duck"

    def s(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def match(self, e: str, p: str) -> str:
        return f"regexp_matches({e}, {self.s(p)})"

    def sub(self, e: str, p: str, r: str) -> str:
        return f"regexp_replace({e}, {self.s(p)}, {self.s(r)}, 'g')"

    def sub1(self, e: str, p: str, r: str) -> str:
        return f"regexp_replace({e}, {self.s(p)}, {self.s(r)})"

    def count(self, e: str, p: str) -> str:
        return f"cast(len(regexp_extract_all({e}, {self.s(p)})) as bigint)"

    def split(self, e: str, p: str) -> str:
        return f"regexp_split_to_array({e}, {self.s(p)})"

    def filter(self, a: str, cond: str) -> str:
        return f"list_filter({a}, lambda x: {cond})"

    def map(self, a: str, e: str) -> str:
        return f"list_transform({a}, lambda x: {e})"

    def size(self, a: str) -> str:
        return f"cast(len({a}) as bigint)"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {sep})"

    def distinct_sorted(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def range(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint))"

    def slice(self, a: str, first: str, n: str) -> str:
        return f"({a})[{first}:({first}) + ({n}) - 1]"

    def at(self, a: str, i: str) -> str:
        return f"({a})[cast({i} as int)]"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def concat_lists(self, *a: str) -> str:
        out = a[0]
        for b in a[1:]:
            out = f"list_concat({out}, {b})"
        return out

    def explode(self, src: str, keep: str, a: str, pos: str, val: str) -> str:
        return f"select {keep}, unnest(range(len(list_))) as {pos}, unnest(list_) as {val} from (select {keep}, {a} as list_ from {src})"

    def let(self, name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def list(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def collect(self, v: str, order: str) -> str:
        return f"list({v} order by {order})"

    def agg_join(self, v: str, sep: str, order: str) -> str:
        return f"string_agg({v}, {sep} order by {order})"

    def first_by(self, v: str, order: str) -> str:
        return f"arg_min({v}, {order})"

    def distinct_of(self, a: str) -> str:
        return f"cast(len(list_distinct(flatten(list({a})))) as bigint)"

    def base36(self, e: str) -> str:
        return f"lower(to_base({e}, 36))"

    def code(self, ch: str) -> str:
        return f"cast(ascii({ch}) as bigint)"

    def fold(self, a: str, start: str, step: str) -> str:
        return f"list_reduce({a}, lambda acc, x: {step}, {start})"

    def chars(self, e: str) -> str:
        return f"list_filter(regexp_split_to_array({e}, ''), lambda x: x <> '')"

    def least_of(self, a: str) -> str:
        return f"list_min({a})"

    def sum_of(self, a: str) -> str:
        return f"coalesce(list_sum({a}), cast(0 as double))"


SPARK, DUCK = Spark(), Duck()
