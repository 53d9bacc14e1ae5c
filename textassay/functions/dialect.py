"""Expressions that Spark SQL and DuckDB spell differently.

Queries are SQL text built once per dialect: Spark runs one rendering, the oracle the
other.  Every method returns the text of an expression.
"""

from __future__ import annotations


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Spark:
    name = "spark"
    #: Whether phrases come from one scan of each text (table `marked`) rather than one expression each.
    scans = False

    def lit(self, s: str) -> str:
        return "r" + quote(s) if "\\" in s and "'" not in s else quote(s)

    def contains(self, x, s):
        return f"contains({x}, {self.lit(s)})"

    def short_word(self, x, w):
        """Case-insensitive with ASCII letter boundaries on both sides."""
        return f"regexp_like({x}, {self.lit(f'(?i)(?<![A-Za-z]){w}(?![A-Za-z])')})"

    def rx(self, x, p):
        return f"regexp_like({x}, {self.lit(p)})"

    def rxcount(self, x, p):
        return f"regexp_count({x}, {self.lit(p)})"

    def rxreplace(self, x, p, to=""):
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(to)})"

    def without(self, x, chars):
        """x less the given characters."""
        return f"translate({x}, {quote(chars)}, '')"

    def trim(self, x, chars):
        """x less the given characters at both ends."""
        return f"trim(BOTH {quote(chars)} FROM {x})"

    def rxall(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def rxone(self, x, p, group=1):
        return f"nullif(regexp_extract({x}, {self.lit(p)}, {group}), '')"

    def split(self, x, s):
        return f"split({x}, {self.lit(s)})"

    def chars(self, x):
        return f"split({x}, '')"

    def size(self, a):
        return f"size({a})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def each(self, a, v, e):
        return f"transform({a}, {v} -> {e})"

    def only(self, a, v, e):
        return f"filter({a}, {v} -> {e})"

    def intersect(self, a, b):
        return f"array_intersect({a}, {b})"

    def union(self, a, b):
        return f"array_union({a}, {b})"

    def sort(self, a):
        return f"array_sort({a})"

    def join(self, a, s):
        return f"array_join({a}, {self.lit(s)})"

    def array(self, *e):
        return f"array({', '.join(e)})"

    def seq(self, a, b):
        """a..b, empty if b < a."""
        return f"(CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE slice(sequence(1, 1), 1, 0) END)"

    def at(self, a, i):
        """1-based."""
        return f"get({a}, CAST({i} AS INT) - 1)"

    def first_n(self, a, n):
        return f"slice({a}, 1, {n})"

    def collect(self, e, order):
        """Values of e in the order of `order` (a scalar)."""
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {e}))), s -> s.v)"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def host(self, u):
        return f"regexp_replace(lower(try_parse_url({u}, 'HOST')), '^www[.]', '')"

    def day(self, x):
        return f"date_add(DATE '2024-01-01', CAST({x} AS INT))"

    def days_between(self, a, b):
        """a - b in days."""
        return f"datediff({a}, {b})"

    def day_minus(self, x, n):
        return f"date_sub({x}, CAST({n} AS INT))"

    def month(self, x):
        return f"CAST(trunc({x}, 'month') AS DATE)"

    def to_int(self, x):
        return f"try_cast({x} AS INT)"

    def to_double(self, x):
        return f"try_cast({x} AS DOUBLE)"

    def json(self, x, path):
        return f"get_json_object({x}, {self.lit('$.' + path)})"

    def explode(self, columns, array, source):
        """Subquery with columns, i (1-based) and x.

        OUTER keeps Spark from inferring a filter that works the array out a second time.
        """
        return f"(SELECT {columns}, _i + 1 AS i, x FROM {source} LATERAL VIEW OUTER posexplode({array}) AS _i, x WHERE _i IS NOT NULL)"

    def rows(self, columns, rows):
        body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
        return f"(SELECT * FROM VALUES {body} AS _v({columns}))"

    def div(self, a, b):
        """Quotient of whole numbers, rounded towards zero."""
        return f"({a} DIV {b})"

    def percentile(self, x, p):
        return f"percentile({x}, {p})"

    def max_by(self, a, b):
        return f"max_by({a}, {b})"


class Duck(Spark):
    name = "duckdb"

    def lit(self, s):
        return quote(s)

    def short_word(self, x, w):
        return f"regexp_matches({x}, {self.lit(f'(?i)(^|[^A-Za-z]){w}($|[^A-Za-z])')})"

    def rx(self, x, p):
        return f"regexp_matches({x}, {self.lit(p)})"

    def rxcount(self, x, p):
        return f"len(regexp_extract_all({x}, {self.lit(p)}))"

    def rxreplace(self, x, p, to=""):
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(to)}, 'g')"

    def without(self, x, chars):
        return f"regexp_replace({x}, {quote(f'[{chars}]')}, '', 'g')"

    def trim(self, x, chars):
        return f"regexp_replace({x}, {quote(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"

    def rxall(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def split(self, x, s):
        return f"string_split_regex({x}, {self.lit(s)})"

    def chars(self, x):
        return f"string_split({x}, '')"

    def size(self, a):
        return f"len({a})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def each(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def only(self, a, v, e):
        return f"list_filter({a}, lambda {v}: {e})"

    def intersect(self, a, b):
        return f"list_intersect({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def sort(self, a):
        return f"list_sort({a})"

    def join(self, a, s):
        return f"array_to_string({a}, {self.lit(s)})"

    def array(self, *e):
        return f"[{', '.join(e)}]"

    def seq(self, a, b):
        return f"range({a}, {b} + 1)"

    def at(self, a, i):
        return f"list_extract({a}, {i})"

    def first_n(self, a, n):
        return f"list_slice({a}, 1, {n})"

    def collect(self, e, order):
        return f"list({e} ORDER BY {order})"

    def sha(self, x):
        return f"sha256({x})"

    def host(self, u):
        return f"regexp_replace(lower(nullif(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1), '')), '^www[.]', '')"

    def day(self, x):
        return f"CAST(DATE '2024-01-01' + CAST({x} AS INT) AS DATE)"

    def days_between(self, a, b):
        return f"CAST({a} - {b} AS INT)"

    def day_minus(self, x, n):
        return f"CAST({x} - CAST({n} AS INT) AS DATE)"

    def month(self, x):
        return f"CAST(date_trunc('month', {x}) AS DATE)"

    def json(self, x, path):
        return f"json_extract_string({x}, {self.lit('$.' + path)})"

    def explode(self, columns, array, source):
        return f"(SELECT {columns}, i, list_extract(_a, i) AS x FROM (SELECT *, unnest(range(1, len(_a) + 1)) AS i FROM (SELECT *, {array} AS _a FROM {source})))"

    def rows(self, columns, rows):
        body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
        return f"(SELECT * FROM (VALUES {body}) AS _v({columns}))"

    def div(self, a, b):
        return f"({a} // {b})"

    def percentile(self, x, p):
        return f"quantile_cont({x}, {p})"


class Scanned(Spark):
    scans = True


SPARK, SCANNED, DUCK = Spark(), Scanned(), Duck()
