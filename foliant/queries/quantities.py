"""Quantities of timing parameters in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import quantities as Q
from foliant.sources.tables import table

_CELLS = ("min_value", "max_value", "typical_value")


def _common(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.common_units(table(spark, folder, "timing_parameters"), "param_id", _CELLS, "unit", "name", "description")
    return rows.withColumnRenamed("record_id", "param_id").withColumnRenamed("kind", "quantity")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The quantities whose unit is written somewhere in the row."""
    return _common(spark, folder).filter("origin <> 'inferred'").select("param_id", "field", "quantity", "amount")


def p3_common_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every quantity in its common unit; where no unit is written, with the inferred one, its posterior and a flag."""
    return _common(spark, folder).withColumn("posterior", F.round("posterior", 6))


QUERIES = [p3_found, p3_common_units]

_UNIT = r"(?:(?:[x*] ?)?10 ?\^ ?([-+]?\d{1,2}) ?)?(" + "|".join(sorted(Q.UNITS, key=len, reverse=True)) + ")"
_OTHER = r"^[(\[]?(in )?[(\[]?(%|per ?cent|ui|unit intervals?|t?cycles?|clk|clocks?|clock cycles?|tck|tp?clk|lsb|ppm)[)\]]?$"
_FOOT = r"( *(\d{1,2}\)|\*+|[†‡§¶]+|\[[^\]]*\]|\( *(notes?\.? *)?[\d, ]+\)))+ *$"
_PARTS = r"^([^0-9]*?)([-+]?) *(\d[\d ,]*(?:\.\d[\d ]*)?|\.\d[\d ]*) ?(?:[x*] ?10 ?\^ ?([-+]?\d{1,2})|e([-+]?\d{1,2}))? *(.*)$"


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(translate(lower(coalesce({c}, '')), '−–—×·∙μµ', '---xxxuu'), '[\s\p{{Z}}]+', ' ', 'g'))"


def _found(c: str, pattern: str) -> str:
    """The power of ten of the unit that a text names, with 1000 added for hertz; null if it names none."""
    return f"(codes[regexp_extract({c}, '{pattern}', 2)] + coalesce(try_cast(nullif(regexp_extract({c}, '{pattern}', 1), '') AS INT), 0))"


_SQL = f"""
    WITH codes AS (SELECT map([{', '.join(f"'{u}'" for u in Q.UNITS)}], [{', '.join(str(e + 1000 * (k == 'frequency')) for k, e in Q.UNITS.values())}]) AS codes),
    r AS (SELECT DISTINCT param_id, min_value, max_value, typical_value, {_plain('unit')} AS u, {_plain('name')} AS n, {_plain('description')} AS d FROM timing_parameters),
    c AS ({' UNION ALL '.join(f"SELECT param_id, '{f}' AS field, {_plain(f)} AS cell, u, n, d FROM r" for f in _CELLS)}),
    p AS (SELECT *, regexp_extract(regexp_replace(cell, '{_FOOT}', ''), '{_PARTS}', ['before', 'sign', 'num', 'e1', 'e2', 'rest']) AS p FROM c),
    v AS (SELECT *, string_split(replace(p.num, ' ', ''), ',') AS bits, {_found('p.rest', '^' + _UNIT + r'[.]?$')} AS own FROM p, codes WHERE p.num <> '' AND NOT regexp_matches(p.before, 'note|see |fig|table|sect|page|ref')),
    w AS (SELECT *, bits[1] || coalesce(array_to_string(list_transform(bits[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{3}}([.]|$)') THEN x ELSE '.' || x END), ''), '') AS number,
        coalesce(own, {_found('u', r'^[(\[]?(?:in |unit:? )?[(\[]?' + _UNIT + r'[)\]]?[.]?$')}, {_found('n', r'(?:[(\[,/:;=]|\bin\b|\bunits?\b) ?' + _UNIT + r'(?:[^a-z0-9^]|$)')}, {_found('d', r'(?:[(\[,/:;=]|\bin\b|\bunits?\b) ?' + _UNIT + r'(?:[^a-z0-9^]|$)')}) AS code
        FROM v WHERE (own IS NOT NULL OR p.rest = '') AND (own IS NOT NULL OR NOT regexp_matches(u, '{_OTHER}'))),
    x AS (SELECT *, CAST(replace(number, '.', '') AS HUGEINT) AS digits, length(split_part(number, '.', 2)) AS decimals, code > 500 AS hertz FROM w WHERE code IS NOT NULL AND len(string_split(number, '.')) < 3),
    s AS (SELECT *, coalesce(try_cast(nullif(p.e1, '') AS INT), try_cast(nullif(p.e2, '') AS INT), 0) - decimals + CASE WHEN hertz THEN code - 1000 ELSE code + 12 END AS shift FROM x),
    a AS (SELECT *, CASE WHEN digits = 0 THEN 0 WHEN shift >= 0 THEN digits * CAST(pow(10, shift) AS HUGEINT) WHEN digits % CAST(pow(10, -shift) AS HUGEINT) = 0 THEN digits // CAST(pow(10, -shift) AS HUGEINT) END AS size FROM s)
    SELECT DISTINCT param_id, field, CASE WHEN hertz THEN 'frequency' ELSE 'time' END AS quantity, CAST(CASE WHEN p.sign = '-' THEN -size ELSE size END AS BIGINT) AS amount FROM a WHERE size IS NOT NULL"""

SQL = {"p3_found": _SQL}
