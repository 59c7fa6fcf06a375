"""Operators as SQL over named inputs, so that one text runs on Spark and, as a comparison, on any SQL engine.

A text may use a few marks for what dialects spell differently:
RLIKE(a, b)            a matches the pattern b
@G                     the flag of regexp_replace for "all matches"
UNNEST{v|keep|array}   v's rows once per element of array, with pos (from 0) and tok beside the kept columns
JSON(a, k)             the member k of the JSON text a, as text
SECONDS(a)             seconds of a timestamp since 1970
SHA(a)                 SHA-256 in hex; a is a column
AGG{a|sep|order}       texts a of a group joined by sep, ordered by order
COUNT⟦array¦x¦test⟧    how many elements x of an array pass the test
MAP⟦array¦x¦value⟧     the array of the values of its elements x
SERIES(n)              the array of 0 to n - 1; n is a column
SPLITRE(a, b)          a cut at what the pattern b finds
BTRIM(a, b)            a without the characters of b at its ends
TRIPLE(a)              a holds a letter or digit three times in a row
JOINED⟦array¦sep⟧      the texts of an array joined by sep, a literal
LAST⟦array⟧            the last element of an array, null of an empty one
KEEP⟦array¦x¦test⟧     the elements x of an array that pass the test

Backslashes are written as the pattern has them.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_TABLE = re.compile(r"(?:(?:\bFROM|\bJOIN)\s+(?!UNNEST\{)|UNNEST\{)([A-Za-z_][A-Za-z_0-9]*)")
_LITERAL = re.compile(r"'[^']*'")
_UNNEST = re.compile(r"UNNEST\{([^|]*)\|([^|]*)\|((?:[^{}]|\{[^{}]*\})*)\}")
_JSON = re.compile(r"JSON\(([^,()]+), (\w+)\)")
_AGG = re.compile(r"AGG\{([^|]*)\|([^|]*)\|([^}]*)\}")
_COUNT = re.compile(r"COUNT⟦([^¦⟧]*)¦([^¦⟧]*)¦([^⟦⟧]*)⟧")
_MAP = re.compile(r"MAP⟦([^¦⟧]*)¦([^¦⟧]*)¦([^⟦⟧]*)⟧")
_TRIPLE = re.compile(r"TRIPLE\((\w+)\)")
_KEEP = re.compile(r"KEEP⟦([^¦⟧]*)¦([^¦⟧]*)¦([^⟦⟧]*)⟧")
_JOINED = re.compile(r"JOINED⟦([^¦⟦⟧]*)¦([^¦⟦⟧]*)⟧")
_LAST = re.compile(r"LAST⟦([^⟦⟧]*)⟧")
_SERIES = re.compile(r"SERIES\((\w+)\)")
_SECONDS = re.compile(r"SECONDS\(([^()]+)\)")


def spark_text(sql: str) -> str:
    sql = _UNNEST.sub(lambda m: f"(SELECT {m[2]}, x_.pos, x_.tok FROM {m[1]} LATERAL VIEW posexplode({m[3]}) x_ AS pos, tok)", sql)
    sql = _AGG.sub(r"listagg(\1, '\2') WITHIN GROUP (ORDER BY \3)", sql)
    sql = _JSON.sub(r"get_json_object(\1, '$.\2')", sql)
    sql = _SECONDS.sub(r"unix_seconds(CAST(\1 AS TIMESTAMP))", sql)
    sql = re.sub(r"SHA\((\w+)\)", r"sha2(\1, 256)", sql)
    sql = _SERIES.sub(r"filter(sequence(0, CAST(\1 AS INT)), x_ -> x_ < \1)", sql)
    sql = _MAP.sub(r"transform(\1, \2 -> \3)", sql)
    sql = _TRIPLE.sub(r"RLIKE(\1, '([a-z0-9])\\1\\1')", sql)
    sql = _KEEP.sub(r"filter(\1, \2 -> \3)", sql)
    sql = _JOINED.sub(r"array_join(\1, \2)", sql)
    sql = _LAST.sub(r"try_element_at(\1, -1)", sql)
    sql = _COUNT.sub(r"CAST(size(filter(\1, \2 -> \3)) AS BIGINT)", sql)
    return sql.replace("BTRIM(", "btrim(").replace("SPLITRE(", "split(").replace("RLIKE(", "regexp_like(").replace("@G", "").replace("\\", "\\\\")


def _counted(sql: str) -> str:
    """count_if as a 64-bit integer, which other engines may widen."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], "CAST(", sql[start:end], " AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


def other_text(sql: str) -> str:
    sql = _UNNEST.sub(lambda m: f"(SELECT {m[2]}, CAST(generate_subscripts(arr_, 1) - 1 AS INTEGER) AS pos, unnest(arr_) AS tok FROM (SELECT *, {m[3]} AS arr_ FROM {m[1]}))", sql)
    sql = _AGG.sub(r"string_agg(\1, '\2' ORDER BY \3)", sql)
    sql = _JSON.sub(r"json_extract_string(\1, '$.\2')", sql)
    sql = _SECONDS.sub(r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    sql = _SERIES.sub(r"range(CAST(\1 AS BIGINT))", sql)
    sql = _MAP.sub(r"list_transform(\1, lambda \2: \3)", sql)
    # without back references the characters are spelled out
    sql = _TRIPLE.sub(lambda m: f"RLIKE({m[1]}, '{'|'.join(c * 3 for c in 'abcdefghijklmnopqrstuvwxyz0123456789')}')", sql)
    sql = _KEEP.sub(r"list_filter(\1, lambda \2: \3)", sql)
    sql = _JOINED.sub(r"array_to_string(\1, \2)", sql)
    sql = _LAST.sub(r"list_extract(\1, -1)", sql)
    sql = _COUNT.sub(r"CAST(len(list_filter(\1, lambda \2: \3)) AS BIGINT)", sql)
    sql = _counted(sql)
    return sql.replace("BTRIM(", "trim(").replace("SPLITRE(", "regexp_split_to_array(").replace("RLIKE(", "regexp_matches(").replace("@G", ", 'g'").replace("SHA(", "sha256(")


@dataclass(frozen=True)
class View:
    """A named query; what its text reads by FROM, JOIN or UNNEST is its inputs."""

    name: str
    sql: str


def closure(sql: str, views: dict[str, View], given: frozenset[str] = frozenset()) -> list[View]:
    """The views that sql needs, each after those that it needs itself, without those that are given."""
    found: dict[str, View] = {}

    def visit(text: str) -> None:
        for word in _TABLE.findall(_LITERAL.sub(" ", text)):
            if word in views and word not in found and word not in given:
                visit(views[word].sql)
                found[word] = views[word]

    visit(sql)
    return list(found.values())


def complete(sql: str, views: dict[str, View], given: frozenset[str] = frozenset()) -> str:
    parts = [f"{v.name} AS (\n{v.sql.strip()})" for v in closure(sql, views, given)]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def run(spark: SparkSession, sql: str, views: dict[str, View], inputs: dict[str, DataFrame]) -> DataFrame:
    """sql over inputs; what it needs beyond them comes from views."""
    text = spark_text(complete(sql, views, frozenset(inputs)))
    names = {n: f"{n}_{uuid.uuid4().hex[:12]}" for n in inputs if re.search(rf"\b{n}\b", text)}
    for name, own in names.items():
        inputs[name].createOrReplaceTempView(own)
    # an input's name is bound to its view by a common table expression, so views of the session are left alone
    bound = ", ".join(f"{name} AS (SELECT * FROM {own})" for name, own in names.items())
    if bound:
        text = f"WITH {bound}, {text[5:]}" if text.startswith("WITH ") else f"WITH {bound} {text}"
    try:
        return spark.sql(text)
    finally:
        for own in names.values():
            spark.catalog.dropTempView(own)


def tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    words = set(_WORD.findall(_LITERAL.sub(" ", text)))
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if t in words}
