"""What the queries share: reading tables, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.functions import text as T
from textloom.session import ship

#: The same class of spaces as in textloom.functions.text, in the SQL engine's notation.
S = r"[\s\p{Z}\x0b\x1c-\x1f\x{0085}]"
W = r"[\p{L}\p{N}_]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_tokens(col: str, stopwords: list[str] = T.STOPWORDS_LONG) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '{W}'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(stopwords)}, w))"


def sql_runs(words: str, k: int, short: str = "whole") -> str:
    less = f"[array_to_string({words}, ' ')]" if short == "whole" else f"list_distinct({words})"
    many = f"list_distinct(list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i : i + {k - 1}], ' ')))"
    return f"CASE WHEN len({words}) = 0 THEN CAST([] AS VARCHAR[]) WHEN len({words}) < {k} THEN {less} ELSE {many} END"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{S}+|{S}+$', '', 'g')"


def sql_words(col: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({col}, ''), '{S}+'), lambda w: w <> '')"


def sql_title(col: str) -> str:
    t = f"regexp_replace({col}, '(?i)\\|[a-z]*{T.SUFFIX}[a-z]*', '', 'g')"
    t = f"regexp_replace({t}, '^{S}*[0-9]+\\.{S}*', '')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9\\x{{00c0}}-\\x{{017f}}\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{0085}}]', ' ', 'g')"
    return f"lower(trim(regexp_replace({t}, '{S}+', ' ', 'g')))"


def sql_display(col: str, one_line: bool = False) -> str:
    t = f"regexp_replace({col}, '(?i){S}*\\|{S}*[a-z]*{T.SUFFIX}[a-z]*', '', 'g')"
    t = f"regexp_replace({t}, '^{S}*[0-9]+\\.{S}+', '')"
    if one_line:
        t = f"regexp_replace(regexp_replace({t}, '{S}+', ' ', 'g'), '\\\\\\.', '.', 'g')"
    return sql_strip(t)


def sql_name(col: str, joint: str, most: int) -> str:
    s = f"regexp_replace({col}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{0085}}-]', '', 'g')"
    return f"substring(regexp_replace({sql_strip(s)}, '{S}+', '{joint}', 'g'), 1, {most})"
