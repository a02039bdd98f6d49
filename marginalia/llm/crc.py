"""CRC-32 of a decimal number, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One row, ``t``: the 256 remainders of a byte, from the reversed polynomial of the standard CRC.
CRC_TABLE_SQL = """crc_rule AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n)))"""


def crc_of(number: Column) -> Column:
    """Unsigned CRC-32 of the number written in decimal; null stays null."""
    return F.crc32(number.cast("string").cast("binary"))


def crc_sql(number: str) -> str:
    """The same as an expression over a row that also holds ``t`` of CRC_TABLE_SQL."""
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {digits}), lambda c, b: xor(t[((xor(c, b)) & 255) + 1], c >> 8)))"
