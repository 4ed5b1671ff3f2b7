"""Scripts of store commands as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands by the arguments they need; EXIT and QUIT end a session.
COMMANDS = ("PUT", "GET", "DELETE", "FLUSH", "COMPACT", "STATS", "HELP", "EXIT", "QUIT")
_BLANK = " \t\r\n"


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, command, k, v, status) of each line (line_no, line): commands in any case, the key as the first word
    after it, the value as the trimmed rest. Status is OK, EMPTY, USAGE (an argument lacks) or UNKNOWN."""
    line = F.btrim(F.coalesce("line", F.lit("")), F.lit(_BLANK))
    command = F.upper(F.regexp_extract("__line", r"^([^ \t\r\n]*)", 1))
    rest = F.btrim(F.regexp_extract("__line", r"^[^ \t\r\n]*([\s\S]*)$", 1), F.lit(_BLANK))
    key = F.regexp_extract("__rest", r"^([^ \t\r\n]*)", 1)
    value = F.btrim(F.regexp_extract("__rest", r"^[^ \t\r\n]*([\s\S]*)$", 1), F.lit(_BLANK))
    parsed = lines.withColumn("__line", line).withColumns({"command": command, "__rest": rest}).withColumns({"k": key, "v": value})
    lacks = (F.col("command").isin("PUT", "GET", "DELETE") & (F.col("k") == "")) | ((F.col("command") == "PUT") & (F.col("v") == ""))
    status = F.when(F.col("command") == "", "EMPTY").when(~F.col("command").isin(*COMMANDS), "UNKNOWN").when(lacks, "USAGE").otherwise("OK")
    keyed = F.col("command").isin("PUT", "GET", "DELETE")
    return parsed.select("line_no", "command", F.when(keyed, F.col("k")).otherwise("").alias("k"), F.when(F.col("command") == "PUT", F.col("v")).otherwise("").alias("v"), status.alias("status"))
