"""Where symbols of brace languages end, and what they lie in: by running sums of brackets over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text

#: Strings and comments of a line without its escapes, whose brackets do not count; fixed values of brace languages.
ESCAPE, NOT_CODE = r"\\.", r"\"[^\"]*+\"|'[^']*+'|`[^`]*+`|//.*$|/\*.*?\*/"


def bracket_lines(files: DataFrame) -> DataFrame:
    """(path, line, before, low, after, opens) of every line: the depth before it, the least after its leading closings, and after it."""
    rows = files.select("path", F.posexplode(text.lines(F.coalesce("text", F.lit("")))).alias("at", "value"))
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", ESCAPE, ""), NOT_CODE, ""), r"[^{}]", "")
    rows = rows.select("path", (F.col("at") + 1).alias("line"), marks.alias("marks"))
    opens = F.length(F.translate("marks", "}", ""))
    closes = F.length(F.translate("marks", "{", ""))
    leading = F.length("marks") - F.length(F.ltrim(F.col("marks"), F.lit("}")))
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.select("path", "line", opens.alias("opens"), closes.alias("closes"), leading.alias("leading"))
    before = F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(above), F.lit(0))
    depth = counted.withColumn("before", before).withColumn("after", F.col("before") + F.col("opens") - F.col("closes"))
    return depth.select("path", "line", "before", (F.col("before") - F.col("leading")).alias("low"), "after", "opens")


def brace_extents(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Add last_line and owner (the name of the innermost symbol around it) to symbols (path, name, start_line and any others).

    A symbol's body opens with the first bracket from its line on, if no other
    symbol starts before; it ends with the first later line that comes down to
    the depth at which the symbol stands, or with the file. One without a body is
    its own line. Lines are compared within their file only, by windows: no
    symbol meets all lines. Symbols of equal path and line share their extent.
    """
    lines = bracket_lines(files)
    starts = symbols.select("path", F.col("start_line").alias("line"), F.lit(True).alias("starts")).distinct()
    placed = lines.join(starts, ["path", "line"], "left")
    # From the last line up, so that what comes after a line is what has been seen.
    upwards = Window.partitionBy("path").orderBy(F.desc("line"))
    on, later = upwards.rowsBetween(Window.unboundedPreceding, 0), upwards.rowsBetween(Window.unboundedPreceding, -1)
    body = F.last(F.when(F.col("opens") > 0, F.struct("line", "after")), ignorenulls=True)
    seen = placed.select(
        "path", "line", "starts", F.col("low").alias("level"), body.over(on).alias("body"), F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(later).alias("next"), F.max("line").over(on).alias("end")
    ).where("starts")
    has = F.col("body").isNotNull() & (F.col("next").isNull() | (F.col("body.line") < F.col("next")))
    here = F.when(~has, F.col("line")).when(F.col("body.after") <= F.col("level"), F.col("body.line"))
    seen = seen.select("path", "line", "level", F.coalesce(F.col("body.line"), F.col("line")).alias("at"), here.alias("here"), "end")
    # The lines that come down to a level, one row for each level that they close.
    least = F.least("low", "after")
    closings = lines.where(least < F.col("before")).select("path", F.explode(F.sequence(least, F.col("before") - 1)).alias("level"), F.col("line").alias("at"), F.lit(1).alias("closes"))
    events = seen.select("path", "level", "at", F.lit(0).alias("closes"), "line", "here", "end").unionByName(closings, allowMissingColumns=True)
    down = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.desc("closes")).rowsBetween(Window.unboundedPreceding, -1)
    closed = events.withColumn("down", F.last(F.when(F.col("closes") == 1, F.col("at")), ignorenulls=True).over(down)).where("closes = 0")
    extents = closed.select("path", "line", "level", F.coalesce("here", "down", "end").alias("last_line"))
    known = symbols.join(extents.withColumnRenamed("line", "start_line"), ["path", "start_line"])
    # The innermost symbol around: of the last one before it at each lower level, the deepest that has not ended.
    deepest = known.agg(F.max("level")).first()[0] or 0
    above = Window.partitionBy("path").orderBy("start_line").rangeBetween(Window.unboundedPreceding, -1)
    around = [F.last(F.when(F.col("level") == k, F.struct("last_line", "name")), ignorenulls=True).over(above) for k in range(deepest)]
    owned = known.select("*", *(a.alias(f"__{k}") for k, a in enumerate(around)))
    owner = F.coalesce(*(F.when((F.col("level") > k) & (F.col(f"__{k}.last_line") >= F.col("start_line")), F.col(f"__{k}.name")) for k in reversed(range(deepest))), F.lit(None).cast("string"))
    return owned.select(*symbols.columns, "last_line", owner.alias("owner"))


def bodies(extents: DataFrame, files: DataFrame) -> DataFrame:
    """Add the body of each symbol, its lines from the first to the last."""
    found = extents.join(files.select("path", "text"), "path")
    return found.withColumn("body", text.line_slice(F.col("text"), F.col("start_line"), F.col("last_line"))).drop("text")
