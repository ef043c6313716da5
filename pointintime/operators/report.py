"""Table rows out of report articles: headings are carried forward to the lines below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_player_line, day_heading, group_label, looks_like_injury_report, normalise_participation, player_line, split_detail, strip, team_heading
from ..vocabulary import GAME_STATUSES, REPORT_COLUMNS


def report_lines(documents: DataFrame) -> DataFrame:
    """document_id, line_no, line of the lines that aren't blank."""
    lines = F.posexplode(F.split("text", "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"))
    return documents.select("document_id", lines.alias("line_no", "raw")).withColumn("line", strip(F.col("raw"))).where("line <> ''").drop("raw")


def report_rows(documents: DataFrame) -> DataFrame:
    """document_id, line_no, team, day, position, player, injury, participation, game_status.

    Precedence of a line: day, group, player, team. A line that has the shape of a player without a detail counts as
    one only below a group label; it never changes the group, so groups are carried first, then such
    lines are told, then teams are carried.
    """
    line = F.col("line")
    c = report_lines(documents).select("document_id", "line_no", line, day_heading(line).alias("d"), group_label(line).alias("g"), player_line(line).alias("p"), bare_player_line(line).alias("b"), team_heading(line).alias("t"))
    is_group = F.col("d").isNull() & F.col("g").isNotNull()
    is_player = F.col("d").isNull() & F.col("g").isNull() & F.col("p").isNotNull()
    plain_team = F.col("d").isNull() & F.col("g").isNull() & F.col("p").isNull() & F.col("b").isNull() & F.col("t").isNotNull()
    upper = F.upper("g")
    status = F.when(upper.isin(*GAME_STATUSES), upper)
    state = F.when(is_group, F.struct(status.alias("status"), F.when(status.isNull(), normalise_participation(F.col("g"))).alias("part"))).when(F.col("d").isNotNull() | plain_team, F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("part")))
    above = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("state", F.last(state, ignorenulls=True).over(above))
    grouped = F.col("state.status").isNotNull() | F.col("state.part").isNotNull()
    bare = F.col("d").isNull() & F.col("g").isNull() & F.col("p").isNull() & F.col("b").isNotNull() & F.coalesce(grouped, F.lit(False))
    team = F.when(plain_team | (F.col("d").isNull() & F.col("g").isNull() & F.col("p").isNull() & F.col("b").isNotNull() & ~bare), F.col("t"))
    c = c.withColumn("bare", bare).withColumn("team", F.last(team, ignorenulls=True).over(above)).withColumn("day", F.last("d", ignorenulls=True).over(above))
    parts = split_detail(F.col("p.detail"))
    rows = c.where(is_player | F.col("bare")).withColumn("parts", F.when(is_player, parts))
    return rows.select("document_id", "line_no", "team", "day", F.coalesce("p.position", "b.position").alias("position"), F.coalesce("p.player", "b.player").alias("player"), "parts.injury", F.coalesce("parts.participation", "state.part").alias("participation"), F.col("state.status").alias("game_status"))


def report_tables(documents: DataFrame) -> DataFrame:
    """document_id and tables: one table with a header of seven columns, for documents that look like a report."""
    rows = report_rows(documents.where(looks_like_injury_report(F.col("text"))))
    cells = F.array(*(F.coalesce(c, F.lit("")) for c in ("team", "day", "position", "player", "injury", "participation", "game_status")))
    nested = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", cells.alias("cells")))), lambda x: x["cells"]).alias("body"))
    header = F.array(F.array(*map(F.lit, REPORT_COLUMNS)))
    return nested.select("document_id", F.array(F.struct(F.lit(0).alias("index"), F.concat(header, "body").alias("rows"), F.lit("prose").alias("derived"))).alias("tables"))


def heading_audit(rows: DataFrame) -> DataFrame:
    """Per document: rows, rows without a team, distinct teams."""
    return rows.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("team").isNull()).alias("teamless"), F.count_distinct("team").alias("teams"))
