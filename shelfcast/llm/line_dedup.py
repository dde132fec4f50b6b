"""Repeated lines by overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.tables import stored
from shelfcast.llm.text import unused


def _lines(text: Column) -> Column:
    """The lines of a text; none of a null or empty one."""
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def covered_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """(doc_id, text_hash, covered): for each text with later occurrences, the numbers of its lines that they cover.

    Two hashes of the lines' hashes, 128 bits together, stand for a window. A window that a passage puts into
    very many texts is counted before it is shuffled; the join that finds its occurrences is one that
    adaptive execution splits.
    """
    h, g = "xxhash64(x)", "xxhash64(x, length(x))"
    pick = ", ".join(f"get(%s, i + {k})" for k in range(window))
    filled = " OR ".join(f"get(blank, i + {k}) = false" for k in range(window))
    hashed = docs.select("doc_id", F.expr("xxhash64(coalesce(text, ''))").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    hashed = hashed.select("doc_id", "text_hash", F.expr(f"transform(lines, x -> {h})").alias("h"), F.expr(f"transform(lines, x -> {g})").alias("g"), F.expr("transform(lines, x -> trim(x) = '')").alias("blank"))
    spans = f"CASE WHEN size(h) >= {window} THEN transform(sequence(0, size(h) - {window}), i -> struct(i AS place, xxhash64({pick.replace('%s', 'h')}) AS a, xxhash64({pick.replace('%s', 'g')}) AS b, {filled} AS filled)) END"
    # The outer form: the other one puts a filter below, which builds all windows a second time.
    windows = hashed.select("doc_id", "text_hash", F.explode_outer(F.expr(spans)).alias("w")).where("w.filled").select("doc_id", "text_hash", "w.place", "w.a", "w.b")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(first, ["a", "b"]).where("NOT (doc_id <=> first.doc_id AND text_hash = first.text_hash AND place = first.place)")
    merged = F.array_distinct(F.flatten(F.transform(F.collect_set("place"), lambda p: F.sequence(p, p + F.lit(window - 1)))))
    return later.groupBy("doc_id", "text_hash").agg(merged.alias("covered"))


def dedup_lines(docs: DataFrame, window: int = 3, counts: bool = True) -> DataFrame:
    """docs with its texts freed of repeated lines, and on request two more columns: n_lines and n_removed.

    A window of three consecutive lines that also begins earlier, in a text with a smaller doc_id or further up
    in the same text, is a later occurrence, and all lines that later occurrences cover are removed. Windows are
    compared as they stand in the input. Windows whose lines are all blank don't count. A null or empty text has
    no lines and stays; a text of fewer than three lines stays; a text may become empty. A null doc_id is before
    all others; of texts that share a doc_id or have none, the one with the smaller hash is earlier. Rows equal in
    doc_id and text are one text: they get equal results, and their copies of one another stay. An empty table stays empty. All columns are kept, but
    n_lines and n_removed, when asked for, replace columns of these names.
    """
    of_doc, of_text, covered, text_hash = unused(docs.columns, "of_doc", "of_text", "covered", "text_hash")
    found, _ = stored(covered_lines(docs, window), "covered-lines")
    found = found.select(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_text), F.col("covered").alias(covered))
    marked = docs.withColumn(text_hash, F.expr("xxhash64(coalesce(text, ''))"))
    # The same join at every size.
    joined = marked.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(text_hash) == F.col(of_text)), "left")
    lines = _lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered)), lambda i: F.get(lines, i))
    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    more = [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in names), *more)


SQL = """
WITH texts AS (SELECT doc_id, text, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS lines FROM documents),
windows AS (
  SELECT doc_id, i - 1 AS place, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM texts)
  WHERE trim(lines[i]) <> '' OR trim(lines[i + 1]) <> '' OR trim(lines[i + 2]) <> ''),
ranked AS (SELECT doc_id, place, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS turn FROM windows),
covered AS (SELECT DISTINCT doc_id, place + k AS line FROM ranked, range(3) AS r(k) WHERE turn > 1),
removed AS (SELECT doc_id, list(line) AS lines, count(*) AS n FROM covered GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.lines) AS BIGINT) AS n_lines, coalesce(r.n, 0) AS n_removed,
  CASE WHEN r.n IS NULL THEN t.text
       ELSE array_to_string(list_filter(t.lines, lambda x, i: NOT list_contains(r.lines, i - 1)), chr(10)) END AS text
FROM texts t LEFT JOIN removed r ON t.doc_id = r.doc_id
"""
