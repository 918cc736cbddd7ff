"""Repeated runs of three lines, removed with DataFrame expressions only.

Every three consecutive lines of a document form a window. Windows meet by a
128-bit hash of their lines; the first occurrence is found with a minimum that
is combined before the shuffle, so a window of any frequency sends one row per
task. Later occurrences go back to their documents, where the covered positions
are merged and cut out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) of every row of ``docs(doc_id, text)``.

    Lines are cut at ``\\n``; a line without a character outside ASCII white space
    is blank. A window is ``lines`` consecutive lines that are not blank, blank
    ones between them passed over. A window whose line sequence also starts
    earlier (in a document with a smaller doc_id, or earlier in the same one)
    removes everything from its first to its last line. Windows are judged on
    the input.

    Defined cases: a null text has no lines and a null kept_text; an empty text
    has one blank line; fewer than ``lines`` lines lose nothing; texts of any
    length are used whole; rows that repeat a doc_id with the same text get the
    same answer and don't count as copies of each other; a null doc_id is
    compared with nothing and loses nothing; other columns are ignored; an empty
    table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda line: line["x"].rlike(r"[^\x20\x09-\x0D]"),
    )
    numbered = texts.where("doc_id is not null and text is not null").select("doc_id", full.alias("full"))

    def window(k):
        own = [F.get("full", k + j) for j in range(lines)]
        return F.struct(
            own[0]["i"].alias("a"),
            own[-1]["i"].alias("b"),
            F.xxhash64(*[x["x"] for x in own]).alias("h1"),
            F.xxhash64(F.lit("second"), *[x["x"] for x in reversed(own)]).alias("h2"),
        )

    starts = F.when(F.size("full") >= lines, F.sequence(F.lit(0), F.size("full") - lines))
    windows = numbered.select("doc_id", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "w.*")
    firsts = (
        windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("h1", "h2", "first")
    )
    later = windows.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", "a") > F.col("first"))
    # as many as the document has lines
    covered = later.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))
    placed = texts.join(covered, "doc_id", "left").select("doc_id", "text", F.split("text", "\n", -1).alias("all"), gone.alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.get("all", i)), "\n")
    return placed.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("all")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("kept_text"),
    )


#: The same rows in DuckDB SQL, with the kept text as SHA-256.
SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM l),
f AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM c WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, i AS a, lead(i, 2) OVER d AS b, [x, lead(x, 1) OVER d, lead(x, 2) OVER d] AS k FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS n FROM w WHERE b IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM o WHERE n > 1),
k AS (SELECT c.doc_id, count(g.i) AS n_removed, string_agg(x, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY c.doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM l LEFT JOIN k ON k.doc_id = l.doc_id
"""
