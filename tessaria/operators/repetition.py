"""Material that repeats within a report and across its chapters (DUP-24 to DUP-26).

Chapters are rows (report, chapter, text); (report, chapter) is their key and chapters are read in its order. Keys of lines and
sentences are found within a chapter's row, and whether one stands earlier is a comparison with one minimum per key, so a key of
any frequency is pre-aggregated and no window spans more than one chapter. A null text is empty; empty tables give empty results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks before list items, what makes a line a data row, and citations (fixed patterns).
BULLET = r"^[\s　]*(?:[-*+][\s　]+|[0-9]+[.)、][\s　]*)"
DATA_ROW = BULLET + r"|^[\s　]*\|"
CITED = r"\[[0-9]+(?:-[0-9]+)?\]"
_CHAPTER = ["report", "chapter"]


def data_key(line: Column, least: int = 6) -> Column:
    """DUP-24: what a list item or table row says, without marks, citations and white space; null for other lines, for
    short ones and for those without a digit."""
    said = F.regexp_replace(F.regexp_replace(line, BULLET, ""), CITED + r"|[\s　*`|]", "")
    said = F.regexp_replace(said, r"^[。；;]+|[。；;]+$", "")
    return F.when(line.rlike(DATA_ROW) & (F.length(said) >= least) & said.rlike("[0-9]"), said)


def _keys(chapters: DataFrame, least: int) -> DataFrame:
    """(report, chapter, kind, key): the different keys of a chapter, found within its row: sentences of its prose (0), of
    its other lines (1) and data rows (2)."""
    lines = chapters.select(*_CHAPTER, F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("lines"))

    def sentences(prose: bool) -> Column:
        of = F.filter("lines", lambda x: x.rlike(r"^[\s　]*[#|]") != F.lit(prose))
        pieces = F.flatten(F.transform(of, lambda x: F.split(F.regexp_replace(x, BULLET, ""), "(?<=[。！？])")))
        return F.array_distinct(F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, CITED + r"|[\s　*`]|[。！？]+$", "")), lambda x: F.length(x) >= least))

    data = F.array_distinct(F.array_compact(F.transform(F.filter("lines", lambda x: x.rlike(DATA_ROW)), lambda x: data_key(x))))
    of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    all_ = F.concat(F.transform(sentences(True), of(0)), F.transform(sentences(False), of(1)), F.transform(data, of(2)))
    return lines.select(*_CHAPTER, F.explode_outer(all_).alias("x")).select(*_CHAPTER, "x.*").filter("key is not null")


#: What a line ends with to Java's `$`, so Python finds the same keys.
_END = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"


def _thinned(least: int, least_paragraph: int):
    """Text and number of removed sentences and rows, of a chapter and the keys that earlier chapters have."""
    pattern = lambda x: re.compile(x.replace("$", _END), re.A)
    bullet, data_row, marks, ends, heading = (pattern(x) for x in (BULLET, DATA_ROW, CITED + r"|[\s　*`|]", r"^[。；;]+|[。；;]+$", r"^[\s　]*(#{1,6})\s+\S"))
    sentence, noise, other, outer = (pattern(x) for x in (r"(?<=[。！？])", CITED + r"|[\s　*`]|[。！？]+$", r"^\s*(?:[#|>]|[-*+]\s|[0-9]+[.)、]\s)", r"^\s+|\s+$"))
    space, digit = re.compile(r"[\s　]+", re.A), re.compile("[0-9]")

    def row_key(line: str, body: str) -> str | None:
        key = ends.sub("", marks.sub("", body)) if data_row.match(line) else ""
        return key if len(key) >= 6 and digit.search(key) else None

    def one(text: str | None, told: set, told_rows: set) -> tuple[str, int]:
        removed, rows, here, lines = 0, set(), set(), []
        same_before: set[str] = set()
        for raw in re.split(r"\r?\n", text or ""):
            found = bullet.match(raw)
            body = raw[found.end() :] if found else raw
            key = row_key(raw, body)
            if key is not None:
                if key in told_rows or key in rows:
                    removed += 1
                    continue
                rows.add(key)
            kept = []
            for piece in sentence.split(body):
                said = noise.sub("", piece)
                if len(said) >= least:
                    again = said in told or said in here
                    here.add(said)
                    if again:
                        removed += 1
                        continue
                kept.append(piece)
            line = raw
            if body.strip(" "):
                left = "".join(kept).strip(" ")
                if not left:
                    continue
                line = raw[: len(raw) - len(body)] + left
            same = space.sub("", line)
            if same in same_before and len(same) >= least_paragraph and not other.match(line):
                continue
            same_before.add(same)
            lines.append(line)
        # From the end: a heading stays if text follows and, up to it, only lower headings.
        out, lowest, text_follows = [], 7, False
        for line in reversed(lines):
            found = heading.match(line)
            if found is None:
                if line.strip(" "):
                    lowest, text_follows = 7, True
                out.append(line)
                continue
            if text_follows and lowest > len(found[1]):
                out.append(line)
            lowest = min(lowest, len(found[1]))
        return outer.sub("", "\n".join(reversed(out))), removed

    @F.pandas_udf("text string, removed long")
    def thin(text: pd.Series, told: pd.Series, told_rows: pd.Series) -> pd.DataFrame:
        some = lambda x: set() if x is None else set(x)
        return pd.DataFrame([one(t, some(a), some(b)) for t, a, b in zip(text, told, told_rows)], columns=["text", "removed"])

    return thin


def without_repeats(chapters: DataFrame, least: int = 25, least_paragraph: int = 40) -> DataFrame:
    """DUP-24: (report, chapter, text, removed): chapters without sentences and data rows that stand earlier, and how
    many went.

    A data row goes if its key stands in an earlier chapter or further up. Of the lines left, a sentence of `least`
    characters or more goes if an earlier chapter as given says it in its prose, or the same chapter has kept it already.
    Lines with nothing left go, as do further equal prose lines of `least_paragraph` characters within a chapter and
    headings left bare. What is unique stays in its place, blank lines at both ends aside. Only keys that several chapters have
    are joined; each chapter is then read once with those that earlier chapters have.
    """
    keys = _keys(chapters, least)
    row = F.col("kind") == 2
    first = keys.groupBy("report", row.alias("row"), F.xxhash64("key").alias("h"), "key").agg(F.min(F.when(F.col("kind") != 1, F.col("chapter"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(*(F.col(c).alias(f"_{c}") for c in ("report", "row", "h", "key", "first")))
    same = F.col("report").eqNullSafe(F.col("_report")) & (row == F.col("_row")) & (F.xxhash64("key") == F.col("_h")) & (F.col("key") == F.col("_key"))
    told = keys.join(first, same).filter(F.col("_first") < F.col("chapter"))
    told = told.groupBy(F.col("report").alias("_report"), F.col("chapter").alias("_chapter")).agg(F.collect_list(F.when(~row, F.col("key"))).alias("told"), F.collect_list(F.when(row, F.col("key"))).alias("told_rows"))
    out = chapters.select(*_CHAPTER, "text").join(told, F.col("report").eqNullSafe(F.col("_report")) & F.col("chapter").eqNullSafe(F.col("_chapter")), "left")
    return out.select(*_CHAPTER, _thinned(least, least_paragraph)("text", "told", "told_rows").alias("x")).select(*_CHAPTER, "x.text", "x.removed")


def _said(chapters: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Keys of a chapter, found within its row: (report, chapter, kind, key, alone) with its different sentences (kind 0) and
    data rows (kind 1; alone: once in the chapter), and (report, chapter, n, chars, n_rows) with all its sentences, their
    characters and its different data rows."""
    lines = chapters.select(*_CHAPTER, F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("lines"))
    bodies = F.transform(F.filter("lines", lambda x: ~x.rlike(r"^[\s　]*[#|]")), lambda x: F.regexp_replace(x, BULLET, ""))
    keys = F.transform(F.flatten(F.transform(bodies, lambda x: F.split(x, "(?<=[。！？])"))), lambda x: F.regexp_replace(x, CITED + r"|[\s　*`]|[。！？]+$", ""))
    data = F.transform(F.filter("lines", lambda x: x.rlike(DATA_ROW)), lambda x: data_key(x))
    found = lines.select(*_CHAPTER, F.filter(keys, lambda x: F.length(x) >= least).alias("keys"), F.array_sort(F.array_compact(data)).alias("data"))
    different = lambda x, i: (i == 0) | (F.get("data", i - 1) != x)
    alone = lambda x, i: different(x, i) & ~F.coalesce(F.get("data", i + 1) == x, F.lit(False))
    n = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    rows = found.select(*_CHAPTER, F.size("keys").cast("long").alias("n"), n.alias("chars"), F.size(F.filter("data", different)).cast("long").alias("n_rows"))
    said = lambda kind, one: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"), F.lit(one).alias("alone"))
    many = F.filter("data", lambda x, i: different(x, i) & ~alone(x, i))
    all_ = F.concat(F.transform(F.array_distinct("keys"), said(0, False)), F.transform(F.filter("data", alone), said(1, True)), F.transform(many, said(1, False)))
    # An outer explode: for the other, Spark would find all keys a second time, to leave out chapters without any.
    return found.select(*_CHAPTER, F.explode_outer(all_).alias("x")).select(*_CHAPTER, "x.*").filter("key is not null"), rows


def issues(chapters: DataFrame, least: int = 25, least_sentences: int = 3, least_chars: int = 120, share: float = 0.25, least_rows: int = 3) -> DataFrame:
    """DUP-25: per chapter the sentences (with characters) and the different data rows that stand earlier in the report, and
    whether either is an issue: `least_sentences` sentences with `least_chars` characters and `share` of the chapter's,
    or `least_rows` data rows. Every later place of a sentence counts, of a data row each key once.

    What is repeated is what is there less what stands first here, so keys are grouped once and never joined with their places."""
    said, rows = _said(chapters, least)
    first = said.groupBy("report", "kind", F.xxhash64("key").alias("h"), "key").agg(F.min("chapter").alias("first"), F.min(F.when(F.col("alone"), F.col("chapter"))).alias("alone"))
    prose, n = F.col("kind") == 0, F.length("key").cast("long")
    first = first.groupBy(F.col("report").alias("_report"), F.col("first").alias("_chapter")).agg(F.count_if(prose).alias("firsts"), F.sum(F.when(prose, n)).alias("first_chars"), F.count_if(~prose & (F.col("alone") == F.col("first"))).alias("first_rows"))
    less = lambda a, b: F.col(a) - F.coalesce(b, F.lit(0))
    out = rows.join(first, F.col("report").eqNullSafe(F.col("_report")) & F.col("chapter").eqNullSafe(F.col("_chapter")), "left")
    out = out.select(*_CHAPTER, less("n", "firsts").alias("repeated"), less("chars", "first_chars").alias("repeated_chars"), "chars", less("n_rows", "first_rows").alias("repeated_rows"))
    bad = (F.col("repeated") >= least_sentences) & (F.col("repeated_chars") >= F.greatest(F.lit(float(least_chars)), share * F.col("chars")))
    return out.withColumn("prose_issue", bad).withColumn("rows_issue", F.col("repeated_rows") >= least_rows)


def locations(docs: DataFrame, least: int = 26, references: str = "参考|References") -> DataFrame:
    """DUP-26: (sentence, doc_id, pos, part, heading, n): every place of a sentence of `least` characters or more, citations
    and white space aside, that has more than one in all documents; a row for each place, so no list grows with a sentence.
    heading is the nearest `#` line above (null before the first); what stands under one that starts with `references` is left out."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("pos", "line"))
    title = F.nullif(F.regexp_extract("line", r"^#+\s+(.*\S)", 1), F.lit(""))
    rows = rows.withColumn("heading", F.last(title, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos")))
    rows = rows.filter(~F.coalesce(F.col("heading").rlike(f"^(?:{references})"), F.lit(False)))
    s = rows.select("doc_id", "pos", "heading", F.posexplode(F.split("line", "(?<=[。！？])")).alias("part", "piece"))
    s = s.withColumn("sentence", F.regexp_replace("piece", CITED + r"|[\s　]", "")).filter(F.length("sentence") >= least).drop("piece")
    return s.join(s.groupBy("sentence").agg(F.count("*").alias("n")).filter("n > 1"), "sentence").select("sentence", "doc_id", "pos", "part", "heading", "n")
