"""Report pages -> review rows.

Input is a line table ``(doc, page, line_no, line)``. Segmentation uses only
windows partitioned by (doc, page), so a task holds one page at a time (pages
are bounded), and the per-report results use per-doc groups.

Rules (first match wins per line): term marker -> course name (whole line),
``Instructor: ``, ``Subject: ``, ``Catalog & Section: `` (first blank-separated
token), ``Course ID: ``, then ``Q: `` (text after the last marker). A line
containing ``Q: `` closes the open segment and opens a new one when its class is
the question class. Inside a segment every numeric line yields the next
non-empty line of the page as a review; other lines there are ignored. A
question asked again later replaces the earlier list (last segment wins),
and metadata takes the last value seen outside segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import REPORT_TERM_MARKER

LINE_BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
META_FIELDS = ["course_name", "instructor", "subject", "course_number", "crn"]


def classify(line: Column, term: str = REPORT_TERM_MARKER) -> Column:
    """Class of a line."""
    return (F.when(F.instr(line, term) > 0, F.lit("course_name"))
            .when(F.instr(line, "Instructor: ") > 0, F.lit("instructor"))
            .when(F.instr(line, "Subject: ") > 0, F.lit("subject"))
            .when(F.instr(line, "Catalog & Section: ") > 0, F.lit("course_number"))
            .when(F.instr(line, "Course ID: ") > 0, F.lit("crn"))
            .when(F.instr(line, "Q: ") > 0, F.lit("q")))


def value_of(line: Column, cls: Column) -> Column:
    """Text after the marker (split piece 1; question: last piece)."""
    def piece(marker):
        return F.element_at(F.split(line, marker), 2)
    return (F.when(cls == "course_name", line)
            .when(cls == "instructor", piece("Instructor: "))
            .when(cls == "subject", piece("Subject: "))
            .when(cls == "course_number", F.element_at(F.split(piece("Catalog & Section: "), " "), 1))
            .when(cls == "crn", piece("Course ID: "))
            .when(cls == "q", F.element_at(F.split(line, "Q: "), -1)))


def is_numeric(line: Column) -> Column:
    """the whole line is Unicode numerals (str.isnumeric)."""
    return line.rlike(r"^\p{N}+$")


def annotate(lines: DataFrame, term: str = REPORT_TERM_MARKER) -> DataFrame:
    """Per line: class, value, the open segment (latest Q-line) and the next non-empty line."""
    page = Window.partitionBy("doc", "page").orderBy("line_no")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next non-empty line as a running value over the reverse order (a frame that
    # ends at the page's last line would be read anew for every row)
    back = Window.partitionBy("doc", "page").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = lines.select("doc", "page", "line_no", "line", classify(F.col("line"), term).alias("cls"),
                     (F.instr("line", "Q: ") > 0).alias("hasq"))
    x = x.select("*", value_of(F.col("line"), F.col("cls")).alias("value"))
    seg = F.when(F.col("hasq"), F.struct(F.col("line_no").alias("seg_line"), F.col("cls").alias("seg_cls"),
                                          F.col("value").alias("question")))
    return x.select("*", F.last(seg, ignorenulls=True).over(upto).alias("seg"),
                    F.last(F.when(F.col("line") != "", F.col("line")), ignorenulls=True)
                    .over(back).alias("next_line"))


def _in_open_segment(a: DataFrame) -> Column:
    return (F.col("seg.seg_cls") == "q") & ~F.col("hasq")


def review_lines(annotated: DataFrame) -> DataFrame:
    """W1 + A6: (doc, question, review, page, line_no) of the last segment per question."""
    a = annotated
    reviews = a.where(_in_open_segment(a) & is_numeric(F.col("line")) & F.col("next_line").isNotNull()) \
        .select("doc", "page", F.col("seg.seg_line").alias("seg_line"),
                F.col("seg.question").alias("question"), "line_no", F.col("next_line").alias("review"))
    # Every question segment, with or without reviews, replaces earlier ones.
    last = (a.where(F.col("cls") == "q")
            .groupBy("doc", F.col("value").alias("question"))
            .agg(F.max(F.struct("page", "line_no")).alias("last")))
    last = last.select("doc", "question", F.col("last.page").alias("page"),
                       F.col("last.line_no").alias("seg_line"))
    return reviews.join(last, ["doc", "question", "page", "seg_line"]).select(
        "doc", "question", "review", "page", "line_no")


def report_metadata(annotated: DataFrame) -> DataFrame:
    """Last value per field per doc among lines the scan visits (outside segments)."""
    a = annotated.where(~_in_open_segment(annotated) | F.col("seg").isNull())
    a = a.where(F.col("cls").isin(*META_FIELDS))
    aggs = [F.expr(f"max_by(value, struct(page, line_no)) FILTER (WHERE cls = '{f}')").alias(f)
            for f in META_FIELDS]
    return a.groupBy("doc").agg(*aggs)


def review_rows(lines: DataFrame, term: str = REPORT_TERM_MARKER) -> DataFrame:
    """Long review rows with '' for missing metadata; crn is the doc name."""
    a = annotate(lines, term)
    r = review_lines(a)
    m = report_metadata(a)
    out = r.join(m, "doc", "left")
    return out.select(F.col("doc").alias("crn"),
                      *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in
                        ["course_name", "instructor", "subject", "course_number"]],
                      "question", "review", "page", "line_no")


# --------------------------------------------------------------------------- sources


def lines_from_text(df: DataFrame, doc_col: str, text_col: str, page_break: str = "\f") -> DataFrame:
    """Extracted report text -> (doc, page, line_no, line); pages split on form feed."""
    pages = df.select(F.col(doc_col).alias("doc"),
                      F.posexplode(F.split(F.col(text_col), page_break)).alias("page", "ptext"))
    return pages.select("doc", "page", F.posexplode(F.split("ptext", LINE_BREAKS)).alias("line_no", "line"))


def read_report_dir(spark, path: str, glob: str = "*.txt") -> DataFrame:
    """S5 + F5: one report per file; the doc key is the file name without extension."""
    raw = (spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
           .select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.[^.]+$", 1).alias("doc"),
                   F.col("value").alias("text")))
    return lines_from_text(raw, "doc", "text")


def conversation_lines(conv: DataFrame) -> DataFrame:
    """Report lines built from a conversation table: one page per conversation;
    user turn -> 'Q: ' + text; assistant turn -> the turn number, a blank line,
    the text; system turn -> 'Instructor: ' + text. Lines are numbered by (turn, position)
    within the page, which is the partitioning that ``annotate`` needs anyway."""
    block = (F.when(F.col("role") == "user", F.concat(F.lit("Q: "), F.col("text")))
             .when(F.col("role") == "assistant",
                   F.concat(F.col("turn").cast("string"), F.lit("\n\n"), F.col("text")))
             .otherwise(F.concat(F.lit("Instructor: "), F.col("text"))))
    x = conv.select(F.col("conv_id").cast("string").alias("doc"), F.lit(0).alias("page"), "turn",
                    F.posexplode(F.split(block, "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc", "page").orderBy("turn", "pos")
    return x.select("doc", "page", (F.row_number().over(order) - 1).cast("long").alias("line_no"), "line")
