"""Reports of an analysis, as nested rows, JSON files and printable lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators.checking import accuracy
from glyphflow.sources.folder import write_array

#: Fixed value: rows that a report shows.
SHOWN = 20
#: The words of the printed reports.
TOTAL_WORDS, CORRECT, ERRORS, ACCURACY, PERCENT = "Total words: ", "   Correct: ", "   Errors: ", "   Accuracy: ", "%"
LINE, WORD, SUGGESTIONS, NO_SUGGESTIONS, NO_ERRORS = "Line ", ", Word ", "\n   Suggestions: ", "(none found)", "No spelling errors found."
DOCUMENTS, WORDS_SCANNED, ERRORS_FOUND, OVERALL = "Documents processed: ", "Total words scanned: ", "Total errors found: ", "Overall accuracy: "


def text_report(analyzed: DataFrame, totals: DataFrame, dictionary_size: int, id_col: str = "doc_id") -> DataFrame:
    """One row a document: totals and each error, normalised, with its suggestions and their distances."""
    errors = analyzed.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "word_number", "word", "suggestions"))), lambda e: F.struct(e["word"].alias("word"), e["suggestions"].alias("suggestions"))).alias("errors"))
    none = F.array().cast(errors.schema["errors"].dataType)
    out = totals.join(errors, id_col, "left")
    return out.select(id_col, F.col("total_words").alias("total_words_scanned"), "errors_found", "accuracy_percent", F.lit(dictionary_size).alias("dictionary_size"), F.coalesce("errors", none).alias("errors"))


def batch_report(analyzed: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: totals and each error as written, with its place and suggested words."""
    entry = F.struct("line", "word_number", F.col("raw").alias("word"), F.transform("suggestions", lambda s: s["word"]).alias("suggestions"))
    errors = analyzed.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("errors"))
    none = F.array().cast(errors.schema["errors"].dataType)
    out = totals.join(errors, id_col, "left")
    return out.select(F.col(id_col).cast("string").alias("source"), "total_words", "errors_found", "accuracy_percent", F.coalesce("errors", none).alias("errors"))


def write_json(report: DataFrame, path: str) -> None:
    """JSON lines; strings are escaped."""
    report.write.mode("overwrite").json(path)


def write_json_array(report: DataFrame, path: str, order: list[str]) -> None:
    """One file that holds one array of all rows, in the order of ``order``; folders on the way are made, a file of that name is replaced.

    Ranges of the order are sorted and written by tasks of their own; a failed job leaves what was there."""
    tasks = int(report.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = report.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    write_array(ranged.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path)


def overall_summary(totals: DataFrame) -> DataFrame:
    """Totals over all documents; no row when there are none."""
    out = totals.agg(F.count(F.lit(1)).alias("documents"), F.sum("total_words").alias("total_words"), F.sum("errors_found").alias("errors_found")).where("documents > 0")
    return out.withColumn("accuracy_percent", accuracy(F.col("total_words"), F.col("errors_found")))


def listing(articles: DataFrame) -> DataFrame:
    """Number, title, author, date and word count of articles."""
    from glyphflow.functions.text import count_article_words

    return articles.select("article_no", "title", "author", "date", count_article_words(F.col("content")).alias("words"))


def printed(analyzed: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``report``: the totals of a document and each error with its place and suggested words, in printable lines."""
    place = F.concat(F.lit(LINE), F.col("line").cast("string"), F.lit(WORD), F.col("word_number").cast("string"), F.lit(': "'), F.col("raw"), F.lit('"'))
    words = F.array_join(F.transform("suggestions", lambda s: s["word"]), ", ")
    told = F.concat(place, F.lit(SUGGESTIONS), F.when(F.size("suggestions") > 0, words).otherwise(NO_SUGGESTIONS))
    errors = analyzed.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word_number", told.alias("t")))), lambda e: e["t"]), "\n").alias("errors"))
    head = F.concat(F.lit(TOTAL_WORDS), F.col("total_words").cast("string"), F.lit(CORRECT), (F.col("total_words") - F.col("errors_found")).cast("string"), F.lit(ERRORS), F.col("errors_found").cast("string"), F.lit(ACCURACY), F.col("accuracy_percent").cast("string"), F.lit(PERCENT))
    return totals.join(errors, id_col, "left").select(id_col, F.concat(head, F.lit("\n"), F.coalesce("errors", F.lit(NO_ERRORS))).alias("report"))


def printed_summary(totals: DataFrame) -> DataFrame:
    """The totals over all documents in printable lines; no row when there are no documents."""
    line = lambda name, value: F.concat(F.lit(name), value.cast("string"))
    own = overall_summary(totals)
    return own.select(F.concat_ws("\n", line(DOCUMENTS, F.col("documents")), line(WORDS_SCANNED, F.col("total_words")), line(ERRORS_FOUND, F.col("errors_found")), F.concat(line(OVERALL, F.col("accuracy_percent")), F.lit(PERCENT))).alias("report"))


def _first(rows: DataFrame, id_col: str, order: list[str], line: Column, name: str, shown: int) -> DataFrame:
    """The first ``shown`` lines of each document, one under the other, and how many there are."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col("__n") <= shown)
    lines = numbered.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("t")))), lambda e: e["t"]), "\n").alias(name))
    return lines.join(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias(f"n_{name}")), id_col)


def check_report(docs: DataFrame, errors: DataFrame, suggestions: DataFrame, summary: DataFrame, corrected: DataFrame, id_col: str = "doc_id", text_col: str = "text", shown: int = SHOWN) -> DataFrame:
    """The report of a spelling check, one row a document: strategy, text and corrected text in short, the first errors
    with their places, the first distinct ones with their suggestions, how many more of either, and the accuracy."""
    place = F.concat(F.lit(LINE), F.col("line").cast("string"), F.lit(WORD), F.col("word_number").cast("string"), F.lit(": "), F.col("raw"))
    found = _first(errors, id_col, ["line", "word_number"], place, "errors", shown)
    listed = suggestions.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("candidate").alias("word"), "distance"))), lambda s: s.dropFields("rank")).alias("listed"))
    none = F.array().cast(listed.schema["listed"].dataType)
    once = errors.groupBy(id_col, "word").agg(F.min(F.struct("line", "word_number")).alias("at")).join(listed, "word", "left").withColumn("listed", F.coalesce("listed", none))
    told = _first(once, id_col, ["at"], F.concat(F.col("word"), F.lit(" -> "), T.format_suggestions(F.col("listed"))), "suggestions", shown)
    more = lambda n: F.greatest(F.lit(0), F.coalesce(n, F.lit(0)) - shown).cast("long")
    out = summary.join(docs.select(id_col, F.col(text_col).alias("__text")), id_col).join(corrected.select(id_col, "corrected"), id_col, "left").join(found, id_col, "left").join(told, id_col, "left")
    return out.select(
        id_col, "input_type", "use_filtering", "total_tokens", "characters", "errors_found", "suggestions_generated",
        T.preview(F.col("__text")).alias("input"), T.preview(F.coalesce("corrected", F.lit(""))).alias("output"),
        F.coalesce("errors", F.lit("")).alias("first_errors"), more(F.col("n_errors")).alias("more_errors"),
        F.coalesce("suggestions", F.lit("")).alias("first_suggestions"), more(F.col("n_suggestions")).alias("more_suggestions"),
        T.percent(F.when(F.col("total_tokens") == 0, 0.0).otherwise((F.col("total_tokens") - F.col("errors_found")) / F.col("total_tokens"))).alias("text_accuracy"),
    )
