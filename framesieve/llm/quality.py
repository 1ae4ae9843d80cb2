"""Quality rules: statistics of each text, and the frequency of its lines across the documents of its host.

Everything here is DataFrame functions.  Each text is parsed once, within its row and without a shuffle: words become an
array, windows of words a hash each, lines a hash of host and normalised line.  What the parse gives is stored, so that
the frequency of lines and their removal both read hashes instead of texts.  Only texts with a repeated window pay for the
sort that finds where it lies.

Documents are told apart by doc_id: copies are documents of their own and make their lines frequent; rows that repeat an
id are one document, rows without one are documents of their own.  Lines above the limit are removed; a document left
with too little is depleted.  Only hashes and counts are shuffled,
summed before the shuffle; the join that marks frequent lines is one that adaptive execution splits at a hot line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, stored

#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: White space that a normalised line does not have: runs, and anything but a blank.
UNEVEN = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of a text column.

    Null texts have no words.  n_repeat_words counts the words that lie in a 3-word window found twice or more.  Two
    windows are taken as equal where their 64-bit hashes are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.regexp_replace(whole, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), WORD_GAP)
    df = docs.withColumn("_w", F.when(words[0] == "", F.array().cast("array<string>")).otherwise(words))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("_lines", lines)
    hashes = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    df = df.withColumn("_h", hashes)
    # Sorted with their places, equal windows stand next to each other.
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(none))

    def other(j: Column) -> Column:
        return F.get("_s", j)["h"]

    twice = F.filter("_s", lambda x, j: F.coalesce(x["h"] == other(j + 1), F.lit(False)) | F.coalesce(x["h"] == other(j - 1), F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # A window adds three words, less those that the next one holds too.
    covered = F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3))))
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x),
        }
    ).drop("_w", "_lines", "_h", "_s", "_at")


def line_keys(text: Column, host: Column) -> Column:
    """Per line with a word its key (hash of host and normalised line) and its words.

    Normalised: lower case, white space runs as one blank, trimmed.
    """
    flat = F.regexp_replace(F.lower(text), UNEVEN, " ")
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(host, x).alias("key"),
            (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"),
        ),
    )


def frequent_line_words(parsed: DataFrame, most_docs: int = 10) -> DataFrame:
    """(_row, removed): words on lines that more than most_docs distinct documents of the same host hold.

    parsed needs _row, doc_id and _keys (line_keys).
    """
    once = parsed.select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), F.col("_row")).alias("_unnamed"),
        F.explode(F.array_distinct(F.transform("_keys", lambda x: x["key"]))).alias("_key"),
    )
    spread = once.distinct().groupBy("_key").agg(F.count("*").alias("_docs"))
    frequent = spread.where(F.col("_docs") > most_docs).select("_key")
    lines = parsed.select("_row", F.explode("_keys").alias("_line")).select("_row", "_line.words", "_line.key")
    found = lines.join(frequent, F.col("key") == F.col("_key"), "left_semi")
    return found.groupBy("_row").agg(F.sum("words").alias("removed"))


def judged(
    docs: DataFrame,
    least_words: int = 50,
    most_repeat_percent: int = 50,
    most_docs: int = 10,
    least_left_percent: int = 50,
) -> DataFrame:
    """(doc_id, n_words, ..., removed_words, base_failed, kept) for every row of docs.

    docs needs doc_id, text and source; other columns are left out.  base_failed: under least_words words, or more than
    most_repeat_percent of them in repeated windows.  kept: not base_failed, and after the frequent lines are removed
    least_words words and least_left_percent of all words are left.  Null and empty texts fail; a null source is a host
    of its own; every row is judged by itself, those without doc_id and those that repeat one too.  An empty table gives an
    empty table.
    """
    narrow = docs.select("doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id())
    keys = line_keys(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    parsed = with_statistics(narrow).withColumn("_keys", keys).drop("text", "source")
    parsed = stored(parsed, "quality-lines")
    df = parsed.drop("_keys").join(frequent_line_words(parsed, most_docs), "_row", "left").drop("_row")
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words")
    )
    depleted = (left < least_words) | (100 * left < least_left_percent * F.col("n_words"))
    return (
        df.withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .drop("removed")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )
