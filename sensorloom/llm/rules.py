"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole_text

#: Words of which running text in its language has many.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for was on are as by from or an a",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine",
    "fr": "le la les de des et un une du en est que pour dans qui sur par",
    "es": "el la los de que y en un una las del se por con no su para",
}

#: (statistic, least, most); None: no bound. A document is kept if every rule holds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_share", None, 0.30),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.10),
    ("stop_words", 2, None),
    ("dup_line_share", None, 0.50),
    ("capital_share", None, 0.40),
)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, although a lambda in `use` may read it for each element."""
    return F.transform(F.array(value), use)[0]


def _covered(words: Column, window: int) -> Column:
    """Words that lie in windows found twice or more."""

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        keys = F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(window)]))

        def of_keys(k: Column) -> Column:
            pairs = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))

            def repeated(p: Column) -> Column:
                return F.array_sort(F.transform(F.filter(p, lambda x, i: ((i > 0) & (p[F.greatest(i - 1, F.lit(0))]["k"] == x["k"])) | ((i < F.size(p) - 1) & (p[F.least(i + 1, F.size(p) - 1)]["k"] == x["k"]))), lambda x: x["i"]))

            def count(at: Column) -> Column:
                return F.aggregate(F.transform(at, lambda x, i: F.when(i == F.size(at) - 1, F.lit(window)).otherwise(F.least(F.lit(window), at[F.least(i + 1, F.size(at) - 1)] - x))), F.lit(0).cast("long"), lambda a, x: a + x)

            return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(let(let(pairs, repeated), count))

        return F.when(F.size(h) < window + 1, F.lit(0).cast("long")).otherwise(let(keys, of_keys))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def text_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Counts of each whole text that the rules read, one row for each row.

    Null texts count as empty: all counts are 0. Rows that repeat are judged each. Lines are cut at
    line feeds, and only lines with a word are counted. An empty table gives no rows. Columns other
    than doc_id and text are not read.
    """
    text = F.col("text")
    stop = sorted({v for words in STOP_WORDS.values() for w in words.split() for v in (w, w.capitalize(), w.upper())})
    base = docs.select("doc_id", whole_text(text).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("words"), window).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("stop_words"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("long").alias("n_capitals"),
    )


def judged(stats: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The table of thresholds as columns: base_failed, the rules that failed, and kept."""
    value = {
        "n_words": F.col("n_words").cast("double"),
        "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word_chars": _share(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _share(F.col("n_symbols"), F.col("n_words")),
        "stop_words": F.col("stop_words").cast("double"),
        "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "capital_share": _share(F.col("n_capitals"), F.col("word_chars")),
    }
    tests = []
    for name, least, most in thresholds:
        broken = F.lit(False)
        if least is not None:
            broken = broken | (value[name] < least)
        if most is not None:
            broken = broken | (value[name] > most)
        tests.append(F.when(broken, F.lit(name)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*tests))
    return stats.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    return judged(text_statistics(docs), thresholds)


def oracle_sql(thresholds=THRESHOLDS) -> str:
    stop = sorted({v for words in STOP_WORDS.values() for w in words.split() for v in (w, w.capitalize(), w.upper())})
    value = {
        "n_words": "n_words",
        "repeat_share": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)",
        "stop_words": "n_stop",
        "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "capital_share": "coalesce(n_capitals / nullif(word_chars, 0), 0)",
    }
    tests = [f"{value[n]} >= {a}" for n, a, _ in thresholds if a is not None] + [f"{value[n]} <= {b}" for n, _, b in thresholds if b is not None]
    return f"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    grams AS (
      SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
    stats AS (
      SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda w: w IN ({', '.join(f"'{w}'" for w in stop)}))) AS n_stop,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
      FROM docs d LEFT JOIN covered c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(tests)} AS kept
    FROM stats"""
