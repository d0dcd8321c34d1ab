"""Quality rules by distribution divergence, with DataFrame functions only.

Each document gets a histogram of character classes and one of common words.  The reference of a language is
the mean of its documents' shares; a document whose Jensen-Shannon distance to its language's reference is
large is not text of that language's kind.  How large is read from the spread of like documents, as the noise of
a histogram shrinks with a text's length.  Documents under ``guard_chars`` words are not judged by histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANK, BLANKS, BROADCAST_ROWS, Work, checked_broadcast

#: Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not this are from at an or"
    " le la les des du et en un une que qui dans pour pas sur par plus avec"
    " der die das und den von zu mit sich auf nicht ein eine ist im dem"
    " el los las del y se una con por para su al lo como es de a"
).split()
SYMBOLS = "#*$%&|<>"
#: What is taken out of a text before its other characters are counted.
SMALL = r"[a-z\x20\x09-\x0D]+"
#: Character classes, as patterns over what is left of a text without blanks and a-z; each takes from what those before it left.
CLASSES = {"letter": r"[^\x00-\x7F]+", "stop": "[.,;:!?'\"()-]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": r"[#*$%&|<>_=+/\\@~^`{}\[\]]+"}


def _count(column: Column, pattern: str) -> Column:
    return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))


def with_histograms(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``_words, _n_words, _rest, _word_chars, _chars`` (class counts), ``_present, _common`` (common-word counts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_split", F.split(text, BLANK, -1)).withColumn("_rest", F.regexp_replace(text, SMALL, ""))
    # blanks at an end of the text leave an empty string at that end
    lead, tail = (F.col("_split")[0] == "").cast("int"), (F.element_at("_split", -1) == "").cast("int")
    found = found.withColumn("_words", F.slice("_split", lead + 1, F.greatest(F.size("_split") - lead - tail, F.lit(0))))
    found = found.withColumn("_n_words", F.size("_words").cast("long"))
    found = found.withColumn("_word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
    counted = found.withColumn("_left0", F.col("_rest"))
    for k, pattern in enumerate(CLASSES.values()):
        counted = counted.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
    left = [F.length(f"_left{k}") for k in range(len(CLASSES) + 1)]
    lower = F.col("_word_chars") - F.length("_rest")
    counted = counted.withColumn("_chars", F.array(lower.cast("int"), left[-1], *[x - y for x, y in zip(left, left[1:], strict=False)]))
    forms = sorted({x for w in COMMON_WORDS for x in (w, w.capitalize())})
    counted = counted.withColumn("_hits", F.transform(F.filter("_words", lambda w: w.isin(*forms)), F.lower))
    # sparse: number 0 stands for all other words; a wide dense array would not be compiled
    counted = counted.withColumn("_seen", F.array_distinct("_hits"))
    times = F.transform("_seen", lambda w: F.size("_hits") - F.size(F.array_remove(F.col("_hits"), w)))
    other = F.col("_n_words").cast("int") - F.size("_hits")
    numbers = F.transform("_seen", lambda w: F.array_position(F.array(*[F.lit(x) for x in COMMON_WORDS]), w).cast("int"))
    return counted.withColumn("_common", F.concat(F.array(other), times)).withColumn("_present", F.concat(F.array(F.lit(0)), numbers))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def _divergence(p: Column, q: Column) -> Column:
    """One class's part of the Jensen-Shannon divergence, in bits."""
    of = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return (of(p) + of(q)) / 2


def _root_sum(parts: Column, more: Column) -> Column:
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) + more, F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two share arrays of equal length."""
    return _root_sum(F.zip_with(p, q, _divergence), F.lit(0.0))


def js_distance_sparse(classes: Column, p: Column, q: Column) -> Column:
    """The same of shares ``p`` of some ``classes`` (0, 1, ...) to all shares ``q``: an absent class adds half its share."""
    parts = F.zip_with(p, classes, lambda x, k: _divergence(x, F.get(q, k)) - F.get(q, k) / 2)
    return _root_sum(parts, F.aggregate(q, F.lit(0.0), lambda a, x: a + x) / 2)


def language_references(features: DataFrame, least_words: int) -> DataFrame:
    """``_lang, _ref_chars, _ref_common``: mean shares over a language's documents of ``least_words`` words that pass the
    base rules; null is a language.  ``_all_common`` is the mean over all such documents."""
    found = features.where((F.col("_n_words") >= least_words) & ~F.col("_base_failed"))
    shares = found.select("_lang", "_present", _shares(F.col("_chars")).alias("c"), _shares(F.col("_common")).alias("w"))
    n_w, n_c = len(COMMON_WORDS) + 1, len(CLASSES) + 2
    entries = F.concat(
        F.zip_with("_present", "w", lambda k, x: F.struct(k.alias("k"), x.alias("x"))),
        F.transform("c", lambda x, i: F.struct((i + n_w).alias("k"), x.alias("x"))),
    )
    sums = shares.select("_lang", F.inline(entries)).groupBy("_lang", "k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    mean = lambda a, n: F.transform(F.sequence(F.lit(a), F.lit(a + n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("docs"))

    def gathered(sums: DataFrame, *by: str) -> DataFrame:
        """Dense arrays; a group has at most n_w + n_c rows."""
        return sums.groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"), F.max(F.when(F.col("k") == 0, F.col("n"))).alias("docs")
        )

    own = gathered(sums, "_lang").select("_lang", mean(n_w, n_c).alias("_ref_chars"), mean(0, n_w).alias("_ref_common"))
    whole = gathered(sums.groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))).select(mean(0, n_w).alias("_all_common"))
    return own.crossJoin(F.broadcast(whole))  # one row


def word_spreads(judged: DataFrame, least_docs: int) -> DataFrame:
    """``_of, _octave, _middle, _spread`` of the scaled word distance, per language and length (doublings of words).

    The distance of a sample of n words shrinks with the root of n, so it is scaled by that.  The spread is that of the
    lower half, which junk does not widen; a length with under ``least_docs`` documents has none.
    """
    found = judged.where(F.col("_scaled").isNotNull() & ~F.col("_base_failed")).groupBy(F.col("_lang").alias("_of"), F.col("_octave"))
    spreads = found.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_scaled", F.array(F.lit(0.25), F.lit(0.5)), F.lit(10_000)).alias("q"))
    return spreads.where(F.col("n") >= least_docs).select("_of", F.col("_octave").alias("_length"), F.col("q")[1].alias("_middle"), ((F.col("q")[1] - F.col("q")[0]) / 0.6745).alias("_spread"))


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Add ``_n_repeat``: words in windows of three words that the text holds twice or more."""
    words = F.col("_words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    found = docs.withColumn("_windows", windows)
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    found = found.withColumn("_sorted", F.when(
        repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    ordered = F.col("_sorted")
    twice = F.filter(ordered, lambda s, k: (s["h"] == F.get(ordered, k - 1)["h"]) | (s["h"] == F.get(ordered, k + 1)["h"]))
    places = F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))
    return found.withColumn("_n_repeat", F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long"))


def quality_features(docs: DataFrame, least_words: int, max_repeat_percent: int, text_col: str, keep: list[Column]) -> DataFrame:
    """One pass over the texts: ``keep`` and the narrow columns that the verdict needs."""
    found = _repeated_words(with_histograms(docs, text_col))
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    found = found.withColumn("_lines", lines)
    found = found.withColumn("_n_dup_lines", F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long"))
    found = found.withColumn("_n_symbols", _count(F.col("_rest"), f"[{SYMBOLS}]+").cast("long"))
    base = (F.col("_n_words") < least_words) | (100 * F.col("_n_repeat") > max_repeat_percent * F.col("_n_words"))
    own = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat", "_chars", "_present", "_common"]
    return found.select(*keep, *own, base.alias("_base_failed"))


def judge_quality(
    docs: DataFrame, far_chars: float = 0.30, near_chars: float = 0.172, far_words: float = 0.28, guard_chars: int = 50, guard_words: int = 100,
    least_words: int = 50, max_repeat_percent: int = 50, spreads: float = 4.0, spread_docs: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Per document ``id, _text_hash, _lang, _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat, _char_distance,
    _word_distance, _base_failed, _kept``.

    A null text has no words; null is a language, and a null id is judged like any other, as are repeated rows.  Other
    columns are not read and may have any name.  An empty table stays empty.  A document fails the base rules with fewer than ``least_words`` words or more
    than ``max_repeat_percent`` of its words in repeated windows.  Of the others, one is rejected if its characters
    are ``far_chars`` from its language's (and it has ``guard_chars`` words), or if they are ``near_chars`` from them
    and its common words ``far_words`` from the language's and from those of all languages together, as text of
    mixed languages is not (and it has ``guard_words`` words).  Whatever its characters, it is rejected if its common
    words are ``far_words`` away and over ``spreads`` spreads beyond the median of its language's documents of like
    length (from ``guard_chars`` words, where ``spread_docs`` such documents are).  Without a reference the base rules
    judge alone.
    """
    work = Work(docs.sparkSession, "divergence")
    keep = [F.col(id_col), F.xxhash64(text_col).alias("_text_hash"), F.col(lang_col).alias("_lang")]
    docs = docs.select(docs[id_col], docs[text_col], docs[lang_col])
    found = work.save(quality_features(docs, least_words, max_repeat_percent, text_col, keep), "features")
    references = work.save(language_references(found, guard_words), "references").withColumnRenamed("_lang", "_of")
    judged = found.join(checked_broadcast(references), F.col("_lang").eqNullSafe(F.col("_of")), "left")
    of_words = lambda ref: js_distance_sparse(F.col("_present"), _shares(F.col("_common")), F.col(ref))
    judged = judged.withColumn("_char_distance", F.when(F.col("_n_words") >= guard_chars, js_distance(_shares(F.col("_chars")), F.col("_ref_chars"))))
    judged = judged.withColumn("_word_distance", F.when(F.col("_n_words") >= guard_chars, F.least(of_words("_ref_common"), of_words("_all_common"))))
    judged = judged.withColumn("_scaled", F.col("_word_distance") * F.sqrt("_n_words")).withColumn("_octave", F.floor(F.log2(F.col("_n_words") / guard_chars)))
    own = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat", "_char_distance", "_word_distance", "_base_failed"]
    judged = work.save(judged.select(id_col, "_text_hash", "_lang", *own, "_scaled", "_octave"), "distances")
    like = work.save(word_spreads(judged, spread_docs), "spreads")
    judged = judged.join(checked_broadcast(like), F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("_octave") == F.col("_length")), "left")
    far_of_words = F.col("_word_distance") > far_words
    beyond = far_of_words & (F.col("_scaled") > F.col("_middle") + spreads * F.col("_spread"))
    mixed = (F.col("_n_words") >= guard_words) & (F.col("_char_distance") > near_chars) & far_of_words
    far = F.coalesce(F.col("_char_distance") > far_chars, F.lit(False)) | F.coalesce(mixed, F.lit(False)) | F.coalesce(beyond, F.lit(False))
    return judged.select(id_col, "_text_hash", "_lang", *own, (~F.col("_base_failed") & ~far).alias("_kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``judge_quality`` rejects."""
    judged = judge_quality(docs, id_col=id_col, text_col=text_col, **options)
    bad = judged.where(~F.col("_kept")).select(F.col(id_col).alias("_bad_id"), F.col("_text_hash").alias("_bad_text")).distinct()
    bad = Work(docs.sparkSession, "divergence").save(bad, "rejected")
    same = docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col]) == bad["_bad_text"])
    rows = bad.count()
    return docs.join(F.broadcast(bad) if rows <= BROADCAST_ROWS else bad, same, "left_anti")
