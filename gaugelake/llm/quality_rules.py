"""Quality rules: base counts of a text and its divergence from its language's reference histograms.

A text is reduced to two histograms: character classes, and the most usual words of its language. The reference
of a language is the same pair of histograms summed over every text of that language that passes the base rules and is long enough to
be judged. A text goes when the Jensen-Shannon distance (square root of the divergence, base 2) to its reference
exceeds a threshold. Everything is DataFrame expressions; the only shuffle carries one row a task and language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import SPACE, materialize

# Usual words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on as with are be this from at or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Every other language, or none given, shares one reference of character classes and has no word histogram.
OTHER = "other"
CLASSES = ("upper", "letter", "digit", "mark", "symbol", "space", "rest")
SYMBOLS = r"[#*$%&|<>]"


def _count_dropping(text: Column, outside: str) -> Column:
    """Code points of ``text`` that the negated class ``outside`` leaves."""
    return F.length(F.regexp_replace(text, outside, ""))


def _histograms(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``docs`` with _text, _lang, _words, _n_words, _word_chars, _n_symbols, _chars and _common."""
    known = lang.isin(*COMMON_WORDS)
    df = docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_lang", F.when(known, lang).otherwise(OTHER))
    df = df.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    df = df.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "_upper": _count_dropping(F.col("_text"), r"[^\p{Lu}]+").cast("long"),
            "_letters": _count_dropping(F.col("_text"), r"[^\p{L}]+").cast("long"),
            "_digits": _count_dropping(F.col("_text"), r"[^\p{Nd}]+").cast("long"),
            "_marks": _count_dropping(F.col("_text"), r"[^.,;:!?'\"()-]+").cast("long"),
            "_all": F.length("_text").cast("long"),
        }
    )
    spaces = F.col("_all") - F.col("_word_chars")
    rest = F.col("_all") - F.col("_letters") - F.col("_digits") - F.col("_marks") - F.col("_n_symbols") - spaces
    classes = [F.col("_upper"), F.col("_letters") - F.col("_upper"), F.col("_digits"), F.col("_marks"), F.col("_n_symbols"), spaces, rest]
    # Words as hashes: counting them is then a pass over longs. Of a text's words only the lists' own matter, so nothing else need differ.
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))
    counts = F.lit(None)
    for code, common in COMMON_WORDS.items():
        each = [(F.size("_hits") - F.size(F.array_remove("_hits", F.xxhash64(F.lit(w))))).cast("long") for w in common]
        others = F.size("_hashes") - sum(each, F.lit(0))
        counts = F.when(F.col("_lang") == code, F.array(*each, others.cast("long"))).otherwise(counts)
    known_hashes = [F.xxhash64(F.lit(w)) for w in sorted({w for ws in COMMON_WORDS.values() for w in ws})]
    df = df.withColumn("_chars", F.array(*classes))
    df = df.withColumn("_hits", F.filter("_hashes", lambda h: h.isin(*known_hashes)))
    return df.withColumn("_common", counts)


def _references(df: DataFrame, min_words: int) -> DataFrame:
    """At most one row for each language of :data:`COMMON_WORDS` and one for the others: summed histograms of all texts of ``min_words`` and more that pass the base rules."""
    width = len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.get("_chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(width)]
    ref = df.where((F.col("n_words") >= min_words) & ~F.col("base_failed")).groupBy(F.col("_lang").alias("_ref_lang")).agg(*sums)
    return ref.select("_ref_lang", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("_ref_chars"), F.array(*[f"w{i}" for i in range(width)]).alias("_ref_common"))


def _distance(own: str, other: str) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null where one is null or all zero."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + x)
    p = F.transform(own, lambda x: x / F.nullif(total(own), F.lit(0.0)))
    q = F.transform(other, lambda x: x / F.nullif(total(other), F.lit(0.0)))
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: 0.5 * (half(a, b) + half(b, a)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


#: Words in 3-word windows that occur twice or more. Window hashes carry their position in their low bits, so one
#: sort of longs finds the windows with a twin; those few are then compared as strings.
_REPEATS = [
    ("_m", "_n_words - 2"),
    ("_bits", "length(bin(greatest(_m, 1L)))"),
    ("_mask", "shiftleft(1L, _bits) - 1L"),
    ("_sorted", "CASE WHEN _m >= 2 THEN sort_array(transform(sequence(0, int(_m) - 1), i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & ~_mask) | i)) END"),
    ("_twins", "filter(_sorted, (x, i) -> shiftright(x, _bits) <=> shiftright(get(_sorted, i - 1), _bits) OR shiftright(x, _bits) <=> shiftright(get(_sorted, i + 1), _bits))"),
    ("_named", "CASE WHEN size(_twins) > 0 THEN sort_array(transform(transform(_twins, x -> int(x & _mask)), p -> struct(concat_ws(' ', _words[p], _words[p + 1], _words[p + 2]) AS w, p AS p))) END"),
    ("_at", "sort_array(transform(filter(_named, (x, i) -> x.w <=> get(_named, i - 1).w OR x.w <=> get(_named, i + 1).w), x -> x.p))"),
    ("_n_repeat", "coalesce(aggregate(transform(_at, (p, i) -> least(3, coalesce(get(_at, i + 1), p + 3) - p)), 0L, (a, x) -> a + x), 0L)"),
]


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    guard_words: int = 100,
    max_char_distance: float = 0.28,
    max_word_distance: float = 0.3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of ``docs`` (of ``carry`` columns, all by default) as the struct ``row``, and its verdict as the struct ``quality``.

    quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.
    base_failed: under ``min_words`` words, or more than ``max_repeat_percent`` percent of them in repeated 3-word windows.
    kept: base passed and neither distance above its threshold. The guard: texts of under ``guard_words`` words are not
    judged by their histograms (short texts stray by chance), nor are words where a language has no list. A value that equals its threshold passes.

    A null text is empty: it has no words and fails the base rules. A null or unknown language uses the reference of all such texts.
    Rows are judged one by one, so repeated rows get equal verdicts; an empty table gives an empty result; other columns of any name stay in ``row``.
    """
    kept_columns = [F.col(f"`{c}`") for c in carry or docs.columns]
    packed = docs.select(F.struct(*kept_columns).alias("row"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    df = _histograms(packed, F.col("_text"), F.col("_lang"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = df.withColumn("_lines", lines)
    for name, expression in _REPEATS:
        df = df.withColumn(name, F.expr(expression))
    counted = df.select(
        "row",
        "_lang",
        "_chars",
        "_common",
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_n_repeat").alias("n_repeat_words"),
        ((F.col("_n_words") < min_words) | (100 * F.col("_n_repeat") > max_repeat_percent * F.col("_n_words"))).alias("base_failed"),
    )
    counted, _ = materialize(counted, "quality")  # the references need all rows first; each text is counted once
    refs = _references(counted, guard_words)
    judged = counted.join(F.broadcast(refs), F.col("_lang") == F.col("_ref_lang"), "left")  # one row a language of a fixed list
    judged = judged.withColumns({"char_distance": _distance("_chars", "_ref_chars"), "word_distance": _distance("_common", "_ref_common")})
    judged = judged.drop("_lang", "_chars", "_common", "_ref_lang", "_ref_chars", "_ref_common")
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    kept = ~F.col("base_failed") & ~((F.col("n_words") >= guard_words) & far)
    names = [c for c in judged.columns if c != "row"]
    return judged.withColumn("kept", kept).select("row", F.struct(*names, "kept").alias("quality"))
