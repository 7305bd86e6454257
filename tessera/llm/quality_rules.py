"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Everything here is DataFrame expressions; no Python runs on executors. Words, word windows and n-grams are arrays in
the row, so scoring shuffles nothing. The two multinomials over a fixed number of hash buckets are one grouped count
over all documents; the table of bucket weights has a fixed size and reaches the scoring projection as a scalar
subquery.

The arrays of a text take some eighty times its bytes. Texts of more than ``LONG_BYTES`` are therefore cut into pieces
that end where a word does, and counted in full by grouped aggregates over pieces, lines and windows. A corpus without
such a text is planned without any of this, for one scan that looks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, bounded_broadcast, drop, text_or_empty, written

BUCKETS = 1 << 15
#: Pseudo-occurrences that every bucket of either multinomial starts with, spread as the raw corpus spreads.
SMOOTHING = 16.0
#: Mean log-ratio per n-gram (nats) from which a document is kept.
THRESHOLD = -0.09
MIN_WORDS = 50
#: Bytes from which on a text is counted by pieces, and the characters of a piece: it goes on to the end of its last word.
LONG_BYTES = 1 << 20
PIECE = 1 << 15


def words(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), SPACE_CLASS + "+", -1), lambda w: w != "")


def _windows(n: Column, size: int, each) -> Column:
    """One value for each run of ``size`` words; ``n`` is the number of words."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), each))


def _grams(w: Column, n: Column, buckets: int, more: Column | None = None) -> Column:
    """Buckets of the words and of the pairs that begin in ``w``; ``more`` is ``w`` and the words that follow it."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    ones = F.transform(w, lambda x: bucket(x))
    of, number = (w, n) if more is None else (more, F.least(n + 1, F.size(more)))
    twos = _windows(number, 2, lambda i: bucket(F.get(of, i), F.get(of, i + 1)))
    return F.concat(ones, F.coalesce(twos, F.array().cast("array<int>")))


def gram_weights(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, smoothing: float = SMOOTHING, parts: DataFrame | None = None) -> DataFrame:
    """One row, one array: for each bucket log(p_target / p_raw).

    Both multinomials are smoothed towards the raw corpus by ``smoothing`` expected target occurrences a bucket, so a
    bucket that is seen too seldom to tell counts as 0: log((hits + s) / (expected hits + s)).

    ``docs`` is the raw corpus, all of it but texts that ``parts`` has by pieces (:func:`_parts`); its rows whose id is
    in ``target_ids`` are the target. With an empty target every weight is 0, so the ratio rejects nothing.
    """
    ids = bounded_broadcast(target_ids.select(F.col(target_ids.columns[0]).alias("_t")).where("_t is not null").distinct())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, F.col("_id") == F.col("_t"), "left")
    rows = rows.select(F.col("_t").isNotNull().cast("bigint").alias("_hit"), words(F.col("_text")).alias("_w"))
    grams = rows.select("_hit", F.explode(_grams(F.col("_w"), F.size("_w"), buckets)).alias("bucket"))
    if parts is not None:
        split = _with_words(parts.join(ids, F.col("_id") == F.col("_t"), "left").withColumn("_hit", F.col("_t").isNotNull().cast("bigint")))
        grams = grams.unionByName(split.select("_hit", F.explode(_grams(F.col("_words"), F.size("_words"), buckets, F.col("_more"))).alias("bucket")))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_hit").alias("hit"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("hit", F.lit(0)).alias("hit"))
    # at most `buckets` rows meet here, whatever the corpus
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "hit"))).alias("t"), F.sum("raw").alias("r"), F.sum("hit").alias("h"))
    ratio = lambda x: F.log((x["hit"] + smoothing) / (x["raw"] * F.col("h") / F.col("r") + smoothing))
    return one.select(F.when(F.col("h") > 0, F.transform("t", ratio)).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    ``n_repeat_words`` counts the words that lie in a 3-word window which occurs twice or more in the text, the first
    occurrence included and each word once. Null is an empty text: all counts 0, and the base rules fail it.
    """
    text = text_or_empty(F.col(text_col))
    w, n = F.col("_words"), F.col("n_words")
    out = docs.withColumn("_words", words(F.col(text_col))).withColumn("n_words", F.size("_words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumns({
        "word_chars": F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        "_lines": lines,
        "_hashes": _windows(n, 3, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    })
    # equal windows have equal hashes: without a repeated hash there is no repeated window; else windows are compared as text
    exact = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.array_sort(_windows(n, 3, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("p")))),
    )
    out = out.withColumn("_sorted", exact)
    s = F.col("_sorted")
    twice = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), x["p"]))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(twice, lambda p: p.isNotNull()), lambda p: F.array(p, p + 1, p + 2))))
    out = out.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.when(s.isNotNull(), F.size(covered)).otherwise(0).cast("bigint"),
    }).drop("_lines", "_hashes", "_sorted")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    return out.withColumn("base_failed", failed)


def quality_rules(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the rule counts, ``base_failed``, ``llr`` and ``kept`` for every row of ``docs``.

    ``llr`` is the mean over a text's word unigrams and bigrams of log(p_target / p_raw); ``kept`` is
    ``llr >= threshold`` where the base rules pass. Texts without words have llr 0 and fail the base rules. Rows that
    repeat, null ids and extra columns are fine: every row is scored for itself.
    """
    return _judged(docs, target_ids, id_col, text_col, buckets, threshold).drop("_row")


def keep_passing(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns."""
    return _judged(docs, target_ids, id_col, text_col, buckets, threshold).where("kept").select("_row.*")


def _long_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``_rid, _id, _row`` of the rows whose text is long, as a written table; None if there are none."""
    size = F.octet_length(text_or_empty(F.col(text_col)))
    if (docs.agg(F.max(size)).first()[0] or 0) <= LONG_BYTES:
        return None
    return written(docs.where(size > LONG_BYTES).select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row")), "long")


def _parts(texts: DataFrame) -> DataFrame:
    """``_rid, _id, _no, _piece, _at, _next`` for each piece with a word of ``texts(_rid, _id, _text)``, as a written
    table: the words before it in its text, and the two that follow it or what there is of them."""
    # possessive: matched in a loop, whatever the characters
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}+[^\\x20\\x09-\\x0D]*+"), F.lit(0))
    w = words(F.col("_piece"))
    pieces = texts.select("_rid", "_id", F.posexplode(cut).alias("_no", "_piece"))
    pieces = written(pieces.select("*", F.size(w).cast("bigint").alias("_n"), F.slice(w, 1, 2).alias("_head")).where("_n > 0"), "pieces")
    order, none = Window.partitionBy("_rid").orderBy("_no"), F.array().cast("array<string>")
    ahead = lambda k: F.coalesce(F.lead("_head", k).over(order), none)
    heads = pieces.select("_rid", "_no", "_n", "_head")
    near = heads.select("_rid", "_no", F.slice(F.concat(ahead(1), ahead(2)), 1, 2).alias("_next"), (F.sum("_n").over(order) - F.col("_n")).alias("_at"))
    parts = written(pieces.join(near, ["_rid", "_no"]).select("_rid", "_id", "_no", "_piece", "_at", "_next"), "parts")
    drop(pieces)
    return parts


def _with_words(parts: DataFrame) -> DataFrame:
    """``parts`` with the words of the piece and, in a column of its own as functions look into it for each word, these
    and the next two."""
    return parts.withColumn("_words", words(F.col("_piece"))).withColumn("_more", F.concat("_words", "_next"))


def _long_counts(texts: DataFrame, parts: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """A row for each of ``texts(_rid, _id, _text)`` that has a word, as a written table: ``_rid``, the counts and the ratio."""
    piece, w, more, split = F.col("_piece"), F.col("_words"), F.col("_more"), _with_words(parts)
    each = split.withColumn("_grams", _grams(w, F.size(w), buckets, more)).withColumn("_weights", weights.scalar())
    each = each.select(
        "_rid", "_no", F.size(w).alias("n"), F.size("_grams").alias("grams"),
        F.length(F.regexp_replace(piece, SPACE_CLASS + "+", "")).alias("chars"),
        (F.length(piece) - F.length(F.translate(piece, "#*$%&|<>", ""))).alias("symbols"),
        F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.get(F.col("_weights"), g)).alias("ratio"),
    )
    # sums of doubles in the order of the pieces, so that every run gives the same
    ratio = F.aggregate(F.array_sort(F.collect_list(F.struct("_no", "ratio"))), F.lit(0.0), lambda a, x: a + x["ratio"])
    out = each.groupBy("_rid").agg(F.sum("n").alias("n_words"), F.sum("chars").alias("word_chars"), F.sum("symbols").alias("n_symbols"), (ratio / F.sum("grams")).alias("llr"))

    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}+[^\\n]*+\\n?"), F.lit(0))
    lines = texts.select("_rid", F.explode(cut).alias("_piece")).select("_rid", F.explode(F.split("_piece", "\n", -1)).alias("_line"))
    lines = lines.where(F.col("_line").rlike("[^\\x20\\x09-\\x0D]")).groupBy("_rid", "_line").count()
    out = out.join(lines.groupBy("_rid").agg(F.sum(F.col("count") - 1).alias("n_dup_lines")), "_rid", "left")

    threes = _windows(F.least(F.size(w) + 2, F.size(more)), 3, lambda i: F.concat_ws(" ", F.get(more, i), F.get(more, i + 1), F.get(more, i + 2)))
    found = split.select("_rid", "_at", F.posexplode(threes).alias("_i", "_k")).select("_rid", (F.col("_at") + F.col("_i")).alias("_p"), "_k")
    twice = written(found.groupBy("_rid", "_k").count().where("count > 1").select("_rid", "_k"), "repeated")
    covered = found.join(twice, ["_rid", "_k"], "left_semi").select("_rid", F.explode(F.array(F.col("_p"), F.col("_p") + 1, F.col("_p") + 2)).alias("_p")).distinct()
    out = out.join(covered.groupBy("_rid").agg(F.count("*").alias("n_repeat_words")), "_rid", "left").fillna(0, ["n_dup_lines", "n_repeat_words"])
    counts = written(out, "long-counts")
    drop(twice)
    return counts


def _judged(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str, buckets: int, threshold: float) -> DataFrame:
    long = _long_rows(docs, id_col, text_col)
    if long is None:
        return _judged_in_rows(docs, gram_weights(docs, target_ids, id_col, text_col, buckets), id_col, text_col, buckets, threshold)
    texts = long.select("_rid", "_id", F.col("_row")[text_col].cast("string").alias("_text"))
    short, parts = docs.where(F.octet_length(text_or_empty(F.col(text_col))) <= LONG_BYTES), _parts(texts)
    weights = written(gram_weights(short, target_ids, id_col, text_col, buckets, parts=parts), "weights")
    counts = _long_counts(texts, parts, weights, buckets)
    drop(parts)
    rows = long.join(bounded_broadcast(counts), "_rid", "left").fillna(0, counts.columns[1:])
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).withColumnRenamed("_id", "doc_id")
    out = _judged_in_rows(short, weights, id_col, text_col, buckets, threshold)
    return out.unionByName(rows.select(*out.columns))


def _judged_in_rows(docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, buckets: int, threshold: float) -> DataFrame:
    rows = rule_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("_row")), "_text")
    rows = rows.withColumn("_grams", _grams(F.col("_words"), F.col("n_words"), buckets)).withColumn("_weights", weights.scalar())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.get(F.col("_weights"), g))
    rows = rows.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0))
    out = rows.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr", "_row",
    )
    # a generator, so that no filter on the result is pushed below the arrays and repeats their expressions for each element
    return out.select(F.inline(F.array(F.struct(*out.columns))))
