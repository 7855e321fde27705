"""Quality rules (2) [native]: adaptive thresholds per language and source.

Each document gets a few integer measures.  A *log-linear histogram* of each
measure (six leading bits of the value: relative error of 1/32 at most) is
counted per (language, source); such histograms are quantile sketches that
merge by adding counts, so the same table rolls up to the language and to
the corpus, and gives the same result in any order and on any partitioning.
A group's sketch is merged with those of its language and of the corpus, each
weighing as much as ``PRIOR`` documents, so a small group leans on them and a
large one on itself, without a step between the two.

The upper limit of a measure is ``q75 + REACH * (q75 - q25)``.  A document has a
resolution of its own: in 30 words one symbol is 33 thousandths.  So it is rejected
if it is above the limit, by a thousandth (the unit of the sketches) or more, even
without ``REACH`` events (symbols, repeated lines, stuttered words, lines seen twice).  The mean word length has a lower limit, too,
and its spread widens for documents shorter than the group's median as the error of
a mean does.  No limit and no spread is a constant.  Documents are joined with the
limits of their group, and a document outside any of them is rejected.

Only DataFrame expressions run here.  The texts are scanned once; what is
joined is a table with a row per (language, source), whose true size the
planner knows.  A document's words stay in its own row.

Defined cases: null text counts as empty (no words, so it fails the base
rule); null language or source counts as the empty string; repeated rows are
judged one by one; an empty table gives an empty result; other columns of
any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverlake.llm.common import free_name, read, stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

RATES = {
    # name: (count, out of, size of one event)
    "symbols": ("n_symbols", "n_words", "1"),
    "dup_lines": ("n_dup_lines", "n_lines", "1"),
    "repeats": ("n_repeat_words", "n_words", "2 * greatest(5, n_words div n_lines)"),
    "stutters": ("n_stutters", "n_words", "1"),
}
VALUES = {**{m: f"1000 * {x} div nullif({d}, 0)" for m, (x, d, _) in RATES.items()},
          "word_length": "100 * word_chars div nullif(n_words, 0)", "length": "n_words"}
REACH = 3
PRIOR = 50


def base_counts(df: DataFrame, text: Column, out: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and a struct column ``out``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_stutters (words equal to the one
    before), all long, of the whole text.

    Each step is a projection of its own, so that nothing is evaluated
    twice.  Windows are compared by a 64-bit hash; only texts in which two
    windows agree are sorted to find the words that repeated windows cover."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    t = df.select(row, F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    t = t.select("row", F.array_remove(F.split("t", SPACE), "").alias("words"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    t = t.select("row", F.size("words").alias("n"), F.array_join("words", "").alias("chars"),
                 F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup"),
                 F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    gram = F.transform(F.slice("h", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]))
    stutter = F.size(F.filter("h", lambda x, i: x == F.get("h", i - 1)))
    t = t.select("row", "n", "n_lines", "dup", F.length("chars").alias("word_chars"), stutter.alias("stutter"),
                 (F.length("chars") - F.length(F.regexp_replace("chars", SYMBOLS, ""))).alias("symbols"), gram.alias("g"))
    again = F.size(F.array_distinct("g")) < F.size("g")
    t = t.withColumn("s", F.when(again, F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twin = F.filter("s", lambda x, k: F.coalesce(x.g == F.get("s", k - 1).g, F.lit(False))
                    | F.coalesce(x.g == F.get("s", k + 1).g, F.lit(False)))
    t = t.withColumn("p", F.sort_array(F.transform(twin, lambda x: x.i)))
    covered = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW))))
    repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))
    counts = {"n_words": F.col("n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("symbols"),
              "n_dup_lines": F.col("dup"), "n_repeat_words": repeat, "n_lines": F.col("n_lines"), "n_stutters": F.col("stutter")}
    return t.select("row.*", F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()]).alias(out))


def failed(c: Column) -> Column:
    """The base rule: too few words, or too many in repeated windows."""
    return (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)


def bucket(value: Column) -> Column:
    """Lowest value of the log-linear bucket: the six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def top(value: Column) -> Column:
    """Highest value of the bucket that begins at ``value``."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return value + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, rows: the mergeable sketches of the
    documents that pass the base rule."""
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("rows"))


def merged(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, measure, bucket, weight: each group's sketch merged with
    ``prior`` documents' worth of its language's and of the corpus's.  Weights are
    whole numbers: all shares are brought to the denominator (rows of the language
    x rows of the corpus)."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    keys = ["lang", "source", "measure"]

    def level(by):
        rows = sketch.groupBy(*by, "bucket").agg(F.sum("rows").alias("rows"))
        return rows, rows.groupBy(*by).agg(F.sum("rows").alias("n"))

    by_lang, lang_n = level(["lang", "measure"])
    every, every_n = level(["measure"])
    sizes = (sketch.select(*keys).distinct().join(lang_n.withColumnRenamed("n", "ln"), ["lang", "measure"])
             .join(every_n.withColumnRenamed("n", "en"), "measure"))
    own = sketch.join(sizes, keys).select(*keys, "bucket", (big("rows") * big("ln") * big("en")).alias("weight"))
    tongue = sizes.join(by_lang, ["lang", "measure"]).select(*keys, "bucket", (big("rows") * prior * big("en")).alias("weight"))
    corpus = sizes.join(every, "measure").select(*keys, "bucket", (big("rows") * prior * big("ln")).alias("weight"))
    return own.unionByName(tongue).unionByName(corpus).groupBy(*keys, "bucket").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))


def quantiles(weighted: DataFrame) -> DataFrame:
    """lang, source, measure, q25, q50, q75 of the merged sketches: the lowest value
    of the bucket that holds the quantile, for q75 the highest one."""
    by = W.partitionBy("lang", "source", "measure")              # a bounded number of buckets
    upto = weighted.select("*", F.sum("weight").over(by.orderBy("bucket")).cast("decimal(38,0)").alias("upto"),
                           F.sum("weight").over(by).cast("decimal(38,0)").alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    return upto.groupBy("lang", "source", "measure").agg(at(1).alias("q25"), at(2).alias("q50"), top(at(3)).alias("q75"))


def limits(sketch: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """lang, source, hi_ of each rate, q25_, q75_ and spread_word_length, q50_length: one row per group."""
    q = quantiles(merged(sketch, prior))
    mine = lambda name, c: F.max(F.when(F.col("measure") == name, c))
    spread = reach * (F.col("q75") - F.col("q25"))
    return q.groupBy("lang", "source").agg(
        *[mine(m, F.col("q75") + spread).alias(f"hi_{m}") for m in RATES],
        mine("word_length", F.col("q25")).alias("q25_word_length"), mine("word_length", F.col("q75")).alias("q75_word_length"),
        mine("word_length", spread).alias("spread_word_length"), mine("length", F.col("q50")).alias("q50_length"))


def fine(reach: int = REACH) -> str:
    """The condition of a document within its group's limits, in SQL."""
    rules = [f"1000 * ({x} - {reach} * {event}) < (hi_{m} + 1) * {d}" for m, (x, d, event) in RATES.items()]
    length = VALUES["word_length"]
    slack = f"spread_word_length * greatest(CAST(1 AS DOUBLE), sqrt(q50_length / n_words)) + {reach} * ({length}) / n_words"
    return " AND ".join([*rules, f"({length}) <= q75_word_length + {slack}", f"({length}) >= q25_word_length - ({slack})"])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          prior: int = PRIOR, reach: int = REACH, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` (all if None; language and source
    must be among them) with a struct column of counts, ``base_failed`` and
    ``kept``, and that column's name (one that ``docs`` does not have)."""
    keep = keep or docs.columns
    name = free_name(docs, "quality")
    counted = stored(base_counts(docs, F.col(f"`{text_col}`"), name, keep), "quality-counts")
    c = F.col(name)
    keys = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(a) for k, a in ((lang_col, "lang"), (source_col, "source"))]
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.expr(v)).alias("bucket")) for m, v in VALUES.items()]))
    rows = (counted.filter(~failed(c)).select(*keys, f"{name}.*")
            .select("lang", "source", measures.alias("m")).select("lang", "source", "m.*"))
    bounds = stored(limits(stored(sketches(rows), "quality-sketches"), prior, reach), "quality-limits")
    row = counted.select(F.struct(*[F.col(f"`{x}`") for x in keep]).alias("row"), c.alias("c"), *keys)
    row = row.join(bounds, ["lang", "source"], "left").select("row", "c", "c.*", *[x for x in bounds.columns if x not in ("lang", "source")])
    row = row.withColumn("base_failed", failed(F.col("c")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.expr(fine(reach)), F.lit(False)))
    out = row.select("row.*", F.struct("c.*", "base_failed", kept.alias("kept")).alias(name))
    return out, name


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns they had."""
    judged, name = judge(docs, **options)
    return judged.filter(F.col(name).kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = judge(read(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return judged.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_PASSED = " UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS measure, {v.replace('div', '//')} AS v FROM counts WHERE NOT base_failed" for m, v in VALUES.items())
_LIMIT = ", ".join([f"max(CASE WHEN measure = '{m}' THEN q75 + {REACH} * (q75 - q25) END) AS hi_{m}" for m in RATES] + [
    "max(CASE WHEN measure = 'word_length' THEN q25 END) AS q25_word_length", "max(CASE WHEN measure = 'word_length' THEN q75 END) AS q75_word_length",
    f"max(CASE WHEN measure = 'word_length' THEN {REACH} * (q75 - q25) END) AS spread_word_length",
    "max(CASE WHEN measure = 'length' THEN q50 END) AS q50_length"])

QUALITY_CTES = f"""
split_docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows5 AS (
  SELECT doc_id, i, words[i:i + 4] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split_docs)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows5) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(array_to_string(words, '')) - length(regexp_replace(array_to_string(words, ''), '{SYMBOLS}', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM split_docs LEFT JOIN covered c USING (doc_id)),
counts AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
valued AS ({_PASSED}),
bucketed AS (
  SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b FROM valued),
own AS (SELECT lang, source, measure, b, count(*)::HUGEINT AS n FROM bucketed GROUP BY ALL),
tongue AS (SELECT lang, measure, b, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
corpus AS (SELECT measure, b, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
sizes AS (SELECT DISTINCT o.lang, o.source, o.measure, l.n AS ln, e.n AS en FROM own o
          JOIN (SELECT lang, measure, sum(n)::HUGEINT AS n FROM tongue GROUP BY ALL) l USING (lang, measure)
          JOIN (SELECT measure, sum(n)::HUGEINT AS n FROM corpus GROUP BY ALL) e USING (measure)),
weighted AS (SELECT lang, source, measure, b, sum(w)::HUGEINT AS w FROM (
  SELECT s.lang, s.source, s.measure, b, n*ln*en AS w FROM own JOIN sizes s USING (lang, source, measure)
  UNION ALL SELECT s.lang, s.source, s.measure, b, n*{PRIOR}*en FROM sizes s JOIN tongue USING (lang, measure)
  UNION ALL SELECT s.lang, s.source, s.measure, b, n*{PRIOR}*ln FROM sizes s JOIN corpus USING (measure)) GROUP BY ALL),
upto AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY b) AS u, sum(w) OVER (PARTITION BY lang, source, measure) AS t FROM weighted),
used AS (SELECT lang, source, measure, min(CASE WHEN 4*u >= t THEN b END) AS q25, min(CASE WHEN 4*u >= 2*t THEN b END) AS q50,
                min(CASE WHEN 4*u >= 3*t THEN b + (1 << greatest(length(bin(b)) - 6, 0)) - 1 END) AS q75 FROM upto GROUP BY ALL),
bounds AS (SELECT lang, source, {_LIMIT} FROM used GROUP BY lang, source),
judged AS (
  SELECT counts.*, CASE WHEN base_failed THEN false ELSE coalesce({fine().replace('div', '//')}, false) END AS kept
  FROM counts LEFT JOIN bounds USING (lang, source))
"""
QUALITY_SQL = f"""WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
