"""Words run together: where they stand in JSON documents, and how they split.

`json_texts` walks JSON of any shape as VARIANT values, one level a round, and gives every string with its JSON path. `splits` looks for runs of
lower-case letters that are better read as several words: word frequencies are learned from the corpus itself, a run's
substrings meet the vocabulary where they are made, a bounded slice of it at a time, so that only substrings that are words ever move, and a Viterbi pass over their log probabilities, in one expression, finds the best reading of two
or more words; a run is suspected where that is likelier than the run as a word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.sources.sinks import stored

#: Fields whose strings are names of files and links, and the least length of a run.
SKIPPED, LEAST = ("source_document", "source_urls", "image_path"), 12
#: Shortest word of a split but for `a` and `i`, longest, and how often the corpus must hold it.
SHORTEST, LONGEST, LEAST_COUNT = 2, 24, 3
#: Words of the vocabulary that go to the tasks at once, and runs of a task, about.
MOST_WORDS, MOST_RUNS = 500_000, 100_000


def json_texts(docs: DataFrame, json: str, key: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(key, path, text) of every string in the JSON texts of docs; fields named in skipped are left out with all below them.

    Text that is no JSON gives nothing. Each round opens the objects and arrays of one level, so there are as many as the deepest text has levels.
    """
    spark = docs.sparkSession
    parsed = docs.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v IS NOT NULL")
    level, found = parsed, []
    while True:
        kind = F.schema_of_variant("v")
        found.append(level.filter(kind == "STRING").select("key", "path", F.variant_get("v", "$", "string").alias("text")))
        inner = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("field"), F.col("value").alias("w")))
        kept = opened.filter(F.col("field").isNull() | ~F.col("field").isin(*skipped))
        step = F.when(F.col("field").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "field"))
        level = stored(kept.select("key", F.concat("path", step).alias("path"), F.col("w").alias("v")), "level")
        if not level.limit(1).count():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("key", key)


def runs(texts: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """texts once for each run of `least` or more lower-case letters, with run; a run stands between characters that are no ASCII letters or digits."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![A-Za-z0-9])([a-z]{{{least},}})(?![A-Za-z0-9])"), F.lit(1))
    return texts.withColumn("run", F.explode(found))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, share): words of a to z with their count and share of all such words."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("n"))
    words = stored(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 1
    return words.withColumn("share", F.col("n") / F.lit(total))


def _best(edges: str, length: Column) -> Column:
    """Best way from 0 to length over edges (i, j, word, lp): struct of score, number of words, words; its score is null where there is none."""
    nothing = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).alias("n"), F.lit("").alias("words"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.lit("").alias("words")))

    def step(state: Column, j: Column) -> Column:
        def reached(e: Column) -> Column:
            before = F.get(state, e["i"])
            return F.struct((before["score"] + e["lp"]).alias("score"), (before["n"] + 1).alias("n"), F.concat(before["words"], F.when(before["n"] > 0, " ").otherwise(""), e["word"]).alias("words"))

        into = F.filter(F.transform(F.filter(edges, lambda e: e["j"] == j), reached), lambda c: c["score"].isNotNull())
        return F.concat(state, F.array(F.coalesce(F.array_max(into), nothing)))

    return F.get(F.aggregate(F.sequence(F.lit(1), length), start, step), length)


def splits(found: DataFrame, words: DataFrame, protected: DataFrame | None = None, most_words: int = MOST_WORDS, most_runs: int = MOST_RUNS) -> DataFrame:
    """(run, n, suggested_split, score) of the different runs of found (from `runs`) that read better as several words; n is how often a run stands there.

    words: (word, n, share) from `vocabulary`. score is the log of how much likelier the split is. Runs that are words of a
    protected name (name) stay whole. Equal scores go to more words, then to the words greatest in order.
    """
    held = found.groupBy("run").agg(F.count("*").alias("n"))
    if protected is not None:
        names = protected.select(F.explode(tokens(F.col("name"))).alias("run")).distinct()
        held = held.join(names, "run", "left_anti")
    held = stored(held, "runs")
    size = F.length("run")
    spread = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // most_runs))
    begins = held.select("run").repartition(spread, "run").select("run", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    ends = begins.select("run", "size", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("size"), F.col("i") + LONGEST))).alias("j")).filter("NOT (i = 0 AND j = size)")
    parts = ends.select("run", "i", "j", F.expr("substring(run, i + 1, j - i)").alias("word"))
    known = words.filter((F.col("n") >= LEAST_COUNT) & ((F.length("word") >= SHORTEST) | F.col("word").isin("a", "i")) & (F.length("word") <= LONGEST))
    known = known.select("word", F.log("share").alias("lp"))
    slices = -(-known.count() // most_words) or 1

    def met(n: int) -> DataFrame:
        own = F.pmod(F.xxhash64("word"), F.lit(slices)) == n
        return parts.filter(own).join(F.broadcast(known.filter(own)), "word").select("run", F.struct("i", "j", "lp").alias("edge"))

    # Several slices are met one after another, so a task holds one of them at a time.
    edges = met(0) if slices == 1 else stored(met(0), "edges")
    for n in range(1, slices):
        edges = edges.unionByName(stored(met(n), "edges"))
    edges = edges.groupBy("run").agg(F.collect_list("edge").alias("edges"))
    edges = edges.withColumn("edges", F.expr("transform(edges, e -> struct(e.i, e.j, substring(run, e.i + 1, e.j - e.i) AS word, e.lp))"))
    whole = words.select(F.col("word").alias("run"), F.log("share").alias("own"))
    total = words.agg(F.sum("n")).first()[0] or 1
    best = held.join(edges, "run").join(whole, "run", "left").withColumn("b", _best("edges", F.length("run")))
    # A word that the corpus lacks is the less likely the longer it is, tenfold a letter.
    unseen = F.lit(-math.log(total)) - (F.length("run") - 1) * F.lit(math.log(10))
    score = F.round(F.col("b.score") - F.coalesce("own", unseen), 6)
    return best.filter("b.score IS NOT NULL").select("run", "n", F.col("b.words").alias("suggested_split"), score.alias("score")).filter("score > 0")
