"""Retrieval metrics, question matching, judge replies and scorecards, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN

# Words that tell no service, where a reply's metadata begins, score and pass mark.
COMMON_WORDS = ["amazon", "aws", "service", "services"]
CUTOFFS = ["', 'extras'", "', 'extras", '"extras"', "}, {", "'}]", '"}]']
PASS_MARK = 0.85
METRICS = ["mrr", "ndcg_at_5", "context_precision", "context_recall", "faithfulness", "answer_correctness"]


def service_matches(retrieved: Column, expected: Column) -> Column:
    """Whether one name holds the other, or the retrieved name holds a telling word of the expected one."""
    r, e = F.lower(F.btrim(retrieved)), F.lower(F.btrim(expected))
    words = F.filter(F.split(e, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(COMMON_WORDS))
    return F.coalesce((r != "") & (e != "") & (r.contains(e) | e.contains(r) | F.exists(words, lambda w: r.contains(w))), F.lit(False))


def first_match_metrics(hits: DataFrame, queries: DataFrame, digits: int = 4, k: int = 5) -> DataFrame:
    """(qid, first_rank, mrr, ndcg_at_5) for every query; no match gives 0, a query that expects nothing 1.

    hits has qid, rank and relevant; queries has qid and expects (boolean).
    """
    best = hits.filter("relevant").groupBy("qid").agg(F.min("rank").alias("first_rank"))
    both = queries.join(best, "qid", "left")
    r = F.col("first_rank")
    mrr = F.when(~F.col("expects"), 1.0).otherwise(F.coalesce(F.bround(1 / r, digits), F.lit(0.0)))
    ndcg = F.when(~F.col("expects"), 1.0).when(r <= k, F.bround(1 / F.log2(r + 1), digits)).otherwise(0.0)
    return both.select("qid", "first_rank", mrr.alias("mrr"), ndcg.alias("ndcg_at_5"))


def id_matches(retrieved: Column, expected: Column) -> Column:
    """Whether an id is among the expected ones, but for case and blanks at the ends."""
    return F.array_contains(F.transform(expected, lambda x: F.lower(F.btrim(x))), F.lower(F.btrim(retrieved)))


def judged(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with score (0 to 1), reason and status.

    What follows the first metadata mark goes; the score stands after SCORE: or is the first such number. A reply without a
    number has no score and status `unparsed`: it must not pass for a good one.
    """
    text = F.btrim(F.col(reply))
    at = F.lit(0)
    for mark in reversed(CUTOFFS):
        place = F.instr(text, mark)
        at = F.when(place > 1, place).otherwise(at)
    text = F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), at - 1), "[',\" ]+$", "")).otherwise(text)
    number = r"([0-1]\.\d+|0|1)"
    named = F.regexp_extract(text, rf"(?i)SCORE:\s*{number}", 1)
    score = F.nullif(F.when(named != "", named).otherwise(F.regexp_extract(text, number, 1)), F.lit("")).cast("double")
    score = F.when(score.isNotNull(), F.bround(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2))
    reason = F.regexp_replace(F.btrim(F.nullif(F.regexp_extract(text, r"(?i)REASON:\s*(.+)", 1), F.lit(""))), "[.',\"]+$", "")
    reason = F.when(F.length(reason) > 120, F.concat(F.substring(reason, 1, 117), F.lit("..."))).otherwise(reason)
    return replies.withColumn("score", score).withColumn("reason", reason).withColumn("status", F.when(score.isNull(), "unparsed").otherwise("parsed"))


def judged_metrics(replies: DataFrame) -> DataFrame:
    """(qid, the four judged metrics and their <metric>_reason) from (qid, metric, reply); a reply without a score leaves its metric null."""
    own = METRICS[2:]
    parsed = judged(replies)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return parsed.groupBy("qid").agg(*(pick(m, "score").alias(m) for m in own), *(pick(m, "reason").alias(f"{m}_reason") for m in own))


def six_metrics(questions: DataFrame, ranked: DataFrame, replies: DataFrame) -> DataFrame:
    """questions (qid, expects) with all six metrics and verdict; ranked has qid, rank and relevant."""
    found = first_match_metrics(ranked, questions)
    return scored(questions.drop("expects").join(found, "qid").join(judged_metrics(replies), "qid", "left"))


def scored(metrics: DataFrame) -> DataFrame:
    """metrics with verdict: PASSED where all six reach the mark, else PARTIAL PASS."""
    least = F.least(*(F.coalesce(F.col(m), F.lit(0.0)) for m in METRICS))
    return metrics.withColumn("verdict", F.when(least >= PASS_MARK, "PASSED").otherwise("PARTIAL PASS"))


def scorecard(metrics: DataFrame) -> DataFrame:
    """One row: n, the mean of each metric, the mean of the unrounded means, and the verdict; 0 without questions."""
    means = metrics.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))
    overall = sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0])) / len(METRICS)
    verdict = F.when(F.bround(overall, 4) >= PASS_MARK, "PASSED").otherwise("NEEDS IMPROVEMENT")
    return means.select("n", *(F.bround(m, 4).alias(m) for m in METRICS), F.bround(overall, 4).alias("overall"), verdict.alias("verdict"))


def scorecard_text(card: DataFrame) -> DataFrame:
    """The scorecard as a block of text."""
    lines = [F.format_string(f"%-22s: %.4f", F.lit(m), F.col(m)) for m in [*METRICS, "overall"]]
    return card.select(F.concat_ws("\n", *lines, F.concat(F.lit("verdict               : "), "verdict")).alias("scorecard"))


def expected_filled(questions: DataFrame, known: DataFrame) -> DataFrame:
    """questions (question, expected_parent_ids) with ids filled in from known where they are missing or empty, by question text but for blanks at the ends."""
    ids = known.select(F.btrim("question").alias("known_question"), "expected_parent_ids").groupBy("known_question").agg(F.min("expected_parent_ids").alias("known_ids"))
    both = questions.join(ids, F.btrim("question") == F.col("known_question"), "left")
    missing = F.coalesce(F.size("expected_parent_ids"), F.lit(-1)) <= 0
    return both.withColumn("expected_parent_ids", F.when(missing, F.coalesce("known_ids", "expected_parent_ids")).otherwise(F.col("expected_parent_ids"))).drop("known_question", "known_ids")


def single_card_text(metrics: DataFrame) -> DataFrame:
    """(qid, card): each question's own scorecard as text, from `six_metrics`: rank of the first hit, scores with their reasons, verdict."""
    notes = {
        "mrr": F.when(F.col("first_rank").isNull(), "nothing relevant found").otherwise(F.concat(F.lit("first relevant at rank "), "first_rank")),
        "ndcg_at_5": F.when(F.col("first_rank") <= 5, "within the first five").otherwise("not within the first five"),
    } | {m: F.coalesce(f"{m}_reason", F.lit("not judged")) for m in METRICS[2:]}
    lines = [F.concat(F.rpad(F.lit(m), 22, " "), F.lit(": "), F.when(F.col(m).isNull(), "-").otherwise(F.format_string("%.2f", m)), F.lit(" ("), F.coalesce(notes[m].cast("string"), F.lit("")), F.lit(")")) for m in METRICS]
    parts = [F.lit("Retrieval"), *lines[:4], F.lit("Generation"), *lines[4:], F.concat(F.lit("verdict: "), "verdict")]
    return metrics.select("qid", F.concat_ws("\n", F.concat(F.lit("question: "), F.col("question")), *parts).alias("card"))


#: Letters of a gram that leads from a text to those that hold it, and from how many on an input counts as part of one.
GRAM = 8


def _grams(c: Column, n: Column | int) -> Column:
    """The different stretches of n letters of c; none where it is shorter."""
    places = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(places, lambda p: F.substring(c, p, n)))).otherwise(F.array().cast("array<string>"))


def _contained(i: DataFrame, t: DataFrame) -> DataFrame:
    """(input_id, no) where one of inp and q holds the other, for inputs of GRAM letters or more; of equal questions the first."""
    i = i.select("input_id", "inp").filter(F.length("inp") >= GRAM)
    t = t.groupBy("q").agg(F.min("no").alias("no"))
    holds = i.withColumn("gram", F.substring("inp", 1, GRAM)).join(t.select("no", "q", F.explode(_grams(F.col("q"), GRAM)).alias("gram")), "gram")
    # A question's first letters lead to the inputs that hold it; a short one is its own gram.
    lead = t.withColumn("gram", F.substring("q", 1, GRAM))
    own = F.array_distinct(F.flatten(F.array(*(_grams(F.col("inp"), n) for n in range(1, GRAM + 1)), F.array(F.lit("")))))
    held = i.withColumn("gram", F.explode(own)).join(lead, "gram")
    both = holds.filter(F.col("q").contains(F.col("inp"))).select("input_id", "no").unionAll(held.filter(F.col("inp").contains(F.col("q"))).select("input_id", "no"))
    return both.distinct()


def _sharing(i: DataFrame, t: DataFrame, least: float = 0.65) -> DataFrame:
    """(input_id, no, iw, qw) of all that share more than `least` of the input's words, and of some that do not: those that share one of its rarest words.

    Of m words more than least * m are shared, so one of the m - floor(least * m) rarest is.
    """
    held = t.select("no", "qw", F.explode("qw").alias("word"))
    known = held.groupBy("word").agg(F.count("*").alias("df"))
    mine = i.select("input_id", F.explode("iw").alias("word")).join(known, "word", "left")
    order = Window.partitionBy("input_id").orderBy(F.coalesce("df", F.lit(0)), "word")
    m = F.count("*").over(Window.partitionBy("input_id"))
    rarest = mine.withColumn("place", F.row_number().over(order)).withColumn("m", m).filter(F.col("place") <= F.col("m") - F.floor(F.col("m") * least)).filter("df IS NOT NULL")
    pairs = rarest.select("input_id", "word").join(held.select("no", "word"), "word").select("input_id", "no").distinct()
    return pairs.join(i.select("input_id", "iw"), "input_id").join(t.select("no", "qw"), "no")


def matched_questions(inputs: DataFrame, truths: DataFrame) -> DataFrame:
    """(input_id, matched_no, how) of each input (input_id, input): its question among truths (no, question_id, question), or null.

    In turn: the same id (but for zeros after the q), the same text, text within text (from 8 characters on), and
    more than 0.65 of the input's words, most words first; equals go to the first.

    Every way is an equi join, whatever the number of questions: text within text through an index of letter grams, words
    through the rarest words of an input, of which a question that shares enough holds one.
    """
    i = inputs.select("input_id", F.lower(F.btrim("input")).alias("inp")).filter("inp <> ''")
    t = truths.select("no", F.lower(F.btrim("question_id")).alias("qid"), F.lower(F.btrim("question")).alias("q"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^q0*(\d+)$", 1), F.lit(""))
    i, t = i.withColumn("num", number("inp")), t.withColumn("qnum", number("qid"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1)))
    i, t = i.withColumn("iw", words("inp")), t.withColumn("qw", words("q"))
    same_id = i.join(t, F.col("inp") == F.col("qid")).unionAll(i.join(t, F.col("num") == F.col("qnum")))
    by_id = same_id.select("input_id", "no", F.lit(1).alias("how"), F.lit(0.0).alias("lack"))
    by_text = i.join(t, F.col("inp") == F.col("q")).select("input_id", "no", F.lit(2).alias("how"), F.lit(0.0).alias("lack"))
    by_part = _contained(i, t).select("input_id", "no", F.lit(3).alias("how"), F.lit(0.0).alias("lack"))
    common = _sharing(i, t).withColumn("share", F.size(F.array_intersect("iw", "qw")) / F.size("iw"))
    by_words = common.filter("share > 0.65").select("input_id", "no", F.lit(4).alias("how"), (1 - F.col("share")).alias("lack"))
    found = by_id.unionAll(by_text).unionAll(by_part).unionAll(by_words)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("input_id").orderBy("how", "lack", "no"))).filter("n = 1")
    return inputs.select("input_id").join(best.select("input_id", F.col("no").alias("matched_no"), "how"), "input_id", "left")
