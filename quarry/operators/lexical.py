"""Lexical search: BM25 over a postings table, and full-text AND search with cover density."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import postings
from quarry.sources.sinks import stored


class Bm25Index:
    """Blocked postings (see `postings`) and term statistics of a corpus, as stored tables.

    `docs` has `key` (a long, one document each) and text; texts are cut into words once. A search reads the blocks of its queries' terms.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        self.rows = stored(postings.build(docs, key, text), "postings")
        self.dead: DataFrame | None = None
        terms, sizes = statistics(self.rows)
        self.frequencies = stored(terms, "terms")
        self.n, self.avgdl = averages(sizes.first())

    def tables(self) -> dict[str, DataFrame]:
        """What `opened` needs to search again without the texts."""
        spark = self.rows.sparkSession
        return {"postings": self.rows, "terms": self.frequencies, "sizes": spark.createDataFrame([(self.n, self.n * float(self.avgdl))], "n long, words double")}

    @classmethod
    def opened(cls, rows: DataFrame, terms: DataFrame, sizes: DataFrame, dead: DataFrame | None = None) -> Bm25Index:
        """An index from its stored tables: postings, (term, df), (n, words), and (block, nos) of the documents that are gone."""
        own = cls.__new__(cls)
        own.rows, own.frequencies, own.dead = rows, terms, dead
        own.n, own.avgdl = averages(sizes.first())
        return own

    def idf(self) -> DataFrame:
        """(term, df, idf); a negative idf is a quarter of the mean over all terms."""
        known = self.frequencies.select("term", "df", (F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean = known.agg(F.avg("idf")).first()[0] or 0.0
        return known.withColumn("idf", F.when(F.col("idf") < 0, F.lit(0.25 * mean)).otherwise(F.col("idf")))

    def search(self, queries: DataFrame, k: int, key: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75, fill: bool = False) -> DataFrame:
        """(qid, doc_id, score, rank) of the k best documents for each query; no score for documents without a term.

        Two passes: each query is scored in the block where its terms' greatest weights promise most, whose k-th score is a
        threshold; then in those other blocks that can reach it. With fill a query with fewer than k such documents gets the least other ids with score 0.
        """
        words = queries.select(F.col(key).alias("qid"), F.explode(tokens(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        asked = stored(words.join(self.idf(), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
        avgdl, groups = float(self.avgdl), postings.query_groups(asked)
        # Both passes read what is asked for, not the whole index again.
        own_heads = stored(postings.heads(self.rows, self.dead), "heads")
        rows = stored(self.rows.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi"), "asked-rows")

        def scored(pairs: DataFrame) -> DataFrame:
            """pairs: (qid, block, edge); documents below a query's edge, if it has one, stay in their block."""

            def run(block: postings.Block, right):
                share = {t: tf * (k1 + 1) / (tf + k1 * (1 - b + b * block.lengths[nos] / avgdl)) for t, (nos, tf, _) in block.terms.items()}
                for qid, terms in grouped(right, "qid", ("term", "weight", "edge")):
                    found = [(block.terms[t][0], w * share[t]) for t, w, _ in terms if t in share]
                    if not found:
                        continue
                    nos, edge = np.concatenate([f[0] for f in found]), terms[0][2]
                    total, held = np.bincount(nos, np.concatenate([f[1] for f in found]), len(block.ids)), np.zeros(len(block.ids), bool)
                    held[nos] = True
                    held &= block.alive
                    if edge is not None:
                        held &= total >= edge - 1e-6
                    at = np.flatnonzero(held)
                    score = np.round(total[at], 6) + 0.0
                    best = postings.best_of(score, score >= (-np.inf if edge is None else edge), k)
                    yield [qid] * len(best), block.ids[at[best]].tolist(), score[best].tolist()

            return postings.cogrouped(rows, own_heads, asked.join(pairs, "qid"), groups, ["nos", "tfs"], run, "qid long, doc_id long, score double")

        most = F.col("top_tf") * (k1 + 1) / (F.col("top_tf") + k1 * (1 - b + b * F.col("least_dl") / F.lit(avgdl)))
        bounds = rows.select("term", "block", most.alias("most")).join(asked, "term")
        bounds = stored(bounds.groupBy("qid", "block").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most")).alias("bound")), "bounds")
        best = bounds.groupBy("qid").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
        first = stored(scored(best.withColumn("edge", F.lit(None).cast("double"))), "hits")
        edge = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("edge")).filter(F.col("n") >= k)
        left = bounds.join(best.withColumnRenamed("block", "best"), "qid").filter("block <> best").join(edge, "qid", "left")
        # A score is rounded to 6 digits, so it may lie a little above its bound.
        left = left.filter(F.col("edge").isNull() | (F.col("bound") + 1e-6 >= F.col("edge"))).select("qid", "block", "edge")
        found = top_k(first.unionByName(scored(left)), k)
        return self._filled(found, queries.select(F.col(key).alias("qid")), own_heads, k) if fill else found

    def _filled(self, found: DataFrame, qids: DataFrame, own_heads: DataFrame, k: int) -> DataFrame:
        found = stored(found, "found")
        lacking = qids.distinct().join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).select("qid")
        alive = own_heads.select(F.explode(F.arrays_zip(F.col("ids"), F.sequence(F.lit(0), F.size("ids") - 1).alias("no"))).alias("d"), "nos")
        # At most k - 1 of the 2 k least ids have a score already.
        least = alive.filter(~F.array_contains("nos", F.col("d.no"))).select(F.col("d.ids").alias("doc_id")).orderBy("doc_id").limit(2 * k)
        more = lacking.crossJoin(F.broadcast(least)).join(found.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        return top_k(found.select("qid", "doc_id", "score").unionByName(more.select("qid", "doc_id", "score")), k)


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, words) of blocks."""
    terms = rows.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    words = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    return terms, rows.filter("term IS NULL").agg(F.sum("df").alias("n"), F.sum(words).cast("double").alias("words"))


def averages(size) -> tuple[int, float]:
    """Number of documents and their mean length, from (n, words)."""
    n, words = size["n"] or 0, size["words"] or 0
    return n, words / max(n, 1) or 1.0


def grouped(table, by: str, columns: tuple[str, ...]):
    """(value of `by`, rows of columns) of the rows of an Arrow table."""
    out: dict = {}
    for q, *row in zip(*(table.column(c).to_pylist() for c in (by, *columns))):
        out.setdefault(q, []).append(row)
    return out.items()


def top_k(scored: DataFrame, k: int | Column, by: str = "qid", id_: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; equal scores in order of id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# English stop words of full-text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now""".split()
)

_VOWEL = "aeiouy"
# Suffix rules of the Porter2 (English Snowball) stemmer.
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
            return i + 1
    return len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-3] not in _VOWEL and word[-2] in _VOWEL and word[-1] not in _VOWEL + "wxY"


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case English word."""
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    word = word.lstrip("'")
    word = ("Y" + word[1:]) if word.startswith("y") else word
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWEL for c in word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), "")
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and any(c in _VOWEL for c in word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            word = word[:-1]
        elif _short(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for suffix, new in _STEP2:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + new
            break
    else:
        if word.endswith("ogi") and word[-4:-3] == "l" and len(word) - 3 >= r1:
            word = word[:-1]
        elif word.endswith("li") and word[-3:-2] and word[-3] in "cdeghkmnrt" and len(word) - 2 >= r1:
            word = word[:-2]
    for suffix, new in _STEP3:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for suffix in _STEP4:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r2:
                word = word[: -len(suffix)]
            break
    else:
        if word.endswith("ion") and word[-4:-3] in ("s", "t") and len(word) - 3 >= r2:
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short(word[:-1])):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.lower()


def lexeme(word: str) -> str | None:
    """The stem of a word; None for a stop word."""
    return None if word in STOP_WORDS else stem(word)


def cover_density(lists: list[list[int]]) -> float:
    """Cover density of the places (a list for each term) of a document's query terms.

    Each shortest stretch that holds all terms adds 1 / (1 + words in it that are no term), times a tenth of the number of terms.
    """
    marked = sorted((p, t) for t, own in enumerate(lists) for p in own)
    need, last, total, begin = len(lists), {}, 0.0, -1
    for p, t in marked:
        last[t] = p
        if len(last) == need:
            first = min(last.values())
            if first > begin:
                begin = first
                total += 0.1 * need / (1 + max(p - first - (need - 1), 0))
    return total


def stems(words: DataFrame) -> DataFrame:
    """(term, lexeme) of the different terms of words, each stemmed once; stop words are left out."""
    found = words.select("term").distinct().withColumn("lexeme", F.pandas_udf(lambda s: s.map(lexeme), "string")("term"))
    return found.filter(F.col("lexeme").isNotNull())


class FulltextIndex:
    """Blocked postings of stems with their places, as a stored table; stop words are left out but count as places."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        self.rows, self.dead = stored(postings.build(docs, key, text, lexeme, True), "lexemes"), None

    @classmethod
    def opened(cls, rows: DataFrame, dead: DataFrame | None = None) -> FulltextIndex:
        own = cls.__new__(cls)
        own.rows, own.dead = rows, dead
        return own

    def search(self, queries: DataFrame, k: int, key: str = "item_id", text: str = "text", any_term: bool = False) -> DataFrame:
        """(qid, doc_id, score, rank): documents that hold all of a query's stems, by cover density.

        The word `or` cuts a query into alternatives, of which one must be held; the best one's score
        counts. Stop words ask nothing; a query of stop words alone finds nothing. With any_term a document
        needs one stem only, and its score is divided by the share it lacks.

        A block without some stem of an alternative is left out by its rows' terms alone. In the others documents that hold
        all stems are found from the rarest stem on, by number; places are read only where some were found.
        """
        parts = queries.select(F.col(key).alias("qid"), F.posexplode(F.split(F.col(text), r"(?i)(?<!\S)or(?!\S)")).alias("alternative", "part"))
        words = parts.select("qid", "alternative", F.explode(F.array_distinct(tokens(F.col("part")))).alias("term"))
        asked = words.join(stems(words), "term").select("qid", "alternative", F.col("lexeme").alias("term")).distinct()
        asked = stored(asked.join(asked.groupBy("qid", "alternative").agg(F.count("*").alias("need")), ["qid", "alternative"]), "asked")
        groups, own_heads = postings.query_groups(asked), postings.heads(self.rows, self.dead)
        held = self.rows.filter("term IS NOT NULL").select("term", "block").join(asked, "term").groupBy("qid", "alternative", "need", "block").agg(F.count("*").alias("has"))
        pairs = (held if any_term else held.filter("has = need")).select("qid", "alternative", "block")

        def numbers(block: postings.Block, right):
            for (qid, alternative), terms in keyed(right):
                lists = sorted((block.terms[t][0] for t, *_ in terms if t in block.terms), key=len)
                if any_term:
                    found = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
                else:
                    found = lists[0]
                    for other in lists[1:]:
                        found = found[np.isin(found, other, assume_unique=True)]
                found = found[block.alive[found]]
                if len(found):
                    yield [qid], [alternative], [int(right.column("block")[0].as_py())], [found.tolist()]

        met = stored(postings.cogrouped(self.rows, own_heads, asked.join(pairs, ["qid", "alternative"]), groups, ["nos", "tfs"], numbers, "qid long, alternative int, block long, found array<int>"), "survivors")

        def densities(block: postings.Block, right):
            starts = {t: np.concatenate([[0], np.cumsum(tf)]) for t, (_, tf, _) in block.terms.items()}
            scores: dict[int, dict[int, float]] = {}
            for (qid, _), terms in keyed(right):
                own = scores.setdefault(qid, {})
                for no in terms[0][2]:
                    lists = []
                    for t, *_ in terms:
                        if t in block.terms:
                            nos, _, places = block.terms[t]
                            at = int(np.searchsorted(nos, no))
                            if at < len(nos) and nos[at] == no:
                                lists.append(places[starts[t][at] : starts[t][at + 1]].tolist())
                    score = round(cover_density(lists) * len(lists) / terms[0][1], 6)
                    own[no] = max(own.get(no, score), score)
            for qid, own in scores.items():
                best = sorted(own, key=lambda no: (-own[no], no))[:k]
                yield [qid] * len(best), block.ids[best].tolist(), [own[no] for no in best]

        wanted = asked.join(met, ["qid", "alternative"])
        return top_k(postings.cogrouped(self.rows, own_heads, wanted, groups, ["nos", "tfs", "places"], densities, "qid long, doc_id long, score double"), k)


def keyed(right):
    """((qid, alternative), rows of (term, need, found if there)) of the asked rows of a block."""
    columns = ("alternative", "term", "need", "found") if "found" in right.column_names else ("alternative", "term", "need")
    out: dict = {}
    for qid, rows in grouped(right, "qid", columns):
        for alternative, *row in rows:
            out.setdefault((qid, alternative), []).append(row)
    return out.items()


def fulltext_search(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id", any_term: bool = False, text: str = "text") -> DataFrame:
    """`FulltextIndex.search` over documents that have no index yet; queries have `text`."""
    return FulltextIndex(docs, doc_key, text).search(queries, k, query_key, any_term=any_term)
