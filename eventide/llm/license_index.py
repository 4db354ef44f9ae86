"""License scan with a positional rare-token index, in DataFrame functions only.

The index holds, for each word of each licence text, the postings (text, offset). One pass over all documents
takes their words and notes which words of the index each holds; the share of documents with each such word, over
all documents, gives its IDF. Each document then looks up, for every licence text whose key phrase it could hold,
its own highest-IDF words among those of that text. Where such a word stands at position p and has a posting
(t, o), text t would begin at p - o: proposals are counted by document, text and beginning, so postings that agree
on the relative position meet, and two rare words must agree. What is left is verified: the mandatory key phrase
must stand word by word at its place, and the share of the text's IDF mass that stands at the right places is the
score of the match.

Only documents that hold every word of some key phrase keep their words for the second step, which loses nothing.
Base places (three fixed phrases, anywhere) are found the same way, with the phrase as its own text and key.

Null and empty texts: no words, no labels, score 0. Very long texts are scanned whole. Repeated rows give repeated
results, an empty table an empty one; of several matches of a label the best counts; extra columns are not read.
Words are compared after A-Z are lowered, nothing else.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import staged
from eventide.llm.license_texts import LICENSES

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase -> label; each place where one stands counts.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))  # fixed values
#: A document's rarest words of a licence text that are looked up, and how many must agree on a beginning.
RARE_WORDS, AGREE = 6, 2
MIN_SCORE = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def find(words: list[str], part: list[str]) -> int:
    """Where part stands in words first."""
    return next(k for k in range(len(words)) if words[k : k + len(part)] == part)


def _array(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _all_in(column: str, words: list[str]) -> Column:
    """Whether an array holds all words; long words, which are rare, are tried first."""
    ok = F.lit(True)
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        ok = ok & F.array_contains(column, w)
    return ok


def scan_licenses(docs: DataFrame, licenses: tuple = LICENSES, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of docs(doc_id, text); see the module's docstring."""
    spark = docs.sparkSession
    texts = [(label, words_of(text), words_of(key), False) for label, text, key in licenses] + [(label, p.split(), p.split(), True) for p, label in BASE]
    vocabulary = sorted({w for _, t, _, _ in texts for w in t})
    needs = sorted({tuple(sorted(set(key))) for _, _, key, _ in texts})

    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)).alias("words")).withColumn("found", F.array_intersect("words", _array(vocabulary)))
    wanted = F.lit(False)
    for need in needs:
        wanted = wanted | _all_in("found", list(need))
    seen = staged(seen.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("bigint").alias("n_words"), "found", F.when(wanted, F.col("words")).alias("w")), "license_words")

    # IDF over all documents; as many rows as the vocabulary
    total = seen.count()
    df = {r["word"]: r["n"] for r in seen.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    by_idf = lambda words: sorted(set(words), key=lambda w: (-idf[w], w))
    postings = spark.createDataFrame([(w, [(t, o) for t, (_, words, _, _) in enumerate(texts) for o, x in enumerate(words) if x == w]) for w in vocabulary], "word string, postings array<struct<t:int,o:int>>")

    # what each document looks up: of every text that it could hold, its rarest words
    held = seen.where(F.col("w").isNotNull())
    rare = [F.when(_all_in("found", key), F.slice(F.array_intersect(_array(by_idf(words)), "found"), 1, RARE_WORDS)) for _, words, key, _ in texts]
    looked = held.withColumn("rare", F.array_distinct(F.flatten(F.array_compact(F.array(*rare)))))
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("p"))), lambda x: F.array_contains("rare", x["word"]))
    proposed = looked.select("rid", F.explode(places).alias("x")).select("rid", F.col("x.word").alias("word"), F.col("x.p").alias("p"))
    proposed = proposed.join(F.broadcast(postings), "word").select("rid", "p", F.explode("postings").alias("x")).select("rid", F.col("x.t").alias("t"), (F.col("p") - F.col("x.o")).alias("begin"))
    agreed = proposed.groupBy("rid", "t", "begin").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE).groupBy("rid").agg(F.collect_list(F.struct("t", "begin")).alias("proposals"))

    # verification against the document's words
    at = lambda values, t: F.get(F.array(*values), t)
    mass = [sum(idf[w] for w in words) for _, words, _, _ in texts]
    keys, key_at = [_array(key) for _, _, key, _ in texts], [F.lit(find(words, key)) for _, words, key, _ in texts]
    whole, weights = [_array(words) for _, words, _, _ in texts], [_array([repr(idf[w] / m) for w in words]).cast("array<double>") for (_, words, _, _), m in zip(texts, mass, strict=True)]
    labels, is_base = [F.lit(label) for label, _, _, _ in texts], [F.lit(b) for _, _, _, b in texts]

    def stands(x: Column) -> Column:
        key, begin = at(keys, x["t"]), x["begin"] + at(key_at, x["t"])
        return F.when(begin >= 0, F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.size(key)) == key).otherwise(F.lit(False))

    def share(x: Column) -> Column:
        in_place = F.transform(at(whole, x["t"]), lambda word, o: F.when(F.get("w", x["begin"] + o) == word, F.get(at(weights, x["t"]), o)).otherwise(0.0))
        return F.aggregate(in_place, F.lit(0.0), lambda a, b: a + b)

    none = F.array().cast("array<struct<t:int,begin:int>>")
    checked = held.join(agreed, "rid", "left").withColumn("good", F.filter(F.coalesce("proposals", none), stands))
    checked = checked.withColumn("own", F.transform(F.filter("good", lambda x: ~at(is_base, x["t"])), lambda x: F.struct(at(labels, x["t"]).alias("label"), share(x).alias("score"))))
    checked = (
        checked.withColumn("base", F.filter("good", lambda x: at(is_base, x["t"]))).withColumn("places", F.transform("base", lambda x: x["begin"]))
        .withColumn("base_labels", F.transform("base", lambda x: at(labels, x["t"]))).withColumn("own_labels", F.transform(F.filter("own", lambda x: x["score"] >= min_score), lambda x: x["label"]))
        .withColumn("best", F.coalesce(F.array_max(F.transform("own", lambda x: x["score"])), F.lit(0.0)))
    )
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    found = checked.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        listed("base_labels").alias("base_labels"), listed(F.concat("base_labels", "own_labels")).alias("labels"),
        F.least(F.lit(1.0), F.greatest("best", F.when(F.size("places") > 0, F.lit(min_score)).otherwise(0.0))).alias("score"),
    )
    rest = seen.where(F.col("w").isNull()).select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_base"), F.lit(None).cast("bigint").alias("first_word"), F.lit(None).cast("bigint").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return found.unionByName(rest)
