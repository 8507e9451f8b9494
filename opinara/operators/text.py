"""Keyword search, cleaning, word counts and TF-IDF by topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.scalar import tokens

MAX_BROADCAST_KEYWORDS = 100_000


def keyword_filter(posts: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Posts with any keyword: one alternation for Java's regex engine."""
    import re

    return posts.where(F.col(text).rlike("|".join(re.escape(k) for k in keywords))) if keywords else posts.limit(0)


def first_keyword(posts: DataFrame, text: str, keywords: Sequence[tuple[int, str]]) -> DataFrame:
    """(posts, keyword_id) of the keyword that starts first in the text, ties by the longer one."""
    at = [F.struct(F.locate(k, F.col(text)).alias("at"), F.lit(-len(k)).alias("length"), F.lit(i).alias("id")) for i, k in keywords]
    found = F.filter(F.array(*at), lambda s: s["at"] > 0)
    return posts.withColumn("keyword_id", F.array_min(found)["id"]).where(F.col("keyword_id").isNotNull())


def search_keywords(posts: DataFrame, text: str, keywords: Sequence[tuple[int, str]], key: str = "post_id") -> DataFrame:
    """(key, keyword_id): the keyword whose occurrence ends first in each text, the longest of those; texts without any are
    left out.

    One automaton holds all keywords, however many; it is built once in each task."""
    import ahocorasick
    import pyarrow as pa

    kind = dict(posts.dtypes)[key]
    shared = posts.sparkSession.sparkContext.broadcast([(int(i), k) for i, k in keywords if k])

    def run(batches):
        auto = ahocorasick.Automaton()
        for i, k in sorted(shared.value, reverse=True):  # the least id of equal keywords is added last and stays
            auto.add_word(k, (-len(k), i))
        if len(auto):
            auto.make_automaton()
        for b in batches:
            rows, ids = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                first = None
                for end, hit in auto.iter(t) if t and len(auto) else ():
                    if first is None:
                        first = (end, hit)
                    elif end > first[0]:
                        break
                    else:
                        first = min(first, (end, hit))
                if first:
                    rows.append(r)
                    ids.append(first[1][1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int32())], [key, "keyword_id"])

    return posts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, keyword_id int")


def topic_matches(posts: DataFrame, text: str, keywords: dict[str, Sequence[str]]) -> DataFrame:
    """Posts with ``topic``: one row for each topic one of whose keywords the text holds."""
    import re

    hits = F.array(*[F.when(F.col(text).rlike("|".join(re.escape(w) for w in words)), F.lit(t)) for t, words in keywords.items() if words])
    return posts.withColumn("topic", F.explode(F.filter(hits, lambda t: t.isNotNull())))


def pooled_counts(counts: DataFrame) -> DataFrame:
    """Word counts summed over the topics or periods they come from, the most frequent first."""
    return counts.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word")


def word_counts(posts: DataFrame, text: str, topic: str, pattern: str = "[a-z]+", stop: Sequence[str] = ()) -> DataFrame:
    """(topic, word, count); words explode and combine in the map tasks before the shuffle."""
    words = posts.select(F.col(topic).alias("topic"), F.explode(tokens(F.col(text), pattern)).alias("word"))
    if stop:
        words = words.where(~F.col("word").isin(list(stop)))
    return words.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("count"))


def top_share(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """The most frequent floor(share * words) words of each topic, ties by word.

    A topic's vocabulary is never ordered in one task: how many words have each count (few counts are different) tells the counts
    that are kept whole, and only the words of the one count that is kept in part are numbered, over range partitions."""
    from opinara.operators.ranks import numbered
    from opinara.session import cut_lineage

    counts = cut_lineage(counts, "counts")
    w = Window.partitionBy("topic")
    levels = counts.groupBy("topic", "count").agg(F.count(F.lit(1)).alias("_words"))
    before = F.sum("_words").over(w.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.withColumn("_room", F.floor(F.sum("_words").over(w) * F.lit(share)) - F.coalesce(before, F.lit(0))).where("_room > 0")
    levels = levels.select(F.col("topic").alias("_topic"), F.col("count").alias("_count"), "_room", (F.col("_room") < F.col("_words")).alias("_part"))
    rows = counts.join(levels, F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("count") == F.col("_count"))).drop("_topic", "_count")
    ties = numbered(rows.where("_part"), ["topic"], [F.col("word")]).where("_n <= _room")
    return rows.where("not _part").select(*counts.columns).unionByName(ties.select(*counts.columns))


#: The counts after the cut fit a broadcast up to this number of topics.
MAX_TOPICS = 10_000


def tfidf(counts: DataFrame) -> DataFrame:
    """tf, df, idf = ln((T + 1) / (df + 1)) and their product; totals and document frequencies are those of ``counts``,
    that is, after any cut."""
    from opinara.session import cut_lineage

    # The counts are stored once: totals, document frequencies and the rows themselves read the small table, not the texts.
    counts = cut_lineage(counts, "counts")
    total = counts.groupBy("topic").agg(F.sum("count").alias("_total"))
    topics = total.count()
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # one row for each word and topic
    joined = counts.join(F.broadcast(total) if topics <= MAX_TOPICS else total, "topic").join(df, "word").withColumn("_topics", F.lit(topics).cast("long"))
    tf, idf = F.col("count") / F.col("_total"), F.log((F.col("_topics") + 1) / (F.col("df") + 1))
    return joined.select("topic", "word", "count", tf.alias("tf"), "df", idf.alias("idf"), (tf * idf).alias("tfidf"))


def top_k(rows: DataFrame, k: int, group: str = "topic", value: str = "tfidf", tie: str = "word") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_table(rows: DataFrame, k: int = 10) -> DataFrame:
    """topic -> "word(count);" lines of its k most frequent words."""
    best = top_k(rows, k, value="count")
    packed = best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "count"))).alias("v"))
    return packed.select("topic", F.array_join(F.transform("v", lambda x: F.concat(x["word"], F.lit("("), x["count"].cast("string"), F.lit(")"))), ";\n").alias("words"))


def vocabulary_shares(counts: DataFrame, thresholds: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    """Shares of words with more than so many occurrences."""
    return counts.groupBy("topic").agg(F.count(F.lit(1)).alias("words"), *[(F.count_if(F.col("count") > t) / F.count(F.lit(1))).alias(f"over_{t}") for t in thresholds])


def frequent_words(posts: DataFrame, text: str, k: int = 100, shortest: int = 2) -> DataFrame:
    words = posts.select(F.explode(tokens(F.col(text))).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(k)


def row_counts(rows: DataFrame, topic: str) -> DataFrame:
    """Rows per topic, and in total (null topic)."""
    return rows.rollup(topic).agg(F.count(F.lit(1)).alias("n"))


def place_class(place: Column, rules: Sequence[tuple[str, Sequence[str]]], fallback: str = "undecided") -> Column:
    """Class of a place string by the first rule one of whose words it has."""
    from opinara.functions.scalar import first_match, has_any_word

    return first_match([(has_any_word(place, words), label) for label, words in rules], fallback)
