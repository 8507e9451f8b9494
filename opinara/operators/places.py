"""Places in user profiles: cascades of rules, verdicts of models merged in, and the users of each class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.scalar import first_match, has_any_word, normalize_place
from opinara.operators.ranks import few
from opinara.session import cut_lineage

#: Different numbers of words that the names of a gazetteer may have: each is a pass over the words of the texts.
MAX_PLACE_WORDS = 12


def any_token(x: Column, tokens: Sequence[str]) -> Column:
    """Whether one of the codes stands alone in the text, in any case."""
    words = F.split(normalize_place(x), " ")
    return F.arrays_overlap(words, F.array(*[F.lit(t.lower()) for t in tokens])) if tokens else F.lit(False)


def any_sign(x: Column, signs: Sequence[str]) -> Column:
    """Whether one of the signs (flags) occurs."""
    hit = F.lit(False)
    for s in signs:
        hit = hit | x.contains(s)
    return hit


def home_or_abroad(x: Column, junk: Sequence[str], states: Sequence[str], cities: Sequence[str], countries: Sequence[str], flags: Sequence[str], state_codes: Sequence[str], home: str = "us", abroad: str = "non_us") -> Column:
    """Cascade of one home country: junk words are not sure; its states and cities are home; names and flags of other
    countries are abroad; then its states' codes; the rest is undecided.

    Words match between word boundaries, so that a junk word inside a place's name doesn't decide."""
    rules = [(has_any_word(x, junk), "not_sure"), (has_any_word(x, states) | has_any_word(x, cities), home), (has_any_word(x, countries) | any_sign(x, flags), abroad), (any_token(x, state_codes), home)]
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit("undecided")).otherwise(first_match(rules, "undecided"))


def union_or_not(x: Column, junk: Sequence[str], members: Sequence[str], member_codes: Sequence[str], others: Sequence[str], inside: str = "eu", outside: str = "non_eu") -> Column:
    """Cascade of a union of countries: junk and other countries' names are outside, members' names or codes inside."""
    rules = [(has_any_word(x, junk), outside), (has_any_word(x, members), inside), (has_any_word(x, others), outside), (any_token(x, member_codes), inside)]
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit("undecided")).otherwise(first_match(rules, "undecided"))


def country_of(x: Column, flags: dict[str, str], aliases: dict[str, str], cities: dict[str, str], codes: Sequence[str]) -> Column:
    """Country code of a place: by flag, alias of the country, city, then a code that stands alone; else unknown."""
    rules = [(x.contains(sign), code) for sign, code in flags.items()]
    rules += [(has_any_word(x, [name]), code) for name, code in aliases.items()]
    rules += [(has_any_word(x, [name]), code) for name, code in cities.items()]
    rules += [(any_token(x, [code]), code) for code in codes]
    return first_match(rules, "unknown")


def merge_verdicts(places: DataFrame, verdicts: DataFrame, fixes: dict[str, str] | None = None, open_classes: Sequence[str] = ("undecided", "not_sure", "unknown")) -> DataFrame:
    """(place, class): the rules' class, or for places that the rules left open the model's verdict (place, verdict), if it
    has one; the first verdict in order of its text counts; ``fixes`` renames verdicts."""
    v = verdicts.where("verdict is not null").groupBy("place").agg(F.min("verdict").alias("verdict"))
    named = F.col("verdict")
    for old, new in (fixes or {}).items():
        named = F.when(F.col("verdict") == old, F.lit(new)).otherwise(named)
    joined = places.join(v.select("place", named.alias("verdict")), "place", "left")
    left_open = F.col("class").isin(list(open_classes)) & F.col("verdict").isNotNull() & ~F.col("verdict").isin(list(open_classes))
    return joined.select("place", F.when(left_open, F.col("verdict")).otherwise(F.col("class")).alias("class"))


def place_users(users: DataFrame, places: DataFrame) -> DataFrame:
    """(class, user_id): distinct users by the class of their profile's place."""
    return users.join(places, "place").select("class", "user_id").distinct()


def class_sizes(class_users: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Users of each class, the largest class first; with ``present`` only those who have rows there."""
    rows = class_users if present is None else class_users.join(present.select("user_id").distinct(), "user_id", "left_semi")
    return rows.groupBy("class").agg(F.count_distinct("user_id").alias("users")).orderBy(F.desc("users"), "class")


def one_class_each(class_users: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """Users of several classes keep the one that comes first in ``precedence``."""
    place = F.array_position(F.array(*[F.lit(c) for c in precedence]), F.col("class"))
    w = Window.partitionBy("user_id").orderBy(F.when(place == 0, F.lit(len(precedence) + 1)).otherwise(place), "class")
    return class_users.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def place_tokens(x: Column) -> Column:
    """The words of a place's name or of a text: lower case, cut at everything that is neither letter nor digit."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def gazetteer_matches(texts: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, code, level, start, words): the place that each text names, by a gazetteer (place, code, level) of any size.

    All runs of words of a text that are a place of the gazetteer are candidates; the lowest level decides, then the run that ends
    farthest right, then the longest, then the first code in order: as when a trie is walked from the right end, level by
    level.  Each word meets the places that begin with it in a join (broadcast while the gazetteer is small), and only there are
    the words after it compared.  Texts without a place, or null, give no row; rows of one key are one
    text each.  Places without words or with a null code or level are left out."""
    named = gazetteer.where("code is not null and level is not null").select(place_tokens(F.col("place")).alias("w"), "code", "level").where(F.size("w") > 0)
    # One row for each name: what a lower level or an earlier code says of the same name decides.
    named = named.groupBy("w").agg(F.min(F.struct("level", "code")).alias("p")).select(F.col("w")[0].alias("first"), "w", F.size("w").alias("n"), "p.code", "p.level")
    lengths = [r.n for r in named.select("n").distinct().orderBy("n").limit(MAX_PLACE_WORDS + 1).collect()]
    if len(lengths) > MAX_PLACE_WORDS:
        raise ValueError(f"place names of more than {MAX_PLACE_WORDS} different lengths")
    if not lengths:
        lengths = [1]
    named = few(cut_lineage(named, "names"))
    own = F.xxhash64(F.col(text).cast("string"))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), own.alias("t"), place_tokens(F.col(text).cast("string")).alias("words"))
    words = rows.select("key", "t", "words", F.posexplode("words").alias("start", "first"))
    words = words.select("key", "t", "start", "first", F.slice("words", F.col("start") + 1, lengths[-1]).alias("run"))
    hits = words.join(named, "first").where(F.slice("run", 1, F.col("n")) == F.col("w"))
    order = F.struct("level", (-(F.col("start") + F.col("n"))).alias("end"), (-F.col("n")).alias("length"), "code", "w", "start", "n")
    best = hits.groupBy("key", "t").agg(F.min(order).alias("b"))
    # Rows of one key and text are told apart by nothing: each copy gets the row.
    copies = texts.where(F.col(text).isNotNull()).groupBy(F.col(key).alias("k2"), own.alias("t2")).agg(F.count(F.lit(1)).alias("copies"))
    best = best.join(copies, F.col("key").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select(F.col("key").alias(key), F.array_join("b.w", " ").alias("place"), F.col("b.code").alias("code"), F.col("b.level").alias("level"), F.col("b.start").alias("start"), F.col("b.n").alias("words"))
