"""Scalar column functions; everything here is an expression that Catalyst can compile."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: z of a two-sided 95 % interval.
Z95 = 1.959963984540054


def clip(x: Column, lo: float = -2.0, hi: float = 2.0) -> Column:
    """x within [lo, hi]; null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def likert(x: Column, levels: int = 5, reverse: bool = False) -> Column:
    """1..2*levels halved upwards to 1..levels, optionally reversed; anything else is null."""
    half = F.when(x.between(1, 2 * levels), F.ceil(x / 2).cast("int"))
    return F.lit(levels + 1) - half if reverse else half


def recode(x: Column, table: dict) -> Column:
    """Values by a table; values outside it are null."""
    return F.create_map(*[F.lit(v) for v in chain(*table.items())])[x]


def four_to_five(x: Column) -> Column:
    """A four-step scale spread over 1..5."""
    return recode(x.cast("int"), {1: 1.0, 2: 1 + 4 / 3, 3: 1 + 8 / 3, 4: 5.0})


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null columns of a row; null if none."""
    held = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, v: a + v), F.size(held).cast("double"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def to_double(x: Column) -> Column:
    """Number or null, never an error."""
    return x.try_cast("double") if hasattr(x, "try_cast") else F.expr(f"try_cast({x} as double)")


def normalize_place(x: Column) -> Column:
    """Lower case, punctuation to spaces, digits removed, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"[.,;:/|()_\-]", " "), r"[0-9]", ""), r" +", " "))


def own_words(x: Column) -> Column:
    """What a repost's author wrote: the text before the first ``//``."""
    return F.split_part(x, F.lit("//"), F.lit(1))


# Fixed patterns of the short-message and microblog cleaners.  The range ``,-~`` holds most of ASCII.
LINK = r"[http|https]*://[a-zA-Z0-9.?/&=:_%,-~]*"
CHINESE = r"[\u4e00-\u9fa5]"
MENTION = r"[@].*?[ ]"
MICROBLOG_DROP = r"[a-zA-Z0-9.?/&=:_%,-~#《》]"
MICROBLOG_MENTION = r"[//@].*?[:]"
MICROBLOG_LINK = "点击链接查看更多->"


def clean_post(x: Column) -> Column:
    """Short-message cleaner.  The order matters: quotes, repost marks, dots and apostrophes go before links."""
    for gone in ('"', "RT", ".", "'"):
        x = F.replace(x, F.lit(gone), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(x, f"(?s){LINK}", ""), CHINESE, "")
    return F.regexp_replace(_strip(F.replace(x, F.lit("\n"), F.lit(" "))), f"(?s){MENTION}", "")


def clean_microblog(x: Column) -> Column:
    """Cleaner for Chinese microblogs: quote marks and link text, then ASCII and title marks, then reposts' mentions."""
    for gone in ("“", "”", "…", MICROBLOG_LINK):
        x = F.replace(x, F.lit(gone), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(x, f"(?s){MICROBLOG_DROP}", ""), f"(?s){MICROBLOG_MENTION}", "")
    return _strip(F.replace(x, F.lit("\n"), F.lit(" ")))


def _strip(x: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def post_content(text: Column, original: Column, is_repost: Column) -> Column:
    """A post on one line, a repost followed by its original after ``//``."""
    one = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " ")
    return F.when(is_repost, F.concat(one(text), F.lit("//"), one(original))).otherwise(one(text))


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order, by string order."""
    return F.array_join(F.array_sort(F.array(a.cast("string"), b.cast("string"))), "_")


def fisher_z(r: Column) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(0.0)), F.lit(1 - 1e-12)))


def fisher_interval(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Confidence limits of a Pearson correlation; null below four observations or at |r| = 1."""
    centre, half = F.atanh(r), F.lit(z) / F.sqrt((n - 3).cast("double"))
    ok = (n > 3) & (F.abs(r) < 1)
    return F.when(ok, F.tanh(centre - half)), F.when(ok, F.tanh(centre + half))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def residual_angle(r: Column) -> tuple[Column, Column]:
    """(degrees, cosine) of a unit vector's residual length."""
    return F.degrees(F.asin(F.least(F.lit(1.0), r))), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))


def softmax_one(logits: Column, k: int) -> Column:
    """Probability of entry k of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.element_at(e, k + 1) / F.aggregate(e, F.lit(0.0), lambda s, v: s + v)


def label_answer(x: Column, irrelevant: int = -99, skip: str = "skip") -> Column:
    """A model's answer as a label: its first line, the word ``skip`` is irrelevant, else the first signed integer."""
    line = F.lower(F.trim(F.split_part(F.trim(x), F.lit("\n"), F.lit(1))))
    return F.when(line.contains(skip.lower()), F.lit(irrelevant)).otherwise(F.regexp_extract(line, r"(-?\d+)", 1).try_cast("int"))


#: Words after which a Chinese answer names its number, in the order in which they are looked for (fixed values).
ANSWER_MARKS = ("返回", "数字", "态度", "选择", "选", "是", "为")


def label_answer_zh(x: Column, irrelevant: int = -99) -> Column:
    """The same for Chinese answers: irrelevant, a number, neutral, or the number after the words that announce it."""
    line = F.split_part(x, F.lit("\n"), F.lit(1))
    number = F.regexp_extract(line, r"(-?\d+)", 1).try_cast("int")
    rest = F.when(line.contains("答案为") | line.contains("答案是"), F.get(F.split(line, "答案"), F.lit(1))).otherwise(line)
    # A fold, as nested conditions would hold the text three times for each mark and outgrow what the JVM compiles.
    marks = F.array(*[F.lit(m) for m in ANSWER_MARKS])
    rest = F.aggregate(marks, rest, lambda t, mark: F.when(t.contains(mark), F.split_part(t, mark, F.lit(2))).otherwise(t))
    rest = F.regexp_replace(F.regexp_replace(rest, "^[为是。：]+|[为是。：]+$", ""), "[ 。]", "")
    quoted = F.substring(F.regexp_extract(rest, "“(.+?)”", 1), 1, 1)
    return F.when(line.contains("无关"), F.lit(irrelevant)).when(number.isNotNull(), number).when(line.contains("中立"), F.lit(0)).otherwise(F.coalesce(_han_number(rest), _han_number(quoted)))


def _han_number(x: Column) -> Column:
    """Digits of any script as a number; full-width ones are the only others that such answers hold."""
    return F.translate(x, "０１２３４５６７８９－", "0123456789-").try_cast("int")


#: Words of a Chinese answer: irrelevant, strongly against, strongly for, against, for (fixed values).
STANCE_WORDS = ("无关", "非常不支持", "非常支持", "不支持", "支持")


def support_answer(x: Column, five: bool = False, irrelevant: int = -99, words: Sequence[str] = STANCE_WORDS) -> Column:
    """Stance words of an answer as a label from -1 to 1, or with ``five`` from -2 to 2; none of the words is 0.

    ``words``: irrelevant, strongly against, strongly for, against, for, looked for in this order."""
    none, strongly_against, strongly_for, against, in_favour = words
    out = F.when(x.contains(none), F.lit(irrelevant))
    if five:
        out = out.when(x.contains(strongly_against), F.lit(-2)).when(x.contains(strongly_for), F.lit(2))
    return out.when(x.contains(against), F.lit(-1)).when(x.contains(in_favour), F.lit(1)).otherwise(F.lit(0))


def place_answer(x: Column) -> Column:
    """A 0, 1 or 2 verdict in a model's answer."""
    return F.regexp_extract(x, r"\b([012])\b", 1).try_cast("int")


def iso_answer(x: Column, valid: Sequence[str]) -> Column:
    """A two-letter country code in an answer; UK and GI count as GB, others outside ``valid`` as unknown."""
    code = F.upper(F.regexp_extract(x, r"\b([A-Za-z]{2})\b", 1))
    code = F.when(code.isin("UK", "GI"), F.lit("GB")).otherwise(code)
    return F.when(code.isin(list(valid)), code).otherwise(F.lit("unknown"))


def has_any_word(x: Column, words: Sequence[str]) -> Column:
    """Whether one of the words (or phrases) stands in the text between word boundaries."""
    padded = F.concat(F.lit(" "), normalize_place(x), F.lit(" "))
    hit = F.lit(False)
    for w in words:
        hit = hit | padded.contains(f" {w.lower()} ")
    return hit


def first_match(rules: Sequence[tuple[Column, str]], fallback: str) -> Column:
    """The label of the first rule that holds: a cascade."""
    out = None
    for hit, label in rules:
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(fallback)) if out is not None else F.lit(fallback)


def lookup(x: Column, names: dict[str, str]) -> Column:
    """The name that a dictionary gives for a value; null for values without one."""
    if not names:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x)


def dated_path(path: Column, day: Column) -> Column:
    """``folder/name`` as ``folder/YYYYMMDD_name``, for a column of paths; null if the path or the day is null."""
    folder, name = F.regexp_extract(path, "^(.*/)?([^/]*)$", 1), F.regexp_extract(path, "^(.*/)?([^/]*)$", 2)
    return F.concat(folder, F.date_format(day, "yyyyMMdd"), F.lit("_"), name)


def fragment_of_longer(word: Column, others: Column) -> Column:
    """Whether the word's tokens are a proper part of those of one of ``others``."""
    own = F.split(word, " ")
    return F.exists(others, lambda o: (F.size(F.array_except(own, F.split(o, " "))) == 0) & (F.size(own) < F.size(F.split(o, " "))))


def tokens(x: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(f"({pattern})"), 1)


def noun_compounds(words: Column, nouns: Sequence[str], adjectives: Sequence[str] = (), longest: int = 3) -> Column:
    """Phrases of 2 to ``longest`` neighbouring words of a clause, all of them nouns or adjectives, the last one a noun.

    Which words are nouns is given as a list, as no tagger is at hand."""
    good = list(nouns) + list(adjectives)

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        found = F.transform(starts, lambda i: F.slice(words, i, n))
        return F.filter(found, lambda r: F.forall(r, lambda w: w.isin(good)) & F.try_element_at(r, F.lit(-1)).isin(list(nouns)))

    return F.transform(F.concat(*[runs(n) for n in range(2, longest + 1)]), lambda r: F.array_join(r, " "))


def clauses(x: Column) -> Column:
    """A text's clauses: what stands between marks other than letters and spaces, in lower case."""
    return F.filter(F.transform(F.split(F.lower(x), r"[^a-z ]+"), lambda c: F.trim(c)), lambda c: c != "")


def unglue(x: Column, table: dict[str, str]) -> Column:
    """Tokens of a scanned text with those that run two words together taken apart by a table."""
    fixed = F.create_map(*[F.lit(v) for v in chain(*table.items())]) if table else None
    return x if fixed is None else F.transform(x, lambda w: F.coalesce(F.try_element_at(fixed, w), w))


def pretty_label(code: Column, table: dict[str, str]) -> Column:
    """A topic's printed name by its code, also where numbers and their text mix; the code itself where it has none."""
    text = F.regexp_replace(code.cast("string"), r"\.0$", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for v in chain(*table.items())]), text), text)


def ordered_distinct(x: Column) -> Column:
    """Distinct elements in the order of their first occurrence."""
    return F.array_distinct(x)


def argmax_label(logits: Column) -> Column:
    """Number of the greatest entry, the first on ties."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def ngrams(words: Column, n: int) -> Column:
    """Phrases of n neighbouring words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def string_seed(x: Column) -> Column:
    return F.crc32(x)


def alias_topic(x: Column) -> Column:
    """Topic names as keys: no prefix, no underscores, lower case."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, "^topic-", ""))), "_", "")
