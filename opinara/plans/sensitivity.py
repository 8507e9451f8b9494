"""Queries on the choice of topics, shares of variance with their bounds, levels with ranges, ellipses and complete-row components.

Same conventions as in ``catalogue``; queries whose numbers come from random draws or eigenvectors have no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators import adjustment, correlation, panel, portraits, sensitivity, spectral
from opinara.plans.catalogue import CORR, PAIRS, PANEL, SOCIETY, q6, query, rounded, society_pairs, the_pairs, the_panel, values
from opinara.plans.studies import _names, _parts, part_correlations, part_opinions
from opinara.session import cut_lineage

SOCIETIES = ("AMERICA", "ASIA", "EUROPE")


# --- spectra of topic subsets -----------------------------------------------------------------------------------------
def _media_covariance(spark, sf) -> DataFrame:
    """(society, medium, t1, t2, n, cov) of the nine groups of part sizes: a few hundred rows, stored once for all subset sizes."""
    media = F.array(*[F.struct(F.lit(m).alias("medium"), F.col(m).alias("value")) for m in ("off", "on")])
    rows = part_opinions(spark, sf, 9).select("user_id", "society", "topic", F.explode(media).alias("m")).select("user_id", "society", "topic", "m.medium", "m.value")
    return cut_lineage(spectral.available_covariance(rows, ("society", "medium")), "media_covariance")


def _media_numbers(cov: DataFrame, size: int, metric: str) -> DataFrame:
    """(society, subset, off, on): a spectral number over the size, in both media."""
    found = sensitivity.subset_spectra(cov, _names(9), size, ("society", "medium"))
    return found.groupBy("society", "subset").agg(*[F.max(F.when(F.col("medium") == m, F.col(metric) / size)).alias(m) for m in ("off", "on")])


_PAIR_SPECTRA = (
    f"{_parts(9)}, lg AS (SELECT user_id, society, topic, 'off' AS medium, off_ AS v FROM op UNION ALL SELECT user_id, society, topic, 'on', on_ FROM op), mm AS (SELECT society, medium, topic, avg(v) AS m FROM lg GROUP BY ALL), "
    "cv AS (SELECT a.society, a.medium, a.topic AS t1, b.topic AS t2, CASE WHEN count(*) > 1 THEN (sum(a.v*b.v) - count(*)*max(x.m)*max(y.m))/(count(*)-1) ELSE 0.0 END AS c "
    "FROM lg a JOIN lg b ON a.user_id = b.user_id AND a.society = b.society AND a.medium = b.medium AND a.topic <= b.topic "
    "JOIN mm x ON x.society = a.society AND x.medium = a.medium AND x.topic = a.topic JOIN mm y ON y.society = b.society AND y.medium = b.medium AND y.topic = b.topic GROUP BY ALL), "
    "tp AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS t1, lpad(CAST(j AS VARCHAR), 2, '0') AS t2, row_number() OVER (ORDER BY i, j) - 1 AS subset FROM (SELECT unnest(range(9)) AS i) a, (SELECT unnest(range(9)) AS j) b WHERE i < j), "
    "sg AS (SELECT DISTINCT society, medium FROM cv), "
    "ev AS (SELECT sg.society, sg.medium, subset, coalesce(a.c, 0) AS a, coalesce(d.c, 0) AS d, coalesce(b.c, 0) AS b FROM sg CROSS JOIN tp LEFT JOIN cv a ON a.society = sg.society AND a.medium = sg.medium AND a.t1 = tp.t1 AND a.t2 = tp.t1 "
    "LEFT JOIN cv d ON d.society = sg.society AND d.medium = sg.medium AND d.t1 = tp.t2 AND d.t2 = tp.t2 LEFT JOIN cv b ON b.society = sg.society AND b.medium = sg.medium AND b.t1 = tp.t1 AND b.t2 = tp.t2), "
    "ei AS (SELECT society, medium, subset, greatest((a+d)/2 + sqrt(((a-d)/2)**2 + b*b), 0) AS e1, greatest((a+d)/2 - sqrt(((a-d)/2)**2 + b*b), 0) AS e2 FROM ev), "
    "sp AS (SELECT society, medium, subset, (e1+e2)**2/(e1*e1+e2*e2) AS pr, exp(-(e1/(e1+e2)*ln(e1/(e1+e2)+1e-12) + e2/(e1+e2)*ln(e2/(e1+e2)+1e-12))) AS erank, (e1+e2)/e1 AS srank FROM ei WHERE e1 > 0)"
)


@query("subset_pair_spectra", f"WITH {_PAIR_SPECTRA} SELECT society, medium, subset, {q6('pr')} AS pr, {q6('erank')} AS erank, {q6('srank')} AS srank FROM sp")
def subset_pair_spectra(spark, sf):
    """Spectral numbers of every two of the nine topics, each region and medium."""
    found = sensitivity.subset_spectra(_media_covariance(spark, sf), _names(9), 2, ("society", "medium"))
    return rounded(found, "pr", "erank", "srank")


_RANGES = ("off_median", "off_min", "on_median", "on_max", "ratio_median", "ratio_p5", "ratio_min", "share_above_1", "share_opposed")


def _range_rows(spark, sf, sizes: tuple[int, ...]) -> DataFrame:
    from math import comb

    cov = _media_covariance(spark, sf)
    parts = []
    for size in sizes:
        for metric in ("pr", "erank"):
            grid = sensitivity.range_grid(_media_numbers(cov, size, metric), SOCIETIES, comb(9, size))
            parts.append(sensitivity.range_summary(grid).select(F.lit(size).alias("topics"), F.lit(metric).alias("metric"), "combinations", *_RANGES))
    return rounded(reduce(DataFrame.unionByName, parts), *_RANGES)


def _range_sql(metric: str) -> str:
    return (
        f"SELECT 2 AS topics, '{metric}' AS metric, count(*) AS combinations, {q6('median(off_)')} AS off_median, {q6('min(off_)')} AS off_min, {q6('median(on_)')} AS on_median, {q6('max(on_)')} AS on_max, {q6('median(ratio)')} AS ratio_median, "
        f"{q6('quantile_cont(ratio, 0.05)')} AS ratio_p5, {q6('min(ratio)')} AS ratio_min, {q6('avg((ratio > 1)::INT)')} AS share_above_1, {q6('avg((a_on > a_off AND b_on < b_off AND c_on < c_off)::INT)')} AS share_opposed FROM "
        f"(SELECT *, greatest(a_off, b_off, c_off) - least(a_off, b_off, c_off) AS off_, greatest(a_on, b_on, c_on) - least(a_on, b_on, c_on) AS on_, (greatest(a_off, b_off, c_off) - least(a_off, b_off, c_off)) / (greatest(a_on, b_on, c_on) - least(a_on, b_on, c_on)) AS ratio FROM "
        f"(SELECT a.{metric}_off AS a_off, a.{metric}_on AS a_on, b.{metric}_off AS b_off, b.{metric}_on AS b_on, c.{metric}_off AS c_off, c.{metric}_on AS c_on FROM wd a, wd b, wd c WHERE a.society = 'AMERICA' AND b.society = 'ASIA' AND c.society = 'EUROPE'))"
    )


@query(
    "pair_spectrum_ranges",
    f"WITH {_PAIR_SPECTRA}, wd AS (SELECT society, subset, max(pr/2) FILTER (medium = 'off') AS pr_off, max(pr/2) FILTER (medium = 'on') AS pr_on, max(erank/2) FILTER (medium = 'off') AS erank_off, max(erank/2) FILTER (medium = 'on') AS erank_on FROM sp GROUP BY ALL) "
    f"{_range_sql('pr')} UNION ALL {_range_sql('erank')}",
)
def pair_spectrum_ranges(spark, sf):
    """Ranges over three regions of both numbers, over all 36 ** 3 choices of two topics in each."""
    return _range_rows(spark, sf, (2,))


@query("dimension_subset_ranges")
def dimension_subset_ranges(spark, sf):
    """The same when each region keeps all nine topics, drops one (729 combinations) or drops two (46,656)."""
    return _range_rows(spark, sf, (9, 8, 7))


# --- shares of variance -----------------------------------------------------------------------------------------------
_SUPPORT = "sup AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(x) AS lo, max(x) AS hi FROM soc GROUP BY society)), pk AS (SELECT 'all' AS kept, society, x, y FROM soc UNION ALL SELECT 'support', society, x, y FROM soc, sup WHERE x BETWEEN lo AND hi)"
_SHARES_SQL = (
    f"WITH {SOCIETY}, {_SUPPORT}, sc AS (SELECT kept, 'r' AS scale, society, x, y FROM pk WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT kept, 'z', society, x, atanh(least(y, 1-1e-12)) FROM pk WHERE x IS NOT NULL AND y IS NOT NULL), "
    "g AS (SELECT kept, scale, society, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x)*count(*) AS xx, covar_pop(x, y)*count(*) AS xy, var_pop(y)*count(*) AS yy FROM sc GROUP BY ALL), "
    "w AS (SELECT kept, scale, sum(n) AS n, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM g GROUP BY ALL), "
    "t AS (SELECT kept, scale, var_pop(y)*count(*) AS yy, regr_r2(y, x) AS b FROM sc GROUP BY ALL), "
    "r AS (SELECT kept, scale, w.n, 1 - w.yy/t.yy AS a, t.b, 1 - (w.yy - w.xy*w.xy/w.xx)/t.yy AS ab FROM w JOIN t USING (kept, scale)) "
    f"SELECT kept, scale, CAST(n AS BIGINT) AS pairs, {q6('(a+ab-b)/2')} AS society, {q6('(b+ab-a)/2')} AS similarity, {q6('ab')} AS total, {q6('1-ab')} AS unexplained, {q6('a')} AS society_first, {q6('ab-b')} AS society_last, {q6('b')} AS similarity_first, {q6('ab-a')} AS similarity_last FROM r"
)


def _share_rows(spark, sf, draws: int) -> DataFrame:
    pairs = society_pairs(spark, sf)
    both = {"all": pairs, "support": adjustment.on_support(pairs)}
    return reduce(DataFrame.unionByName, [sensitivity.variance_shares(p, draws).withColumn("kept", F.lit(k)) for k, p in both.items()])


@query("variance_shares", _SHARES_SQL)
def variance_shares(spark, sf):
    """Shares of the variance of |r| and of its z due to society and similarity, with the bounds of either order, over all pairs
    and those on common support."""
    return rounded(_share_rows(spark, sf, 0), *sensitivity.SHARES)


@query("variance_share_limits")
def variance_share_limits(spark, sf):
    return rounded(_share_rows(spark, sf, 2000).select("kept", "scale", "society", "society_lo", "society_hi", "similarity", "similarity_lo", "similarity_hi"), "society", "society_lo", "society_hi", "similarity", "similarity_lo", "similarity_hi")


# --- levels -----------------------------------------------------------------------------------------------------------
def _levels(spark, sf, draws: int) -> DataFrame:
    both = [part_correlations(spark, sf, 9, m).withColumn("medium", F.lit(m)) for m in ("off", "on")]
    return sensitivity.level_frame(both[0].unionByName(both[1]), draws)


@query(
    "medium_levels",
    f"WITH {_parts(9)}, lv AS (SELECT 'off' AS medium, society, avg(off_) AS v FROM co GROUP BY society UNION ALL SELECT 'on', society, avg(on_) FROM co GROUP BY society), rg AS (SELECT medium, max(v) - min(v) AS r FROM lv GROUP BY medium) "
    f"SELECT medium, society, {q6('v')} AS value, {q6('r')} AS range FROM lv JOIN rg USING (medium)",
)
def medium_levels(spark, sf):
    """Mean |r| of each region in each medium, and the range over the regions."""
    return rounded(_levels(spark, sf, 0).select("medium", "society", "value", "range"), "value", "range")


@query("medium_level_limits")
def medium_level_limits(spark, sf):
    return rounded(_levels(spark, sf, 2000), "value", "value_lo", "value_hi", "range", "range_lo", "range_hi")


# --- identical items --------------------------------------------------------------------------------------------------
def _media_values(spark, sf) -> DataFrame:
    """(user_id, items, society, topic, value): the two media as two sets of the same nine items."""
    media = F.array(*[F.struct(F.lit(m).alias("items"), F.col(m).alias("value")) for m in ("off", "on")])
    return part_opinions(spark, sf, 9).select("user_id", "society", "topic", F.explode(media).alias("m")).select("user_id", "m.items", "society", "topic", "m.value")


def _item_gaps(spark, sf, draws: int) -> DataFrame:
    rows = sensitivity.common_topics(_media_values(spark, sf), ("AMERICA", "ASIA"), ("items",))
    found = correlation.pairwise(correlation.topic_pairs(rows, ("user_id", "items", "society")), ("items", "society"))
    return sensitivity.level_gaps(found.withColumn("y", F.abs("r")), "AMERICA", "ASIA", ("items",), draws)


@query(
    "identical_item_gaps",
    f"WITH {_parts(9)}, lg AS (SELECT 'off' AS items, user_id, society, topic, off_ AS v FROM op UNION ALL SELECT 'on', user_id, society, topic, on_ FROM op), "
    "ft AS (SELECT items, topic FROM lg WHERE society IN ('AMERICA', 'ASIA') AND v IS NOT NULL GROUP BY ALL HAVING count(DISTINCT society) = 2), lk AS (SELECT lg.* FROM lg JOIN ft USING (items, topic) WHERE v IS NOT NULL), "
    "rr AS (SELECT a.items, a.society, abs(corr(a.v, b.v)) AS r FROM lk a JOIN lk b ON a.items = b.items AND a.user_id = b.user_id AND a.society = b.society AND a.topic < b.topic GROUP BY a.items, a.society, a.topic, b.topic), "
    "mn AS (SELECT items, avg(r) FILTER (society = 'AMERICA') AS a, avg(r) FILTER (society = 'ASIA') AS b, count(r) FILTER (society = 'AMERICA') AS na, count(r) FILTER (society = 'ASIA') AS nb FROM rr GROUP BY items) "
    f"SELECT items, na AS pairs_first, nb AS pairs_second, {q6('a')} AS mean_first, {q6('b')} AS mean_second, {q6('a - b')} AS gap, {q6('a / b')} AS ratio FROM mn",
)
def identical_item_gaps(spark, sf):
    """Mean |r| of two regions on the items that both answered, their gap and ratio."""
    found = _item_gaps(spark, sf, 0).select("items", "pairs_first", "pairs_second", "mean_first", "mean_second", "gap", "ratio")
    return rounded(found, "mean_first", "mean_second", "gap", "ratio")


@query("identical_item_limits")
def identical_item_limits(spark, sf):
    found = _item_gaps(spark, sf, 2000)
    return rounded(found, *[c for c in found.columns if c not in ("items", "pairs_first", "pairs_second")])


@query("identical_item_spectra")
def identical_item_spectra(spark, sf):
    """Spectral numbers of both regions on identical items, also as shares of the topics, with limits of 2,000 draws of users."""
    rows = sensitivity.common_topics(_media_values(spark, sf), ("AMERICA", "ASIA"), ("items",))
    found = spectral.spectral_table(rows, by=("items", "society"))
    return rounded(found, *[c for c in found.columns if c not in ("items", "society")])


@query("period_spectral_table")
def period_spectral_table(spark, sf):
    """The same of two halves of the years, averaged over the years of each in every draw."""
    rows = values(spark, sf).withColumn("half", F.when(F.col("year") < 1998, "early").otherwise("late"))
    found = spectral.spectral_table(rows, by=("half",), over=("year",))
    return rounded(found, *[c for c in found.columns if c != "half"])


# --- ellipses ---------------------------------------------------------------------------------------------------------
STRETCH = 2.5
_CASES = f"{PAIRS}, cs AS (SELECT user_id, year, x, y FROM pairs WHERE t1 = '1-URGENT' AND t2 = '2-HIGH'), cm AS (SELECT year, count(*) AS n, {CORR} AS r, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM cs GROUP BY year), ce AS (SELECT *, CASE WHEN r < 0 THEN -45.0::DOUBLE ELSE 45.0 END AS angle, pow(greatest((1+abs(r))*n/(n-1), 1e-12), {STRETCH}/2) AS major, pow(greatest((1-abs(r))*n/(n-1), 1e-12), {STRETCH}/2) AS minor FROM cm WHERE n >= 5 AND r IS NOT NULL)"


def _case(spark, sf) -> DataFrame:
    return the_pairs(spark, sf).where("t1 = '1-URGENT' and t2 = '2-HIGH'")


@query("case_study_ellipses", f"WITH {_CASES} SELECT year, n, {q6('r')} AS r, angle, {q6('major')} AS major, {q6('minor')} AS minor FROM ce")
def case_study_ellipses(spark, sf):
    """Stretched correlation ellipse of two topics in each year."""
    return rounded(portraits.ellipses(_case(spark, sf), ["year"], stretch=STRETCH), "r", "major", "minor")


@query(
    "case_study_outlines",
    f"WITH {_CASES}, o AS (SELECT year, k, 2*major*cos(k*2*pi()/64) AS u, 2*minor*sin(k*2*pi()/64) AS v, radians(angle) AS a FROM ce, (SELECT unnest(range(64)) AS k)) SELECT year, CAST(k AS INT) AS point, {q6('u*cos(a) - v*sin(a)')} AS x, {q6('u*sin(a) + v*cos(a)')} AS y FROM o",
)
def case_study_outlines(spark, sf):
    found = portraits.ellipses(_case(spark, sf), ["year"], stretch=STRETCH)
    return rounded(portraits.outlines(found, ["year"]), "x", "y")


@query(
    "case_study_clouds",
    f"WITH {_CASES}, s AS (SELECT year, mx, my, sx, sy, pow(greatest((1+r)*n/(n-1), 1e-12), {STRETCH - 1}/2) AS u, pow(greatest((1-r)*n/(n-1), 1e-12), {STRETCH - 1}/2) AS v FROM ce) "
    f"SELECT user_id, year, {q6('((u+v)*(x-mx)/sx + (u-v)*(y-my)/sy)/2')} AS zx, {q6('((u-v)*(x-mx)/sx + (u+v)*(y-my)/sy)/2')} AS zy FROM cs JOIN s USING (year)",
)
def case_study_clouds(spark, sf):
    """All users' standardised and stretched points, whose ellipses are those of ``case_study_ellipses``."""
    found = portraits.stretched_points(_case(spark, sf), ["year"], stretch=STRETCH)
    return rounded(found.select("user_id", "year", "zx", "zy"), "zx", "zy")


# --- complete rows ----------------------------------------------------------------------------------------------------
def _complete(spark, sf) -> tuple[DataFrame, list[str]]:
    averages = panel.pooled_average(the_panel(spark, sf))
    cols = spectral.topic_names(averages)
    return panel.wide_matrix(averages, cols, ("user_id",), "average"), cols


@query("listwise_components")
def listwise_components(spark, sf):
    """Components of the users with an average for every topic."""
    return portraits.listwise_components(*_complete(spark, sf))


@query(
    "listwise_score_lengths",
    f"WITH {PANEL}, w AS (SELECT user_id, topic, sum(total)/sum(cnt) AS m FROM panel WHERE topic IS NOT NULL GROUP BY ALL), k AS (SELECT user_id FROM w WHERE m IS NOT NULL GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT topic) FROM w)), "
    f"c AS (SELECT user_id, topic, m - avg(m) OVER (PARTITION BY topic) AS d FROM w JOIN k USING (user_id)) SELECT user_id, {q6('sqrt(sum(d*d))')} AS length FROM c GROUP BY user_id",
)
def listwise_score_lengths(spark, sf):
    """Length of each complete user's scores on all components: the distance from the mean."""
    wide, cols = _complete(spark, sf)
    scores = portraits.listwise_scores(wide, cols, portraits.listwise_components(wide, cols), ["user_id"])
    return rounded(scores.groupBy("user_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length")), "length")


@query(
    "rebuilt_covariance",
    f"WITH {PANEL}, m AS (SELECT year, topic, avg(mean) AS m FROM panel GROUP BY ALL), s AS (SELECT a.year, a.topic AS t1, b.topic AS t2, count(*) AS n, sum(a.mean*b.mean) AS s FROM panel a JOIN panel b ON a.user_id = b.user_id AND a.year = b.year AND a.topic <= b.topic GROUP BY ALL) "
    f"SELECT x.year, x.topic AS t1, y.topic AS t2, {q6('CASE WHEN n > 1 THEN (s - n*x.m*y.m)/(n-1) ELSE 0.0 END')} AS cov FROM m x JOIN m y ON x.year = y.year AND x.topic <= y.topic LEFT JOIN s ON s.year = x.year AND s.t1 = x.topic AND s.t2 = y.topic",
)
def rebuilt_covariance(spark, sf):
    """Every year's covariance, rebuilt from its report of components: all pairs of its topics, 0 for those that no user has both of."""
    return rounded(portraits.rebuilt_covariance(spectral.loading_report(values(spark, sf))), "cov")


# --- weights within a medium ------------------------------------------------------------------------------------------
_MEDIA_PAIRS = (
    f"{_parts(9)}, md AS (SELECT * FROM (SELECT 'off' AS medium, society, t1, t2, on_ AS x, off_ AS y FROM co UNION ALL SELECT 'on', society, t1, t2, off_, on_ FROM co WHERE society <> 'EUROPE') WHERE x IS NOT NULL AND y IS NOT NULL), "
    "mb AS (SELECT medium, max(lo) AS lo, min(hi) AS hi FROM (SELECT medium, society, min(x) AS lo, max(x) AS hi FROM md GROUP BY ALL) GROUP BY medium), "
    "mk AS (SELECT 'all' AS kept, md.* FROM md UNION ALL SELECT 'support', md.* FROM md JOIN mb USING (medium) WHERE x BETWEEN lo AND hi), "
    "mr AS (SELECT kept, medium, coalesce(max(society) FILTER (society = 'EUROPE'), min(society)) AS reference FROM mk GROUP BY ALL), "
    "mh AS (SELECT kept, medium, society, count(*) AS n, var_samp(x) * pow(count(*), -0.4) AS h2 FROM mk GROUP BY ALL), "
    "mo AS (SELECT p.kept, p.medium, p.society, p.t1, p.t2, sum(exp(-((p.x - q.x) * (p.x - q.x)) / (2*h2))) / (max(n) * sqrt(2*pi()*max(h2))) AS d FROM mk p JOIN mk q USING (kept, medium, society) JOIN mh USING (kept, medium, society) GROUP BY ALL), "
    "mf AS (SELECT p.kept, p.medium, r.reference, p.society, p.t1, p.t2, p.x, p.y, sum(exp(-((p.x - q.x) * (p.x - q.x)) / (2*h2))) / (max(n) * sqrt(2*pi()*max(h2))) AS d FROM mk p JOIN mr r USING (kept, medium) JOIN mk q ON q.kept = p.kept AND q.medium = p.medium AND q.society = r.reference "
    "JOIN mh h ON h.kept = p.kept AND h.medium = p.medium AND h.society = r.reference GROUP BY ALL), "
    "mw AS (SELECT mf.*, CASE WHEN mf.society = reference THEN 1.0 ELSE mf.d / greatest(mo.d, 1e-300) END AS w FROM mf JOIN mo USING (kept, medium, society, t1, t2))"
)


@query("medium_pair_weights", f"WITH {_MEDIA_PAIRS} SELECT kept, medium, reference, society, t1, t2, {q6('w / sum(w) OVER (PARTITION BY kept, medium, society)')} AS w FROM mw")
def medium_pair_weights(spark, sf):
    """Weights of each region's pairs in each medium, over all pairs and those on the medium's support; each medium's |r| stands for
    the similarity in the other, and one medium lacks the preferred region."""
    return rounded(_medium_weights(spark, sf).select("kept", "medium", "reference", "society", "t1", "t2", "w"), "w")


@query("medium_matched_levels", f"WITH {_MEDIA_PAIRS} SELECT kept, medium, reference, society, count(*) AS pairs, {q6('avg(y)')} AS raw, {q6('sum(w*y)/sum(w)')} AS matched, {q6('sum(w)*sum(w)/sum(w*w)')} AS ess FROM mw GROUP BY ALL")
def medium_matched_levels(spark, sf):
    """Mean |r| of each region before and after its pairs are matched to the reference of their medium, with the effective number of pairs."""
    w, y = F.col("w"), F.col("y")
    rows = _medium_weights(spark, sf).groupBy("kept", "medium", "reference", "society")
    return rounded(rows.agg(F.count(F.lit(1)).alias("pairs"), F.avg("y").alias("raw"), (F.sum(w * y) / F.sum("w")).alias("matched"), (F.sum("w") * F.sum("w") / F.sum(w * w)).alias("ess")), "raw", "matched", "ess")


def _medium_weights(spark, sf) -> DataFrame:
    on = part_correlations(spark, sf, 9, "on").withColumnRenamed("y", "_on")
    both = part_correlations(spark, sf, 9, "off").join(on, ["society", "t1", "t2"])
    media = F.array(F.struct(F.lit("off").alias("medium"), F.col("_on").alias("x"), F.col("y")), F.struct(F.lit("on").alias("medium"), F.col("y").alias("x"), F.col("_on").alias("y")))
    pairs = both.select("society", "t1", "t2", F.explode(media).alias("m")).select("m.medium", "society", "t1", "t2", "m.x", "m.y")
    pairs = cut_lineage(pairs.where("not (medium = 'on' and society = 'EUROPE')"), "media_pairs")
    return reduce(DataFrame.unionByName, [adjustment.medium_weights(pairs, "EUROPE", kept == "support").withColumn("kept", F.lit(kept)) for kept in ("all", "support")])
