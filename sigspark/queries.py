"""The query catalogue: each operator over the driver tables, and the same in DuckDB SQL.

The library's own defaults are meant for recordings; the tables' values are closer to noise, so that these
queries pass parameters under which every operator has something to find. Irrational
results are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import EPS, fade_gain, from_db, safe_name, to_db
from .operators import events as ev
from .operators import framing as fr
from .operators import levels as lv
from .operators import silence as si
from .operators import spectra as sp
from .operators.framing import KEY
from .operators.intervals import consecutive, inside_spans, merge_runs, runs_of_true
from .sources import signals as sg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

W, H = 20, 10
RUNGS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """df with the named columns rounded; -0 becomes 0."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def lengths(samples: DataFrame) -> DataFrame:
    """(recording_id, n) of samples."""
    return samples.groupBy(KEY).agg((F.max("idx") + 1).alias("n"))


# --- common table expressions of the SQL side -------------------------------------------------
S = "s AS (SELECT event_id AS idx, value / 600.0 AS v FROM events), n AS (SELECT count(*) AS n FROM s)"
FRAMES = f"""{S}, fr AS (
  SELECT f.frame, sqrt(sum(s.v * s.v) / {W} + 1e-12) AS rms
  FROM (SELECT unnest(range(0, (SELECT (n - {W}) // {H} + 1 FROM n))) AS frame) f
  JOIN s ON s.idx BETWEEN f.frame * {H} AND f.frame * {H} + {W - 1} GROUP BY 1),
fd AS (SELECT frame, rms, 20 * log10(greatest(abs(rms), 1e-12)) AS db FROM fr)"""
REGIONS = f"""{FRAMES}, th AS (SELECT quantile_cont(db, 0.05) + 2 AS t FROM fd),
q AS (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS g FROM fd, th WHERE db <= t),
rr AS (SELECT min(frame) AS f0, max(frame) + 1 AS f1 FROM q GROUP BY g HAVING count(*) >= 2),
reg AS (SELECT f0, f1, CASE WHEN f0 = 0 THEN 0 ELSE f0 * {H} END AS start_idx,
        CASE WHEN f1 = (SELECT max(frame) + 1 FROM fd) THEN (SELECT n FROM n) ELSE (f1 - 1) * {H} + {W} END AS end_idx FROM rr)"""
VALLEYS = f"""sm AS (SELECT frame, sum(db) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM fd),
lm AS (SELECT frame, smooth, min(smooth) OVER (ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l,
       min(smooth) OVER (ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS r FROM sm),
va AS (SELECT frame, smooth, p - smooth AS depth FROM lm, (SELECT quantile_cont(smooth, 0.9) AS p FROM sm)
       WHERE smooth < l AND smooth < r AND smooth <= p - 2)"""


def _mean(x: str, width: int, table: str = "s") -> str:
    """Centred mean with the full window at the left edge."""
    half = width // 2
    return (
        f"CASE WHEN idx < {half} THEN (SELECT avg({x}) FROM {table} WHERE idx < {width}) "
        f"ELSE avg({x}) OVER (ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {width - half - 1} FOLLOWING) END"
    )


RATIO = f"{S}, ra AS (SELECT idx, v, ({_mean('v * v', 3)}) / (({_mean('v * v', 41)}) + 1e-12) AS ratio FROM s)"
CURVE = f"""{S}, cu AS (SELECT idx, v, coalesce(lead(v) OVER (ORDER BY idx) - 2 * v + lag(v) OVER (ORDER BY idx), 0) AS c FROM s),
cr AS (SELECT idx, v, c, abs(c) / (({_mean('abs(c)', 41, 'cu')}) + 1e-12) AS ratio FROM cu)"""


def _runs(source: str, where: str, name: str = "ru") -> str:
    return f"""{name} AS (SELECT min(idx) AS start_idx, max(idx) + 1 AS end_idx FROM
 (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS g FROM {source} WHERE {where}) GROUP BY g)"""


USERS = "us AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 600.0 AS v FROM events)"
TYPES = "ty AS (SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value / 600.0 AS v FROM events)"


# --- framing, silence, boundaries ---------------------------------------------------------------
def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = sg.events_mono(spark, sf_dir)
    return samples, fr.hop_frames(samples, W, H)


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples, frames = _frames(spark, sf_dir)
    floor = frames.groupBy(KEY).agg((F.percentile("db", F.lit(0.05)) + 2).alias("threshold_db"))
    return samples, frames, si.regions(frames, floor, lengths(samples), W, H, 2)


@query("silence_regions", f"WITH {REGIONS} SELECT start_idx::BIGINT AS start_idx, end_idx::BIGINT AS end_idx, (f1 - f0)::BIGINT AS n_frames FROM reg")
def silence_regions(spark, sf_dir):
    return _regions(spark, sf_dir)[2].select("start_idx", "end_idx", (F.col("end_frame") - F.col("start_frame")).alias("n_frames"))


@query("rms_profile", f"WITH {FRAMES} SELECT frame, {r6('rms')} AS rms, {r6('db')} AS db FROM fd")
def rms_profile(spark, sf_dir):
    return rounded(_frames(spark, sf_dir)[1].select("frame", "rms", "db"), "rms", "db")


@query("surface_noise", f"""WITH {FRAMES}, q AS (SELECT quantile_cont(db, 0.05) AS a, quantile_cont(db, 0.1) AS b FROM fd),
sd AS (SELECT stddev_pop(db) AS s FROM fd, q WHERE db <= b)
SELECT {r6('a')} AS noise_floor_db, {r6('s')} AS stability_db, {r6('least(greatest(1 - s / 6, 0.1), 0.99)')} AS confidence FROM q, sd""")
def surface_noise(spark, sf_dir):
    return rounded(lv.noise_floor(_frames(spark, sf_dir)[1]).drop(KEY), "noise_floor_db", "stability_db", "confidence")


@query("music_edges", f"""WITH {REGIONS}, x AS (SELECT f0, f1, frame, db FROM reg JOIN fd ON frame >= f0 AND frame < f1),
st AS (SELECT f0, min(db) AS mi, median(db) AS me FROM x GROUP BY 1)
SELECT x.f0 AS start_frame, x.f1 AS end_frame, min(frame) FILTER (WHERE db <= mi + 0.5) AS end_of_music, max(frame) FILTER (WHERE db <= me + 0.5) AS start_of_music
FROM x JOIN st USING (f0) GROUP BY 1, 2""")
def music_edges(spark, sf_dir):
    _, frames, found = _regions(spark, sf_dir)
    return si.music_edges(frames, found, 0.5).drop(KEY)


@query("rms_valleys", f"WITH {FRAMES}, {VALLEYS} SELECT frame, {r6('smooth')} AS smooth, {r6('depth')} AS depth_db FROM va")
def rms_valleys(spark, sf_dir):
    return rounded(si.valleys(_frames(spark, sf_dir)[1], 5, 5, 2.0).drop(KEY), "smooth", "depth_db")


@query("boundary_candidates", f"""WITH {REGIONS}, {VALLEYS}
SELECT ((start_idx + end_idx) // 2)::BIGINT AS sample, 'silence' AS method FROM reg WHERE start_idx > 0 AND end_idx < (SELECT n FROM n)
UNION ALL SELECT (frame * {H})::BIGINT, 'rms_valley' FROM va""")
def boundary_candidates(spark, sf_dir):
    _, frames, found = _regions(spark, sf_dir)
    return si.candidates(found, si.valleys(frames, 5, 5, 2.0), H).drop(KEY)


@query("playable_region", f"""WITH {REGIONS} SELECT (SELECT min(end_idx) FROM reg WHERE start_idx = 0)::BIGINT AS lead_in_end_sample,
(SELECT max(start_idx) FROM reg WHERE end_idx = (SELECT n FROM n))::BIGINT AS lead_out_start_sample""")
def playable_region(spark, sf_dir):
    samples, _, found = _regions(spark, sf_dir)
    return si.playable(found, lengths(samples)).drop(KEY)


@query("running_median", f"""WITH {FRAMES}, k AS (SELECT unnest(range(-4, 5)) AS d),
m AS (SELECT a.frame, median(b.db) AS m FROM fd a, k JOIN fd b ON b.frame = least(greatest(a.frame + k.d, 0), (SELECT max(frame) FROM fd)) GROUP BY 1)
SELECT frame, {r6('m')} AS level FROM m""")
def running_median(spark, sf_dir):
    return rounded(fr.running_median(_frames(spark, sf_dir)[1], "db", 9, "level").select("frame", "level"), "level")


# --- levels -----------------------------------------------------------------------------------
@query("gated_rms_album", f"""WITH {USERS}, fx AS (SELECT user_id, (max(idx) + 1 - {2 * W}) // {H} AS last FROM us GROUP BY 1),
b AS (SELECT us.user_id, f.frame, sum(v * v) / count(*) + 1e-12 AS p FROM us JOIN (SELECT user_id, unnest(range(0, greatest(last, 0) + 1)) AS frame FROM fx) f
  ON us.user_id = f.user_id AND us.idx BETWEEN f.frame * {H} AND f.frame * {H} + {2 * W - 1} GROUP BY 1, 2),
l AS (SELECT user_id % 10 AS album, p, 10 * log10(p) AS l FROM b),
a AS (SELECT album, avg(p) FILTER (WHERE l > -70) AS m, count(*) AS n_blocks, count(*) FILTER (WHERE l > -70) AS n_absolute FROM l GROUP BY 1),
g AS (SELECT l.album, n_blocks, n_absolute, p, l, 10 * log10(m) - 1 AS gate FROM l JOIN a USING (album))
SELECT album, n_blocks, n_absolute, count(*) FILTER (WHERE l > gate) AS n_relative, {r6('10 * log10(avg(p) FILTER (WHERE l > gate))')} AS level_db
FROM g GROUP BY 1, 2, 3""")
def gated_rms_album(spark, sf_dir):
    blocks = fr.hop_frames(sg.events_by(spark, sf_dir, "user_id"), 2 * W, H)
    blocks = blocks.withColumn("album", F.col(KEY).cast("long") % 10)
    power = F.col("rms") * F.col("rms")
    got = lv.gated_level(blocks, power, 10 * F.log10(power), ("album",), relative=-1.0)
    return rounded(got.select("album", "n_blocks", "n_absolute", "n_relative", "level_db"), "level_db")


@query("lufs_gate", f"""WITH {TYPES}, fx AS (SELECT rec, max(idx) + 1 AS n FROM ty GROUP BY 1),
b AS (SELECT ty.rec, f.frame, sum(v * v) / {2 * W} AS p FROM ty JOIN (SELECT rec, unnest(range(0, (n - {2 * W}) // {H} + 1)) AS frame FROM fx WHERE n >= {2 * W}) f
  ON ty.rec = f.rec AND ty.idx BETWEEN f.frame * {H} AND f.frame * {H} + {2 * W - 1} GROUP BY 1, 2),
l AS (SELECT rec, p, -0.691 + 10 * log10(p) AS l FROM b),
a AS (SELECT rec, avg(p) FILTER (WHERE l > -70) AS m, count(*) AS n_blocks FROM l GROUP BY 1),
g AS (SELECT l.rec, n_blocks, p, l, -0.691 + 10 * log10(m) - 1 AS gate FROM l JOIN a USING (rec))
SELECT rec AS recording_id, n_blocks, count(*) FILTER (WHERE l > gate) AS n_relative, {r6('-0.691 + 10 * log10(avg(p) FILTER (WHERE l > gate))')} AS lufs FROM g GROUP BY 1, 2""")
def lufs_gate(spark, sf_dir):
    blocks = fr.power_blocks(sg.events_by(spark, sf_dir, "event_type"), 2 * W, H)
    got = lv.gated_level(blocks, F.col("power"), -0.691 + 10 * F.log10(F.greatest("power", F.lit(EPS * EPS))), (KEY,), relative=-1.0, offset=-0.691)
    return rounded(got.select(KEY, "n_blocks", "n_relative", F.col("level_db").alias("lufs")), "lufs")


PEAKS = f"""{TYPES}, pk AS (SELECT rec, max(abs(v)) AS p, sqrt(avg(v * v) + 1e-12) AS r FROM ty GROUP BY 1),
po AS (SELECT pk.rec, min(idx) AS i FROM pk JOIN ty ON ty.rec = pk.rec AND abs(ty.v) = p GROUP BY 1)"""


@query("peaks", f"""WITH {PEAKS} SELECT rec AS recording_id, {r6('20 * log10(p)')} AS peak_db, i AS peak_sample, {r6('20 * log10(r)')} AS rms_db,
{r6('20 * log10(p) - 20 * log10(r)')} AS crest_factor_db FROM pk JOIN po USING (rec)""")
def peaks(spark, sf_dir):
    return rounded(lv.peaks(sg.events_by(spark, sf_dir, "event_type")), "peak_db", "rms_db", "crest_factor_db")


@query("dynamic_range", f"""WITH {FRAMES} SELECT {r6('(SELECT 20 * log10(max(abs(v))) FROM s) - quantile_cont(db, 0.95)')} AS dr_estimate_db, {r6('quantile_cont(db, 0.95)')} AS loud_rms_db,
{r6('quantile_cont(db, 0.05)')} AS p05, {r6('quantile_cont(db, 0.5)')} AS p50, {r6('quantile_cont(db, 0.95)')} AS p95 FROM fd""")
def dynamic_range(spark, sf_dir):
    samples, frames = _frames(spark, sf_dir)
    return rounded(lv.dynamic_range(frames, lv.peaks(samples)).drop(KEY), "dr_estimate_db", "loud_rms_db", "p05", "p50", "p95")


@query("recording_info", f"""WITH x AS (SELECT l_returnflag AS recording_id, l_extendedprice / 1e5 AS l, l_quantity / 50 AS r FROM lineitem),
a AS (SELECT recording_id, avg(l) AS dl, avg(r) AS dr, 20 * log10(max(abs(l))) AS pl, 20 * log10(max(abs(r))) AS pr, 20 * log10(sqrt(avg(l * l) + 1e-12)) AS rl, 20 * log10(sqrt(avg(r * r) + 1e-12)) AS rr, corr(l, r) AS c FROM x GROUP BY 1)
SELECT recording_id, {r6('dl')} AS dc_left, {r6('dr')} AS dc_right, {r6('pl')} AS peak_left_db, {r6('pr')} AS peak_right_db, {r6('rl')} AS rms_left_db, {r6('rr')} AS rms_right_db, {r6('rl - rr')} AS balance_db, {r6('c')} AS correlation FROM a""")
def recording_info(spark, sf_dir):
    got = lv.stereo_info(sg.lineitem_stereo(spark, sf_dir))
    return rounded(got, *[c for c in got.columns if c != KEY])


@query("clipping", f"""WITH {S}, {_runs('s', 'abs(v) >= 0.3')} SELECT (SELECT count(*) FROM s WHERE abs(v) >= 0.3) AS clipped_samples, count(*) FILTER (WHERE end_idx - start_idx >= 2) AS clipped_runs,
coalesce(max(end_idx - start_idx), 0) AS longest_run, {r6('(SELECT count(*) FROM s WHERE abs(v) >= 0.3) / (SELECT n FROM n)')} AS clipped_ratio FROM ru""")
def clipping(spark, sf_dir):
    return rounded(lv.clipping(sg.events_mono(spark, sf_dir), 0.3, 2).drop(KEY), "clipped_ratio")


@query("histogram_clipped", f"""WITH {S}, b AS (SELECT least(floor((least(greatest(v, 0.05), 0.45) - 0.05) * 10 / (0.45 - 0.05)), 9)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1)
SELECT r.bin, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b USING (bin)""")
def histogram_clipped(spark, sf_dir):
    return lv.histogram(sg.events_mono(spark, sf_dir), F.col("v"), 0.05, 0.45, 10)


@query("remove_dc", f"WITH {TYPES} SELECT rec AS recording_id, idx, {r6('v - avg(v) OVER (PARTITION BY rec)')} AS v FROM ty")
def remove_dc(spark, sf_dir):
    return rounded(lv.remove_dc(sg.events_by(spark, sf_dir, "event_type")), "v").select(KEY, "idx", "v")


@query("acf_at_lag", f"""WITH {S}, x AS (SELECT idx, v - (SELECT avg(v) FROM s) AS v FROM s)
SELECT {r6('(SELECT sum(a.v * b.v) FROM x a JOIN x b ON b.idx = a.idx + 7) / (SELECT sum(v * v) FROM x)')} AS r""")
def acf_at_lag(spark, sf_dir):
    return rounded(lv.correlation_at_lag(sg.events_mono(spark, sf_dir), 7).select("r"), "r")


# --- events -----------------------------------------------------------------------------------
@query("runs_of_true", f"WITH {S}, {_runs('s', 'v >= 0.3')} SELECT start_idx, end_idx FROM ru")
def runs(spark, sf_dir):
    return runs_of_true(sg.events_mono(spark, sf_dir), F.col("v") >= 0.3).drop(KEY)


@query("merge_runs", f"""WITH {S}, {_runs('s', 'v >= 0.2')}, f AS (SELECT *, CASE WHEN start_idx - max(end_idx) OVER (ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 THEN 0 ELSE 1 END AS w FROM ru),
g AS (SELECT *, sum(w) OVER (ORDER BY start_idx) AS g FROM f) SELECT min(start_idx) AS start_idx, max(end_idx) AS end_idx FROM g GROUP BY g""")
def merged_runs(spark, sf_dir):
    return merge_runs(runs_of_true(sg.events_mono(spark, sf_dir), F.col("v") >= 0.2), 5).drop(KEY)


@query("second_difference", f"WITH {CURVE} SELECT idx, {r6('c')} AS curvature FROM cu")
def second_difference(spark, sf_dir):
    return rounded(fr.second_difference(sg.events_mono(spark, sf_dir)).select("idx", "curvature"), "curvature")


@query("block_ratio_hits", f"WITH {RATIO}, {_runs('ra', 'ratio > 4')} SELECT start_idx, end_idx FROM ru")
def block_ratio_hits(spark, sf_dir):
    return ev.ratio_runs(fr.energy_ratio(sg.events_mono(spark, sf_dir), 3, 41), 4.0).drop(KEY)


@query("crackle_events", f"""WITH {CURVE}, {_runs('cr', 'ratio > 3')} SELECT start_idx, end_idx, {r6('max(abs(v))')} AS peak
FROM ru JOIN s ON idx >= start_idx AND idx < end_idx WHERE end_idx - start_idx <= 3 GROUP BY 1, 2""")
def crackle_events(spark, sf_dir):
    return rounded(ev.crackle(fr.curvature_ratio(sg.events_mono(spark, sf_dir), 41), 3.0, 3).drop(KEY), "peak")


@query("threshold_sweep", f"""WITH {RATIO}, h AS (SELECT t, idx FROM ra, (SELECT unnest([2.0, 3.0, 4.0, 5.0, 6.0, 8.0]) AS t) WHERE ratio > t),
g AS (SELECT t, idx, idx - row_number() OVER (PARTITION BY t ORDER BY idx) AS g FROM h)
SELECT t::DOUBLE AS threshold, count(DISTINCT g) AS events, count(*) AS samples FROM g GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    rows = fr.energy_ratio(sg.events_mono(spark, sf_dir), 3, 41)
    return ev.ladder(rows, RUNGS).groupBy("threshold").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("samples"))


@query("click_rates_by_region", f"""WITH {RATIO.replace(S, S)}, {_runs('ra', 'ratio > 3', 'hits')}, {REGIONS.removeprefix(S + ', ')},
h AS (SELECT start_idx AS p, EXISTS (SELECT 1 FROM reg WHERE p >= reg.start_idx AND p < reg.end_idx) AS inside FROM hits),
c AS (SELECT count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS o FROM h), d AS (SELECT coalesce(sum(end_idx - start_idx), 0) AS d FROM reg)
SELECT i AS inside, o AS outside, {r6('CASE WHEN d > 0 THEN i * 6000.0 / d END')} AS inside_rate, {r6('CASE WHEN n - d > 0 THEN o * 6000.0 / (n - d) END')} AS outside_rate FROM c, d, n""")
def click_rates_by_region(spark, sf_dir):
    samples, _, found = _regions(spark, sf_dir)
    hits = ev.ratio_runs(fr.energy_ratio(samples, 3, 41), 3.0)
    return rounded(ev.rates_by_region(hits, found, lengths(samples), 6000.0).drop(KEY), "inside_rate", "outside_rate")


@query("density_per_minute", f"""WITH {RATIO}, {_runs('ra', 'ratio > 3')}, b AS (SELECT greatest((SELECT n FROM n) // 1000, 1) AS b),
c AS (SELECT least(start_idx // 1000, b - 1) AS bucket, count(*) AS n FROM ru, b GROUP BY 1)
SELECT r.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT b FROM b))) AS bucket) r LEFT JOIN c USING (bucket)""")
def density_per_minute(spark, sf_dir):
    samples = sg.events_mono(spark, sf_dir)
    buckets = lengths(samples).select(KEY, F.greatest(F.floor(F.col("n") / 1000), F.lit(1)).cast("long").alias("buckets"))
    return fr.dense_counts(ev.ratio_runs(fr.energy_ratio(samples, 3, 41), 3.0), "start_idx", 1000, buckets).drop(KEY)


ONSETS = f"""{FRAMES}, ri AS (SELECT frame AS idx, greatest(lead(db) OVER (ORDER BY frame) - db, 0) AS rise FROM fd QUALIFY lead(db) OVER (ORDER BY frame) IS NOT NULL),
sg AS (SELECT 1.4826 * median(abs(rise - m)) AS sg FROM ri, (SELECT median(rise) AS m FROM ri)),
{_runs('ri, sg', 'rise > greatest(sg, 2)')}"""


@query("onset_density_per_second", f"""WITH {ONSETS}, b AS (SELECT greatest((SELECT n FROM n) // 1000, 1) AS b),
c AS (SELECT least(start_idx * {H} // 1000, b - 1) AS bucket, count(*) AS n FROM ru, b GROUP BY 1)
SELECT r.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT b FROM b))) AS bucket) r LEFT JOIN c USING (bucket)""")
def onset_density_per_second(spark, sf_dir):
    samples, frames = _frames(spark, sf_dir)
    buckets = lengths(samples).select(KEY, F.greatest(F.floor(F.col("n") / 1000), F.lit(1)).cast("long").alias("buckets"))
    found = ev.onsets(frames, 1.0, 2.0).withColumn("sample", F.col("frame") * H)
    return fr.dense_counts(found, "sample", 1000, buckets).drop(KEY)


@query("onset_coincidence", f"""WITH {RATIO}, {_runs('ra', 'ratio > 3')}, e AS (SELECT idx, sum(v * v) OVER (ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b, sum(v * v) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM s),
w AS (SELECT idx, CASE WHEN 10 * log10((a + 1e-12) / (b + 1e-12)) > 2 THEN 1 ELSE 0 END AS rises FROM e, n WHERE idx >= 10 AND idx < n - 10),
g AS (SELECT avg(rises) AS g, count(*) AS c FROM w WHERE (idx - 10) % 64 = 0), f AS (SELECT avg(rises) AS f, count(*) AS c FROM w JOIN ru ON idx = start_idx)
SELECT f.c AS events, {r6('f / greatest(g, 1.0 / g.c)')} AS coincidence FROM g, f""")
def onset_coincidence(spark, sf_dir):
    samples = sg.events_mono(spark, sf_dir)
    hits = ev.ratio_runs(fr.energy_ratio(samples, 3, 41), 3.0)
    return rounded(ev.onset_coincidence(samples, hits, 10, rise_db=2.0).drop(KEY), "coincidence")


@query("phase_concentration", f"""WITH {RATIO}, {_runs('ra', 'ratio > 3')}, p AS (SELECT 2 * pi() * ((start_idx % 180.0) / 180.0) AS a FROM ru), c AS (SELECT count(*) AS n, sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2) AS r FROM p)
SELECT n, {r6('r')} AS r, {r6('n * r * r')} AS z FROM c""")
def phase_concentration(spark, sf_dir):
    hits = ev.ratio_runs(fr.energy_ratio(sg.events_mono(spark, sf_dir), 3, 41), 3.0)
    return rounded(lv.phase_concentration(hits, "start_idx", 180.0).drop(KEY), "r", "z")


# --- spectra ------------------------------------------------------------------------------------
DFT = """e AS (SELECT label::VARCHAR AS recording_id, vec_id AS frame, unnest(range(64)) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings),
t AS (SELECT bin, idx, cos(2 * pi() * ((bin * idx) % 64) / 64) AS c, sin(2 * pi() * ((bin * idx) % 64) / 64) AS s FROM (SELECT unnest(range(33)) AS bin), (SELECT unnest(range(64)) AS idx)),
ps AS (SELECT recording_id, frame, bin, sum(v * c) ** 2 + sum(v * s) ** 2 AS power FROM e JOIN t USING (idx) GROUP BY 1, 2, 3)"""


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.power_spectrum(sg.embedding_frames(spark, sf_dir), 64)


@query("dft_band_levels", f"""WITH {DFT}, b AS (SELECT recording_id, frame, CASE WHEN bin >= 1 AND bin < 4 THEN 0 WHEN bin >= 4 AND bin < 12 THEN 1 WHEN bin >= 12 AND bin < 33 THEN 2 END AS band,
 power * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END / 4096 AS ms FROM ps)
SELECT recording_id, frame, band::INT AS band, {r6('10 * log10(greatest(sum(ms), 1e-24))')} AS db FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3""")
def dft_band_levels(spark, sf_dir):
    return rounded(sp.band_levels(_spectrum(spark, sf_dir), 64, (1, 4, 12, 33)), "db")


@query("spectral_centroid", f"""WITH {DFT}, c AS (SELECT recording_id, frame, sum(bin * sqrt(power)) / (sum(sqrt(power)) + 1e-12) AS c FROM ps GROUP BY 1, 2)
SELECT recording_id, {r6('avg(c)')} AS centroid_mean, {r6('stddev_pop(c)')} AS centroid_std FROM c GROUP BY 1""")
def spectral_centroid(spark, sf_dir):
    return rounded(sp.centroids(_spectrum(spark, sf_dir)), "centroid_mean", "centroid_std")


@query("spectral_rolloff", f"""WITH {DFT}, m AS (SELECT recording_id, bin, avg(power) AS p FROM ps GROUP BY 1, 2), r AS (SELECT recording_id, bin, sum(p) OVER (PARTITION BY recording_id ORDER BY bin) AS u, sum(p) OVER (PARTITION BY recording_id) AS a FROM m)
SELECT recording_id, min(bin) AS rolloff_bin FROM r WHERE u >= 0.85 * a GROUP BY 1""")
def spectral_rolloff(spark, sf_dir):
    return sp.rolloff(_spectrum(spark, sf_dir))


@query("spectral_flux", f"""WITH {DFT}, d AS (SELECT recording_id, frame, greatest(sqrt(power) - lag(sqrt(power)) OVER (PARTITION BY recording_id, bin ORDER BY frame), 0) AS d, lag(power) OVER (PARTITION BY recording_id, bin ORDER BY frame) AS l FROM ps)
SELECT recording_id, frame, {r6('sum(d)')} AS flux FROM d WHERE l IS NOT NULL GROUP BY 1, 2""")
def spectral_flux(spark, sf_dir):
    return rounded(sp.flux(_spectrum(spark, sf_dir)), "flux")


@query("run_out_settled", f"""WITH {DFT}, b AS (SELECT recording_id, frame, CASE WHEN bin >= 1 AND bin < 4 THEN 0 WHEN bin >= 4 AND bin < 12 THEN 1 WHEN bin >= 12 AND bin < 33 THEN 2 END AS band, power * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END / 4096 AS ms FROM ps),
l AS (SELECT recording_id, frame, band, 10 * log10(greatest(sum(ms), 1e-24)) AS db FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT *, row_number() OVER (PARTITION BY recording_id, band ORDER BY frame DESC) AS back FROM l),
tl AS (SELECT recording_id, band, median(db) AS m FROM x WHERE back <= 20 GROUP BY 1, 2),
o AS (SELECT l.recording_id, frame, bool_and(db <= m + 3) AS ok FROM l JOIN tl USING (recording_id, band) GROUP BY 1, 2)
SELECT recording_id, min(frame) FILTER (WHERE ok) AS start_frame FROM o GROUP BY 1""")
def run_out_settled(spark, sf_dir):
    from .operators.run_out import settled

    levels = sp.band_levels(_spectrum(spark, sf_dir), 64, (1, 4, 12, 33))
    return settled(levels, tail=20, margin=3.0, median_width=1)


# --- transforms ---------------------------------------------------------------------------------
TRACKS = "tr AS (SELECT unnest(range(0, (SELECT n // 500 FROM n))) AS k), tk AS (SELECT k AS track_index, k * 500 + 20 AS start_idx, k * 500 + 480 AS end_idx FROM tr)"


def _tracks(samples: DataFrame) -> DataFrame:
    count = lengths(samples).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 500) - 1)).alias("track_index"))
    return count.select(KEY, "track_index", (F.col("track_index") * 500 + 20).alias("start_idx"), (F.col("track_index") * 500 + 480).alias("end_idx"))


@query("split_with_fades", f"""WITH {S}, {TRACKS} SELECT track_index, idx - start_idx AS idx,
{r6('v * CASE WHEN idx - start_idx < 30 THEN 0.5 * (1 - cos(pi() * (idx - start_idx) / 30)) ELSE 1 END * CASE WHEN end_idx - 1 - idx < 50 THEN 0.5 * (1 - cos(pi() * (end_idx - 1 - idx) / 50)) ELSE 1 END')} AS v
FROM s JOIN tk ON idx >= start_idx AND idx < end_idx""")
def split_with_fades(spark, sf_dir):
    samples = sg.events_mono(spark, sf_dir)
    cut = inside_spans(samples, "idx", _tracks(samples))
    gain = fade_gain(F.col("idx"), F.col("start_idx"), F.col("end_idx"), F.lit(30), F.lit(50))
    return rounded(cut.select("track_index", (F.col("idx") - F.col("start_idx")).alias("idx"), (F.col("v") * gain).alias("v")), "v")


@query("normalize_album_peak", f"""WITH {TYPES}, g AS (SELECT round(-1 - 20 * log10(max(abs(v))), 4) AS g FROM ty) SELECT rec AS recording_id, count(*) AS n, {r6('max(abs(v)) * 10 ** (g / 20)')} AS peak, {r6('sum(v * 10 ** (g / 20))')} AS total FROM ty, g GROUP BY 1, g""")
def normalize_album_peak(spark, sf_dir):
    from .operators.transforms import album_peak_gain, apply_gain

    samples = sg.events_by(spark, sf_dir, "event_type")
    out = apply_gain(samples.withColumn("album", F.lit(0)), album_peak_gain(samples.withColumn("album", F.lit(0)), ("album",), -1.0), ("album",))
    return rounded(out.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"), F.sum("v").alias("total")), "peak", "total")


@query("normalize_track_peak", f"""WITH {TYPES}, g AS (SELECT rec, round(-1 - 20 * log10(max(abs(v))), 4) AS g FROM ty GROUP BY 1) SELECT rec AS recording_id, {r6('g')} AS gain_db, {r6('max(abs(v)) * 10 ** (g / 20)')} AS peak FROM ty JOIN g USING (rec) GROUP BY 1, g""")
def normalize_track_peak(spark, sf_dir):
    from .operators.transforms import album_peak_gain, apply_gain

    samples = sg.events_by(spark, sf_dir, "event_type")
    gains = album_peak_gain(samples, (KEY,), -1.0)
    return rounded(apply_gain(samples, gains, (KEY,), keep=True).groupBy(KEY, "gain_db").agg(F.max(F.abs("v")).alias("peak")), "gain_db", "peak")


@query("linear_repair", f"""WITH {CURVE}, {_runs('cr', 'ratio > 3')}, ok AS (SELECT start_idx, least(end_idx, (SELECT n - 1 FROM n)) AS hi, start_idx - 1 AS lo FROM ru WHERE end_idx - start_idx <= 3 AND start_idx > 0),
p AS (SELECT s.idx, s.v, a.v AS va, b.v AS vb, (s.idx - ok.lo) / (ok.hi - ok.lo) AS t FROM ok JOIN s ON s.idx > ok.lo AND s.idx < ok.hi JOIN s a ON a.idx = ok.lo JOIN s b ON b.idx = ok.hi)
SELECT idx, v, 0.25 * v + 0.75 * ((1 - t) * va + t * vb) AS repaired FROM p""")
def linear_repair(spark, sf_dir):
    from .operators.transforms import repair_linear

    samples = sg.events_mono(spark, sf_dir)
    events = ev.crackle(fr.curvature_ratio(samples, 41), 3.0, 3)
    # Not rounded: these values stand on ties of the sixth digit.
    return repair_linear(samples, events, 0.75).where("changed").select("idx", "v", "repaired")


@query("mono_merge_level", f"""WITH x AS (SELECT l_returnflag AS rec, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, l_extendedprice / 1e5 AS l, l_quantity / 50 AS r FROM lineitem),
f AS (SELECT rec, 1e-3 * sqrt((sum(l * l) + sum(r * r)) / (2 * count(*)) + 1e-12) AS f FROM x GROUP BY 1),
h AS (SELECT rec, avg(l * l) AS hl, avg(r * r) AS hr FROM x WHERE idx < 41 GROUP BY 1),
m AS (SELECT x.rec, idx, l, r, sqrt(CASE WHEN idx < 20 THEN hl ELSE avg(l * l) OVER (PARTITION BY x.rec ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) END) + f AS ll,
 sqrt(CASE WHEN idx < 20 THEN hr ELSE avg(r * r) OVER (PARTITION BY x.rec ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) END) + f AS lr FROM x JOIN f USING (rec) JOIN h USING (rec)),
g AS (SELECT rec, idx, l, r, (ll + lr) / 2 / ll AS gl, (ll + lr) / 2 / lr AS gr FROM m)
SELECT rec AS recording_id, count(*) AS n, {r6('avg((l * gl + r * gr) / 2)')} AS mean, {r6('min(least(gl, gr))')} AS min_gain, {r6('max(greatest(gl, gr))')} AS max_gain FROM g GROUP BY 1""")
def mono_merge_level(spark, sf_dir):
    from .operators.transforms import mono_merge

    out = mono_merge(sg.lineitem_stereo(spark, sf_dir), 41)
    got = out.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min(F.least("gain_l", "gain_r")).alias("min_gain"), F.max(F.greatest("gain_l", "gain_r")).alias("max_gain"))
    return rounded(got, "mean", "min_gain", "max_gain")


# --- documents, names, digests --------------------------------------------------------------------
@query("tags_resolve", """SELECT p_partkey AS track_index, trim(p_name) AS title, coalesce(nullif(s_name, ''), nullif(p_brand, ''), p_type) AS artist, p_brand AS album
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def tags_resolve(spark, sf_dir):
    from .plans.naming import resolve_tags

    tracks = sg.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_index"), F.trim("p_name").alias("title"), F.col("p_brand").alias("album_artist"), F.col("p_type").alias("fallback"), F.col("p_brand").alias("album"))
    tags = sg.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track_index"), F.col("s_name").alias("track_artist"))
    return resolve_tags(tracks, tags)


@query("orphan_metadata", "SELECT o_orderkey AS index FROM orders WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey)")
def orphan_metadata(spark, sf_dir):
    tags, tracks = sg.read(spark, sf_dir, "orders"), sg.read(spark, sf_dir, "part")
    return tags.join(tracks, tags["o_orderkey"] == tracks["p_partkey"], "left_anti").select(F.col("o_orderkey").alias("index"))


@query("filename_render", r"""WITH c AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(p_name || ': ' || p_type || '?', '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '[ .]+$', ''), '^$', 'untitled') AS t FROM part)
SELECT p_partkey AS track_index, lpad(p_partkey::VARCHAR, 6, '0') || ' - ' || t || '.flac' AS filename, count(*) OVER (PARTITION BY t) - 1 AS same_title FROM c""")
def filename_render(spark, sf_dir):
    from pyspark.sql import Window

    title = safe_name(F.concat("p_name", F.lit(": "), "p_type", F.lit("?")))
    rows = sg.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_index"), title.alias("t"))
    return rows.select("track_index", F.concat(F.lpad(F.col("track_index").cast("string"), 6, "0"), F.lit(" - "), "t", F.lit(".flac")).alias("filename"), (F.count(F.lit(1)).over(Window.partitionBy("t")) - 1).alias("same_title"))


@query("digest_verify", """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END) AS d FROM documents WHERE doc_id % 7 <> 5)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'unexpected' WHEN a.d = b.d THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def digest_verify(spark, sf_dir):
    from .plans.receipts import compare_digests

    docs = sg.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    expected = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return compare_digests(expected, docs.where("doc_id % 7 <> 5").select("doc_id", F.sha2(changed, 256).alias("sha256")), "doc_id")


@query("track_order_checks", """WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN p IS NULL AND turn <> 0 THEN 'does not start at 0' WHEN turn = p THEN 'repeated' WHEN turn <> p + 1 THEN 'gap' END AS problem FROM t WHERE (p IS NULL AND turn <> 0) OR (p IS NOT NULL AND turn <> p + 1)""")
def track_order_checks(spark, sf_dir):
    rows = consecutive(sg.read(spark, sf_dir, "conversations").select("conv_id", "turn"), ("turn",), ("turn",), ("conv_id",))
    problem = F.when(F.col("prev_turn").isNull() & (F.col("turn") != 0), "does not start at 0").when(F.col("turn") == F.col("prev_turn"), "repeated").when(F.col("turn") != F.col("prev_turn") + 1, "gap")
    return rows.select("conv_id", "turn", problem.alias("problem")).where("problem is not null")


@query("levels_round_trip", f"WITH {S} SELECT idx, {r6('20 * log10(greatest(abs(v), 1e-12))')} AS db, {r6('10 ** (20 * log10(greatest(abs(v), 1e-12)) / 20)')} AS amplitude FROM s")
def levels_round_trip(spark, sf_dir):
    rows = sg.events_mono(spark, sf_dir).select("idx", to_db(F.col("v")).alias("db"))
    return rounded(rows.withColumn("amplitude", from_db(F.col("db"))), "db", "amplitude")


# --- kernels over blocks: rows only, but for the resampler ---------------------------------------
def _taps() -> str:
    from .functions.kernels import resampling_filter

    return ", ".join(map(repr, resampling_filter(3, 2).tolist()))


@query("resample_rational", f"""WITH {S}, h AS (SELECT unnest(range(61)) AS k, unnest([{_taps()}]) AS h), o AS (SELECT unnest(range(0, ((SELECT n FROM n) * 3 + 1) // 2)) AS m)
SELECT m AS idx, {r6('sum(coalesce(s.v, 0) * h)')} AS v FROM o JOIN h ON (m * 2 + 30 - k) % 3 = 0 LEFT JOIN s ON s.idx = (m * 2 + 30 - k) // 3 AND m * 2 + 30 - k >= 0 GROUP BY 1""")
def resample_rational(spark, sf_dir):
    from .operators.blocks import resampled

    return rounded(resampled(sg.events_mono(spark, sf_dir), 3, 2, 4096).select("idx", "v"), "v")


@query("true_peak_cap")
def true_peak_cap(spark, sf_dir):
    from .operators.blocks import true_peaks
    from .operators.transforms import album_peak_gain

    samples = sg.events_by(spark, sf_dir, "event_type")
    peaks = true_peaks(samples).withColumn("true_peak_db", to_db(F.col("true_peak")))
    gains = album_peak_gain(samples, (KEY,), -0.5, -1.0, peaks.select(KEY, "true_peak_db"))
    return rounded(gains.join(peaks, KEY).select(KEY, "gain_db", "true_peak_db"), "gain_db", "true_peak_db")


@query("biquad_k_weight")
def biquad_k_weight(spark, sf_dir):
    from .operators.blocks import k_weighted

    return rounded(k_weighted(lv.remove_dc(sg.events_mono(spark, sf_dir)), 8000).select("idx", "v"), "v")


@query("subsonic_highpass")
def subsonic_highpass(spark, sf_dir):
    from .operators.blocks import subsonic

    return rounded(subsonic(sg.events_mono(spark, sf_dir), 8000, 25.0, 24).select("idx", "v"), "v")


@query("click_ladder")
def click_ladder(spark, sf_dir):
    from .operators.clicks import detect

    return rounded(detect(lv.remove_dc(sg.events_mono(spark, sf_dir)), 8000, RUNGS, highpass=1500.0).drop(KEY), "peak")


@query("clicks_confirmed")
def clicks_confirmed(spark, sf_dir):
    from .operators.clicks import confirm, detect

    samples = lv.remove_dc(sg.events_mono(spark, sf_dir))
    return rounded(confirm(samples, detect(samples, 8000, (3.0,), highpass=1500.0), 2.0).select("start_idx", "end_idx", "peak"), "peak")


def _repaired(spark, sf_dir, method: str) -> DataFrame:
    from .operators.clicks import repair

    samples = sg.events_mono(spark, sf_dir)
    events = ev.crackle(fr.curvature_ratio(samples, 41), 3.0, 3)
    fixed = repair(samples, events, method, 0.75, order=11).withColumnRenamed("v", "repaired")
    return rounded(samples.join(fixed, [KEY, "idx"]).where("abs(v - repaired) > 1e-12").select("idx", "v", "repaired"), "v", "repaired")


@query("hermite_repair")
def hermite_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, "hermite")


@query("ar_repair")
def ar_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, "ar")


@query("acf_topk")
def acf_topk(spark, sf_dir):
    from .operators.blocks import periodicity

    frames = _frames(spark, sf_dir)[1].select(KEY, "frame", F.col("db").alias("flux"))
    rows = periodicity(frames, 1.0, 80, 40, 2.0, 30.0, (18.0,), 3)
    return rows.select("window", F.posexplode("peaks").alias("place", "peak")).select("window", "place", "peak.period_seconds", F.round("peak.r", 6).alias("r"))


@query("band_profile_fft")
def band_profile_fft(spark, sf_dir):
    from .operators.blocks import frame_bands

    return rounded(frame_bands(sg.events_mono(spark, sf_dir), 100, 64, 32, [(1, 5), (5, 20), (20, 51)]).drop(KEY), "db")


@query("spectral_frames")
def spectral_frames(spark, sf_dir):
    from .operators.blocks import spectral_frames as made

    return rounded(made(sg.events_mono(spark, sf_dir), 100, 256).select("frame", "centroid", "flux"), "centroid", "flux")


@query("analyze_document")
def analyze_document(spark, sf_dir):
    from .plans.analyzers import analyze

    samples = sg.events_by(spark, sf_dir, "event_type").withColumn("channel", F.lit(0))
    got = analyze(samples, 100, ["recording_info", "surface_noise", "silence", "dynamic_range", "clipping", "transients"], {"silence": {"margin_db": 2.0, "min_seconds": 0.2}})
    return got.document().select(KEY, F.to_json("surface_noise").alias("surface_noise"), F.to_json("clipping").alias("clipping"), F.to_json("silence").alias("silence"))


#: Tracks in thousandths of a recording's length.
PLAN_TRACKS = [(1, 50, 450), (2, 450, 700), (3, 760, 990)]


@query("execute_plan")
def execute_plan(spark, sf_dir):
    from .plans.executor import execute

    samples = sg.events_by(spark, sf_dir, "event_type").withColumn("channel", F.lit(0))
    plan = {
        "source": {"sample_rate": 100, "channels": 1, "num_samples": 1000}, "prefilter": {"enabled": True, "dc_block": True}, "declick": {"enabled": False},
        "decrackle": {"enabled": True, "threshold": 3.0}, "split": {"tracks": [{"index": i, "start_sample": a, "end_sample": b, "fade_in_ms": 100.0, "fade_out_ms": 200.0} for i, a, b in PLAN_TRACKS]},
        "normalize": {"mode": "album_peak", "target_db": -1.0, "peak_ceiling_db": -0.5},
    }
    out = execute(samples, plan, lengths(samples)).tracks
    return rounded(out.groupBy(KEY, "track_index").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"), F.sum("v").alias("total")), "peak", "total")


LINT_SQL = """WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
t AS (SELECT id, i, (i - 1) * 400000 AS a, (i - 1) * 400000 + 44100 * (1 + k % 10) AS b, (k % 3) * 10.0 AS fi, (k % 5) * 400.0 AS fo, CASE WHEN k % 4 = 0 THEN NULL ELSE 'Title ' || (k % 2) END AS title FROM o),
p AS (SELECT c_custkey AS id, 10.0 + c_custkey % 40 AS hz, c_custkey % 3 = 0 AS pre, c_custkey % 5 = 0 AS dec, 1 + c_custkey % 6 AS width, c_custkey % 7 <> 0 AS dcl, ['album_peak', 'album_rms', 'album_gated_rms', 'album_lufs', 'track_peak', 'none'][c_custkey % 6 + 1] AS mode,
 -(c_custkey % 4)::DOUBLE AS target, CASE WHEN c_custkey % 3 <> 0 THEN -0.3 * (c_custkey % 5) END AS ceil, c_custkey % 2 = 0 AS dither FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)),
g AS (SELECT t.*, lag(b) OVER (PARTITION BY id ORDER BY i) AS pb, lag(fo) OVER (PARTITION BY id ORDER BY i) AS pfo FROM t),
h AS (SELECT id, sum((fi = 0 AND a > 0)::INT + (fo = 0 AND b < 4000000)::INT) AS hard, count(*) FILTER (WHERE a = pb) AS cont, count(*) AS n FROM g GROUP BY 1)
SELECT id AS plan_id, 'warning' AS severity, 'short-track' AS code, 'split.tracks' AS location FROM t WHERE (b - a) / 44100.0 < 5
UNION ALL SELECT id, 'error', 'track-past-end', 'split.tracks' FROM t WHERE b > 4000000
UNION ALL SELECT id, 'error', 'fade-longer-than-track', 'split.tracks' FROM t WHERE (fi + fo) / 1000 > (b - a) / 44100.0
UNION ALL SELECT id, 'warning', 'missing-title', 'metadata.tracks' FROM t WHERE title IS NULL
UNION ALL SELECT id, 'error', 'gapless-fade', 'split.tracks' FROM g WHERE a = pb AND (pfo > 0 OR fi > 0)
UNION ALL SELECT id, 'warning', 'hard-cut', 'split.tracks' FROM h WHERE hard > 0 AND cont < n - 1
UNION ALL SELECT t.id, 'error', 'filename-collision', 'export.track_filename_template' FROM t JOIN (SELECT id, title, min(i) AS f FROM t WHERE title IS NOT NULL GROUP BY 1, 2) m ON t.id = m.id AND t.title = m.title AND t.i > m.f
UNION ALL SELECT id, 'warning', 'subsonic-cutoff-high', 'prefilter.highpass_hz' FROM p WHERE pre AND hz > 40
UNION ALL SELECT id, 'info', 'subsonic-cutoff-outside-band', 'prefilter.highpass_hz' FROM p WHERE pre AND hz <= 40 AND (hz < 20 OR hz > 30)
UNION ALL SELECT id, 'error', 'decrackle-without-threshold', 'decrackle.threshold' FROM p WHERE dec
UNION ALL SELECT id, 'warning', 'decrackle-width-is-clicks', 'decrackle.max_event_width_samples' FROM p WHERE dec AND width > 3
UNION ALL SELECT id, 'info', 'decrackle-without-declick', 'decrackle' FROM p WHERE dec AND NOT dcl
UNION ALL SELECT id, 'warning', 'rms-without-peak-ceiling', 'normalize.peak_ceiling_db' FROM p WHERE mode IN ('album_rms', 'album_gated_rms', 'album_lufs') AND ceil IS NULL
UNION ALL SELECT id, 'warning', 'lufs-target-is-loud', 'normalize.target_db' FROM p WHERE mode = 'album_lufs' AND target > -9
UNION ALL SELECT id, 'info', 'ungated-rms', 'normalize.mode' FROM p WHERE mode = 'album_rms'
UNION ALL SELECT id, 'warning', 'no-headroom', 'normalize' FROM p WHERE mode <> 'none' AND coalesce(ceil, CASE WHEN mode IN ('album_peak', 'track_peak') THEN target END) > -0.5
UNION ALL SELECT id, 'info', 'pointless-dither', 'export.dither' FROM p WHERE dither
UNION ALL SELECT id, 'warning', 'no-album-title', 'metadata.album' FROM p"""


@query("lint_findings", LINT_SQL)
def lint_findings(spark, sf_dir):
    from pyspark.sql import Window

    from .plans.lint import lint
    from .plans.schemas import ANALYSIS, PLAN

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = sg.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), i.alias("i"))
    track = F.struct(
        F.col("i").alias("index"), ((F.col("i") - 1) * 400000).cast("long").alias("start_sample"), ((F.col("i") - 1) * 400000 + 44100 * (1 + F.col("k") % 10)).cast("long").alias("end_sample"),
        ((F.col("k") % 3) * 10.0).alias("fade_in_ms"), ((F.col("k") % 5) * 400.0).alias("fade_out_ms"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("Title "), (F.col("k") % 2).cast("string"))).alias("title"),
    )
    tracks = o.groupBy("id").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
    rows = sg.read(spark, sf_dir, "customer").join(tracks, F.col("c_custkey") == F.col("id"))
    plan = """named_struct('schema_version', '3.8', 'source', named_struct('sample_rate', 44100, 'channels', 2, 'num_samples', 4000000L),
      'prefilter', named_struct('enabled', id % 3 = 0, 'engine', 'spark', 'dc_block', false, 'highpass_hz', 10.0D + id % 40),
      'split', named_struct('enabled', true, 'engine', 'spark', 'tracks', transform(tracks, t -> named_struct('index', t.index, 'start_sample', t.start_sample, 'end_sample', t.end_sample, 'fade_in_ms', t.fade_in_ms, 'fade_out_ms', t.fade_out_ms))),
      'declick', named_struct('enabled', id % 7 <> 0, 'engine', 'spark'), 'decrackle', named_struct('enabled', id % 5 = 0, 'engine', 'spark', 'max_event_width_samples', int(1 + id % 6)),
      'mono_merge', named_struct('enabled', false, 'engine', 'spark'), 'speed', named_struct('enabled', false, 'engine', 'spark'),
      'normalize', named_struct('enabled', true, 'engine', 'spark', 'mode', element_at(array('album_peak', 'album_rms', 'album_gated_rms', 'album_lufs', 'track_peak', 'none'), int(id % 6) + 1), 'target_db', -double(id % 4), 'peak_ceiling_db', CASE WHEN id % 3 <> 0 THEN -0.3D * (id % 5) END),
      'metadata', named_struct('enabled', true, 'tracks', transform(tracks, t -> named_struct('index', t.index, 'title', t.title))),
      'export', named_struct('bit_depth', 24, 'dither', CASE WHEN id % 2 = 0 THEN 'tpdf' ELSE 'none' END, 'track_filename_template', '{index:02d} - {title}', 'write_tags', true))"""
    # The documents' full schema: fields that are left out become null.
    plans = rows.select(F.col("id").alias("plan_id"), F.from_json(F.to_json(F.expr(plan)), PLAN).alias("p")).withColumn("a", F.expr(f"from_json(NULL, '{ANALYSIS}')"))
    named = plans.withColumn("p", F.col("p").withField("export.track_filename_template", F.lit("{title}")))
    return lint(named).select("plan_id", "severity", "code", "location")
