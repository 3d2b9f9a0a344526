"""DuckDB SQL for the query catalogue, written from the definitions in long form (one row a frame and component)."""

from __future__ import annotations

from kinelytics.operators.benchmark import GROUPS

R = "round({}, 6) + 0.0"


def _r(x: str) -> str:
    return R.format(x)


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
EVENTS = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, row_number() OVER w - 1 AS frame, coalesce(lead(value) OVER w, value) AS nxt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""
SPOILT_S = "CASE WHEN user_id % 7 = 3 THEN 1.5 WHEN user_id % 13 = 7 AND frame = 4 THEN CAST('NaN' AS DOUBLE) ELSE value END"
_ITEMS = """li AS (
  SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, row_number() OVER w - 1 AS frame,
    coalesce(lead(l_quantity) OVER w, l_quantity) AS n0, coalesce(lead(l_extendedprice) OVER w, l_extendedprice) AS n1,
    coalesce(lead(l_discount) OVER w, l_discount) AS n2, coalesce(lead(l_tax) OVER w, l_tax) AS n3
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {})
)""".format(_ORDER)
_EMB = "em AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)"


def long(views: str, spoilt: bool = False) -> str:
    """CTEs ending in ``l(view, episode, frame, j, s, a)``."""
    ctes, parts = [], []
    if "V1" in views:
        s = SPOILT_S if spoilt else "value"
        ctes.append(EVENTS)
        parts.append(f"SELECT 'V1' AS view, user_id AS episode, frame, 0 AS j, {s} AS s, nxt AS a FROM ev")
        parts.append("SELECT 'V1', user_id, frame, 1, k, k FROM ev")
    if "V2" in views:
        ctes.append(_EMB)
        parts.append("SELECT 'V2' AS view, CAST(label AS BIGINT) AS episode, frame, j, CAST(embedding[j + 1] AS DOUBLE) AS s, CAST(embedding[j + 7] AS DOUBLE) AS a FROM em, (SELECT CAST(unnest(range(6)) AS INTEGER) AS j)")
    if "V3" in views:
        ctes.append(_ITEMS)
        for j, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")):
            parts.append(f"SELECT 'V3' AS view, l_suppkey AS episode, frame, {j} AS j, {c} AS s, n{j} AS a FROM li")
    if "V6" in views:
        parts.append("SELECT 'V6' AS view, conv_id AS episode, turn AS frame, 0 AS j, CAST(length(text) AS DOUBLE) AS s, CAST(length(text) AS DOUBLE) AS a FROM conversations")
    ctes.append("raw AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(
        """ok AS (SELECT view, episode, count(DISTINCT frame) AS n, bool_and(isfinite(s) AND isfinite(a)) AS fin FROM raw GROUP BY view, episode),
l AS (SELECT raw.* FROM raw JOIN ok USING (view, episode) WHERE fin AND n >= 17),
lf AS (SELECT raw.* FROM raw JOIN ok USING (view, episode) WHERE fin)"""
    )
    return "WITH " + ",\n".join(ctes)


SCALE = """sc AS (
  SELECT view, j, quantile_cont(s, 0.01) AS p01, quantile_cont(s, 0.99) AS p99, greatest(quantile_cont(s, 0.99) - quantile_cont(s, 0.01), 1e-6) AS scale, min(a) AS lo, max(a) AS hi
  FROM l GROUP BY view, j
)"""
FRAME = """nm AS (SELECT l.view, l.episode, l.frame, l.j, s / scale AS s, a / scale AS a,
    CASE WHEN a <= lo + 0.01 * greatest(hi - lo, 1e-9) OR a >= hi - 0.01 * greatest(hi - lo, 1e-9) THEN 1.0 ELSE 0.0 END AS pin
  FROM l JOIN sc ON l.view = sc.view AND l.j = sc.j),
df AS (
  SELECT *, (s - lag(s, 1) OVER w) * 30 AS ds, (s - 3 * lag(s, 1) OVER w + 3 * lag(s, 2) OVER w - lag(s, 3) OVER w) * 27000 AS d3,
    abs(a - lag(a, 1) OVER w) AS da, a - 2 * lag(a, 1) OVER w + lag(a, 2) OVER w AS d2, lead(s, 15) OVER w - s AS dw,
    abs(a - lead(s, 1) OVER w) AS er, abs(a - first_value(a) OVER w) AS aw,
    last_value(a) OVER (PARTITION BY view, episode, j ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS al
  FROM nm WINDOW w AS (PARTITION BY view, episode, j ORDER BY frame)
),
fr AS (
  SELECT view, episode, frame, sqrt(sum(ds * ds)) AS speed, sum(d3 * d3) AS jerk2, sqrt(sum(dw * dw)) AS net, sum(aw) AS away, sum(abs(a - al)) AS to_end
  FROM df GROUP BY view, episode, frame
),
ep0 AS (
  SELECT view, episode, count(*) AS n, max(speed) AS peak, sum(jerk2) AS jerk2, quantile_cont(net, 0.10) AS p10, quantile_cont(net, 0.95) AS p95, max(away) AS far,
    arg_max(away, frame) AS net_shift FROM fr GROUP BY view, episode
),
kk AS (SELECT fr.view, fr.episode, min(frame) AS k FROM fr JOIN ep0 ON fr.view = ep0.view AND fr.episode = ep0.episode WHERE away = far GROUP BY fr.view, fr.episode),
sp AS (SELECT fr.view, fr.episode, away + to_end AS split_shift FROM fr JOIN kk ON fr.view = kk.view AND fr.episode = kk.episode AND fr.frame = kk.k),
ej AS (SELECT view, episode, sum(da) AS path, avg(d2 * d2) AS hf, avg(pin) AS sat, avg(er) AS err FROM df GROUP BY view, episode),
ep AS (
  SELECT ep0.*, split_shift, path, hf, sat, err, ln(power(n / 30.0, 3) / power(peak + 1e-9, 2) * jerk2 / 30.0 + 1e-12) AS ldlj
  FROM ep0 JOIN sp USING (view, episode) JOIN ej USING (view, episode)
),
ds0 AS (SELECT view, greatest(0.02, 2.0 * quantile_cont(p10, 0.25)) AS eps, 0.5 * median(split_shift) AS f_split, 0.5 * median(net_shift) AS f_net FROM ep GROUP BY view),
nt AS (SELECT fr.view, fr.episode, frame, net, p95, eps FROM fr JOIN ep USING (view, episode) JOIN ds0 ON ds0.view = fr.view WHERE net IS NOT NULL),
lm AS (SELECT view, episode, max(frame) FILTER (WHERE net >= greatest(eps, 0.5 * p95)) AS last FROM nt GROUP BY view, episode),
idl AS (
  SELECT nt.view, nt.episode, CASE WHEN max(p95) < max(eps) THEN 1.0 ELSE CAST(count(*) FILTER (WHERE frame < last AND net < greatest(eps, 0.2 * p95)) AS DOUBLE) / count(*) END AS idle
  FROM nt JOIN lm USING (view, episode) GROUP BY nt.view, nt.episode
),
sg0 AS (
  SELECT ep.*, path / greatest(split_shift, f_split, 1e-6) AS tv, path / greatest(net_shift, f_net, 1e-6) AS tvn, idle
  FROM ep JOIN ds0 USING (view) JOIN idl USING (view, episode)
)"""
SPARC = """vk AS (SELECT view, episode, frame - 1 AS t, speed, CAST(power(2, ceil(log2(count(*) OVER (PARTITION BY view, episode))) + 4) AS BIGINT) AS kk FROM fr WHERE speed IS NOT NULL),
bn AS (SELECT view, episode, kk, unnest(range(kk // 2 + 1)) AS b FROM (SELECT DISTINCT view, episode, kk FROM vk)),
mg AS (
  SELECT bn.view, bn.episode, b, max(bn.kk) AS kk, sqrt(power(sum(speed * cos(2 * pi() * ((b * t) % bn.kk) / bn.kk)), 2) + power(sum(speed * sin(2 * pi() * ((b * t) % bn.kk) / bn.kk)), 2)) AS m
  FROM bn JOIN vk ON bn.view = vk.view AND bn.episode = vk.episode GROUP BY bn.view, bn.episode, b
),
mn AS (SELECT view, episode, b, b * 30.0 / kk AS f, m / (max(m) OVER (PARTITION BY view, episode) + 1e-12) AS m FROM mg),
ct AS (SELECT *, max(CASE WHEN m >= 0.05 THEN b END) OVER (PARTITION BY view, episode) AS lb, sum(CASE WHEN m >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY view, episode) AS nb FROM mn WHERE f <= 10),
cu AS (SELECT *, max(f) OVER (PARTITION BY view, episode) - min(f) OVER (PARTITION BY view, episode) + 1e-12 AS span, lag(m) OVER (PARTITION BY view, episode ORDER BY b) AS pm, lag(f) OVER (PARTITION BY view, episode ORDER BY b) AS pf FROM ct WHERE b <= lb),
sa AS (SELECT view, episode, CASE WHEN max(nb) < 2 THEN 0.0 ELSE coalesce(sum(sqrt(power((f - pf) / span, 2) + power(m - pm, 2))), 0.0) END AS sparc FROM cu GROUP BY view, episode)"""
NAMES = (("sparc_state", "sparc", 0.10, 0.0), ("ldlj_state", "ldlj", 0.0, 0.5), ("action_tv_ratio", "tv", 0.10, 0.0), ("action_hf_energy", "hf", 0.10, 0.0), ("idle_frac", "idle", 0.0, 0.03), ("saturation_frac", "sat", 0.0, 0.03), ("track_err", "err", 0.10, 0.0))
ZS = (
    "sg AS (SELECT sg0.*, sparc FROM sg0 JOIN sa USING (view, episode)),\nlg AS ("
    + " UNION ALL ".join(f"SELECT view, episode, '{s}' AS signal, {i} AS place, {c} AS x, {rel} AS rel, {least} AS least FROM sg" for i, (s, c, rel, least) in enumerate(NAMES))
    + """),
md AS (SELECT view, signal, median(x) AS med FROM lg GROUP BY view, signal),
dv AS (SELECT lg.*, med, abs(x - med) AS ad FROM lg JOIN md ON lg.view = md.view AND lg.signal = md.signal),
sd AS (SELECT view, signal, median(ad) AS mad FROM dv GROUP BY view, signal),
zz AS (SELECT dv.*, (x - med) / greatest(1.4826 * mad, rel * abs(med), least, 1e-9) AS z FROM dv JOIN sd ON dv.view = sd.view AND dv.signal = sd.signal),
cb AS (SELECT view, episode, max(z) AS combined FROM zz GROUP BY view, episode)"""
)


def scored(views: str, spoilt: bool = False) -> str:
    """CTEs up to ``zz`` (z by signal) and ``cb`` (combined)."""
    return ",\n".join((long(views, spoilt), SCALE, FRAME, SPARC, ZS))


#: Integrity of the spoilt (or plain) event view and the quality that follows.
def episodes(spoilt: bool, tags: bool = True) -> str:
    t = "CASE WHEN user_id % 11 = 5 AND frame >= 20 THEN frame / 30.0 + 0.2 ELSE frame / 30.0 END" if spoilt else "frame / 30.0"
    label = "CASE WHEN episode % 5 = 0 THEN 'success' WHEN episode % 5 = 1 THEN 'fail' END" if tags else "NULL"
    return (
        scored("V1", spoilt)
        + f""",
tg AS (SELECT user_id AS episode, abs(t - lag(t) OVER (PARTITION BY user_id ORDER BY frame) - 1 / 30.0) AS gap FROM (SELECT user_id, frame, {t} AS t FROM ev)),
gp AS (SELECT episode, max(gap) > 1e-4 AS gap FROM tg GROUP BY episode),
dr AS (SELECT j, max(s) - min(s) AS ps, max(a) - min(a) AS pa FROM lf GROUP BY j),
pe AS (SELECT episode, j, max(s) - min(s) AS es, max(a) - min(a) AS ea FROM lf GROUP BY episode, j),
fz AS (SELECT episode, count(*) AS frozen FROM pe JOIN dr USING (j) WHERE es = 0 AND ps > 0 AND pa > 0 AND ea > 0.01 * pa GROUP BY episode),
lastf AS (SELECT user_id AS episode, arg_max(event_type, frame) = 'purchase' AS sim FROM ev GROUP BY user_id),
hard AS (
  SELECT ok.episode, ok.n, fin, CASE WHEN NOT fin THEN 1 ELSE CAST(ok.n < 17 AS INT) + coalesce(frozen, 0) + CAST(gap AS INT) + CAST(coalesce(sat >= 0.2, false) AS INT) END AS n_hard,
    fin AND ok.n < 17 AS h_short, CASE WHEN fin THEN coalesce(frozen, 0) ELSE 0 END AS h_frozen, fin AND gap AS h_gap, coalesce(sat >= 0.2, false) AS h_sat, combined
  FROM ok JOIN gp ON ok.episode = gp.episode LEFT JOIN fz ON ok.episode = fz.episode LEFT JOIN ep ON ok.episode = ep.episode LEFT JOIN cb ON ok.episode = cb.episode
),
er AS (
  SELECT hard.*, CASE WHEN n_hard > 0 THEN 'HARD' WHEN combined > 3.5 THEN 'FLAG' ELSE 'ok' END AS quality, sim, {label} AS label
  FROM hard JOIN lastf USING (episode)
),
eo AS (
  SELECT *, coalesce(label, CASE WHEN sim THEN 'success' ELSE 'fail' END) AS outcome, CASE WHEN label IS NOT NULL THEN 'label' ELSE 'sim' END AS source,
    coalesce((label = 'success') <> sim, false) AS disagree
  FROM er
)"""
    )


HARD_V2 = """pe AS (SELECT view, episode, j, max(s) - min(s) AS es, max(a) - min(a) AS ea FROM lf GROUP BY view, episode, j),
dr AS (SELECT view, j, max(s) - min(s) AS ps, max(a) - min(a) AS pa FROM lf GROUP BY view, j),
fz AS (SELECT view, episode, count(*) AS frozen FROM pe JOIN dr USING (view, j) WHERE es = 0 AND ps > 0 AND pa > 0 AND ea > 0.01 * pa GROUP BY view, episode),
eo AS (
  SELECT ok.episode, fin, CASE WHEN NOT fin OR coalesce(frozen, 0) > 0 OR ok.n < 17 OR coalesce(sat >= 0.2, false) THEN 'HARD' WHEN combined > 3.5 THEN 'FLAG' ELSE 'ok' END AS quality
  FROM ok LEFT JOIN fz USING (view, episode) LEFT JOIN (SELECT view, episode, sat FROM ep) USING (view, episode) LEFT JOIN cb USING (view, episode)
),
blk AS (
  SELECT count(*) AS episodes, count(*) FILTER (WHERE quality = 'HARD') AS hard, count(*) FILTER (WHERE quality = 'FLAG') AS motion_flagged,
    count(*) FILTER (WHERE quality <> 'ok') AS flagged, count(*) FILTER (WHERE NOT fin) AS nonfinite, 0 AS outcome_known, CAST(NULL AS BIGINT) AS failed
  FROM eo
)"""
BLOCK = """blk AS (
  SELECT count(*) AS episodes, count(*) FILTER (WHERE quality = 'HARD') AS hard, count(*) FILTER (WHERE quality = 'FLAG') AS motion_flagged,
    count(*) FILTER (WHERE quality <> 'ok') AS flagged, count(*) FILTER (WHERE NOT fin) AS nonfinite, count(*) AS outcome_known,
    count(*) FILTER (WHERE source = 'label') AS from_label, count(*) FILTER (WHERE source = 'sim') AS from_sim, count(*) FILTER (WHERE outcome = 'fail') AS failed
  FROM eo
)"""
RULE = """CASE WHEN hard >= 0.05 * episodes OR nonfinite > 0 THEN 'R0' WHEN flagged >= 0.5 * episodes THEN 'R1' WHEN failed >= 0.1 * outcome_known THEN 'R2'
  WHEN motion_flagged >= 0.1 * episodes THEN 'R3' ELSE (SELECT CASE WHEN NOT significant OR significant <> (lo > 0 OR hi < 0) THEN 'R4' ELSE 'INCONCLUSIVE' END FROM cmp) END"""
OUT = "oc AS (SELECT d.doc_id, lang, source, n_chars, quality = 1 AS a, toxic = 0 AS b FROM labels JOIN documents d USING (doc_id))"
_CELLS = "count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_a_only, count(*) FILTER (WHERE NOT a AND b) AS n_b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS n_neither"
PAIRS = f"pr AS (SELECT 'lang' AS kind, lang AS grp, {_CELLS} FROM oc GROUP BY lang UNION ALL SELECT 'source', source, {_CELLS} FROM oc GROUP BY source)"


def mcnemar(source: str) -> str:
    """CTE ``mc``: rows of ``source`` with the exact p-value."""
    return f"""mt AS (SELECT *, n_a_only + n_b_only AS m, least(n_a_only, n_b_only) AS k FROM {source}),
mc AS (
  SELECT mt.*, CASE WHEN m = 0 THEN 1.0 WHEN 2 * k >= m THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(mt.m + 1) - lgamma(i + 1) - lgamma(mt.m - i + 1) - mt.m * ln(2.0))) FROM (SELECT unnest(range(mt.k + 1)) AS i))) END AS p
  FROM mt
)"""


def wilson(k: str, n: str, side: str) -> str:
    z = "1.959963984540054"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    den = f"(1 + {z} * {z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {den})"
    centre = f"(({p} + {z} * {z} / (2.0 * {n})) / {den})"
    return f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END" if side == "lo" else f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {centre} + {half}) END"


def paired(source: str) -> str:
    """CTE ``ci``: B minus A with Newcombe's interval for rows of ``source``."""
    return f"""pw AS (SELECT *, n_both + n_b_only AS kb, n_both + n_a_only AS ka, n_both + n_a_only + n_b_only + n_neither AS n FROM {source}),
px AS (
  SELECT *, CAST(kb AS DOUBLE) / n AS p1, CAST(ka AS DOUBLE) / n AS p2, {wilson("kb", "n", "lo")} AS l1, {wilson("kb", "n", "hi")} AS u1, {wilson("ka", "n", "lo")} AS l2, {wilson("ka", "n", "hi")} AS u2,
    CAST(kb AS DOUBLE) * (n_a_only + n_neither) * ka * (n_b_only + n_neither) AS prod, CAST(n_both AS DOUBLE) * n_neither - CAST(n_b_only AS DOUBLE) * n_a_only AS num
  FROM pw
),
py AS (SELECT *, CASE WHEN prod > 0 THEN num / sqrt(prod) ELSE 0.0 END AS phi FROM px),
ci AS (
  SELECT *, p1 - p2 AS delta, greatest(-1.0, p1 - p2 - sqrt(greatest(0.0, power(p1 - l1, 2) - 2 * phi * (p1 - l1) * (u2 - p2) + power(u2 - p2, 2)))) AS lo,
    least(1.0, p1 - p2 + sqrt(greatest(0.0, power(u1 - p1, 2) - 2 * phi * (u1 - p1) * (p2 - l2) + power(p2 - l2, 2)))) AS hi
  FROM py
)"""


COMPARE = f"{OUT}, al AS (SELECT {_CELLS} FROM oc), {mcnemar('al')}, {paired('mc')}, cmp AS (SELECT *, p < 0.05 AS significant FROM ci)"


def auroc(source: str, score: str, positive: str, by: str) -> str:
    """CTE ``au``: rank-sum AUROC of ``source`` by group."""
    return f"""rk AS (SELECT {by} AS grp, {positive} AS pos, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {source}),
au AS (
  SELECT grp, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg,
    (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / nullif(CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos), 0) AS auroc
  FROM rk GROUP BY grp
)"""


RANKED = f"""{OUT},
rd AS (
  SELECT doc_id, n_chars, n_chars > 2000 AS flagged, CASE WHEN a THEN 'clean' ELSE ['noise010', 'noise025', 'random', 'hesitation'][doc_id % 4 + 1] END AS grp, NOT a AS junk, 1 AS one
  FROM oc
)"""
SIGNAL = {"q09_ldlj": ("V1 V2 V3", "ldlj", "ldlj"), "q12_hf_energy": ("V1 V2 V3", "hf", "hf"), "q13_idle_frac": ("V1 V2 V3", "idle", "idle"), "q14_saturation": ("V1 V2 V3", "sat", "sat"), "q15_track_err": ("V1 V2", "err", "err")}


#: What a reason says of a signal and how it shows the value: against the median as a ratio, a difference, or in percent.
WORDED = {
    "sparc_state": ("speed profile is irregular", "ratio"),
    "ldlj_state": ("motion is jerky", "difference"),
    "action_tv_ratio": ("commands dither on their way", "ratio"),
    "action_hf_energy": ("commands chatter", "ratio"),
    "idle_frac": ("rests before its last motion", "percent"),
    "saturation_frac": ("commands sit at their limits", "percent"),
    "track_err": ("the arm lags its commands", "ratio"),
}


def _spoken(words: str, kind: str) -> str:
    if kind == "percent":
        return f"'{words}: ' || printf('%.0f', 100 * x) || '% (median ' || printf('%.0f', 100 * med) || '%)'"
    if kind == "difference":
        return f"'{words}: ' || printf('%+.1f', x - med) || ' from the median in log units'"
    return f"CASE WHEN abs(med) > 1e-12 THEN '{words}: ' || printf('%.1f', x / med) || ' times the median' ELSE '{words}: ' || printf('%.3g', x) || ' (median near 0)' END"


def _binomial(k: str, n: str, p: str) -> str:
    """Probability of ``k`` of ``n`` with chance ``p`` inside (0, 1)."""
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def oracle_sql() -> dict[str, str]:
    base = lambda views: ",\n".join((long(views), SCALE, FRAME))
    out = {
        "q00_entry": f"""{base("V1")}, hm AS (SELECT median(hf) AS med FROM ep), hd AS (SELECT median(abs(hf - med)) AS mad FROM ep, hm),
            hz AS (SELECT episode, n, hf, (hf - med) / greatest(1.4826 * mad, 0.1 * abs(med), 1e-9) AS z FROM ep, hm, hd)
            SELECT episode, n AS n_frames, {_r("hf")} AS action_hf_energy, {_r("z")} AS z, z > 3.5 AS flagged FROM hz""",
        "q01_frames_scan": f"WITH {EVENTS} SELECT user_id AS episode, frame, {_r('value')} AS s0, {_r('k')} AS s1 FROM ev",
        "q02_episode_lengths": f"{long('V1 V3 V6')} SELECT view, episode, n, fin AND n >= 17 AS scorable FROM ok",
        "q03_joint_quantiles": f"{long('V1 V2 V3')}, {SCALE} SELECT view, j AS joint, {_r('p01')} AS p01, {_r('p99')} AS p99, {_r('scale')} AS scale FROM sc",
        "q04_joint_ranges": f"{long('V1 V2 V3')}, {SCALE}, pt AS (SELECT view, j, max(a) - min(a) AS ptp FROM lf GROUP BY view, j) SELECT view, j AS joint, {_r('lo')} AS lo, {_r('hi')} AS hi, {_r('ptp')} AS ptp FROM sc JOIN pt USING (view, j)",
        "q05_too_short": f"{long('V6 V1')} SELECT view, episode, n, n < 17 AS too_short FROM ok",
        "q06_timestamp_gap": f"""WITH {EVENTS}, ck AS (
              SELECT 'real' AS clock, user_id AS episode, frame, epoch_us(ts) / 1e6 AS t FROM ev UNION ALL SELECT 'nominal', user_id, frame, frame / 30.0 FROM ev
              UNION ALL SELECT 'spoilt', user_id, frame, CASE WHEN user_id % 11 = 5 AND frame >= 20 THEN frame / 30.0 + 0.2 ELSE frame / 30.0 END FROM ev),
            gg AS (SELECT clock, episode, max(abs(g)) AS max_gap FROM (SELECT clock, episode, t - lag(t) OVER (PARTITION BY clock, episode ORDER BY frame) - 1 / 30.0 AS g FROM ck) GROUP BY clock, episode)
            SELECT clock, episode, round(max_gap, 4) AS max_gap, max_gap > 1e-4 AS flagged FROM gg""",
        "q07_frozen_joint": f"""{long("V1", True)}, dr AS (SELECT j, max(s) - min(s) AS ps, max(a) - min(a) AS pa FROM lf GROUP BY j),
            pe AS (SELECT episode, j, max(s) - min(s) AS es, max(a) - min(a) AS ea FROM lf GROUP BY episode, j)
            SELECT episode, j AS joint FROM pe JOIN dr USING (j) WHERE es = 0 AND ps > 0 AND pa > 0 AND ea > 0.01 * pa""",
        "q08_net_motion": f"{base('V2')} SELECT view, episode, {_r('p10')} AS p10, {_r('p95')} AS p95 FROM ep",
        "q10_tv_split": f"{base('V1 V2 V3')} SELECT view, episode, {_r('split_shift')} AS den, {_r('tv')} AS ratio FROM sg0",
        "q11_tv_net": f"{base('V1 V2 V3')} SELECT view, episode, {_r('net_shift')} AS den, {_r('tvn')} AS ratio FROM sg0",
        "q16_sparc": f"{base('V1 V2')}, {SPARC} SELECT view, episode, {_r('sparc')} AS sparc FROM sa",
        "q17_robust_z": f"{scored('V1')} SELECT episode, signal, {_r('x')} AS raw, {_r('z')} AS z FROM zz",
        "q18_quality": f"""{scored("V1 V3")}, pe AS (SELECT view, episode, j, max(s) - min(s) AS es, max(a) - min(a) AS ea FROM lf GROUP BY view, episode, j),
            dr AS (SELECT view, j, max(s) - min(s) AS ps, max(a) - min(a) AS pa FROM lf GROUP BY view, j),
            fz AS (SELECT view, episode, count(*) AS frozen FROM pe JOIN dr USING (view, j) WHERE es = 0 AND ps > 0 AND pa > 0 AND ea > 0.01 * pa GROUP BY view, episode),
            hh AS (SELECT ok.view, ok.episode, combined, CAST(coalesce(frozen, 0) + CAST(n < 17 AS INT) + CAST(coalesce(sat >= 0.2, false) AS INT) AS INTEGER) AS n_hard
              FROM ok LEFT JOIN fz USING (view, episode) LEFT JOIN (SELECT view, episode, sat FROM ep) USING (view, episode) LEFT JOIN cb USING (view, episode))
            SELECT view, episode, {_r("combined")} AS combined, CASE WHEN n_hard > 0 THEN 'HARD' WHEN combined > 3.5 THEN 'FLAG' ELSE 'ok' END AS quality, n_hard FROM hh""",
        "q19_length_z": f"""{base("V1")}, lm0 AS (SELECT median(ln(n)) AS med FROM ep), ld0 AS (SELECT median(abs(ln(n) - med)) AS mad FROM ep, lm0)
            SELECT episode, {_r("(ln(n) - med) / greatest(1.4826 * mad, 0.1, 1e-9)")} AS length_z FROM ep, lm0, ld0""",
        "q20_outcome": f"{episodes(False)} SELECT episode, sim, label, outcome AS value, source, disagree FROM eo",
        "q21_summary": f"""{episodes(True)} SELECT count(*) AS episodes, CAST(sum(n) AS BIGINT) AS frames, count(*) FILTER (WHERE quality <> 'ok') AS flagged, count(*) FILTER (WHERE quality = 'HARD') AS hard,
            count(*) FILTER (WHERE disagree) AS disagreements, {_r("CAST(count(*) FILTER (WHERE quality <> 'ok') AS DOUBLE) / count(*)")} AS flagged_frac,
            CAST(count(*) FILTER (WHERE quality <> 'ok') AS DOUBLE) / count(*) > 0.5 AS mostly_flagged, count(*) < 10 AS few_episodes FROM eo""",
        "q22_top_reasons": f"""{episodes(True)}, rs AS (
              SELECT 'nonfinite' AS reason, episode, 0 AS place FROM eo WHERE NOT fin UNION ALL SELECT 'short', episode, 1 FROM eo WHERE h_short
              UNION ALL SELECT 'frozen', episode, 2 FROM (SELECT episode, unnest(range(h_frozen)) FROM eo) UNION ALL SELECT 'gap', episode, 3 FROM eo WHERE h_gap
              UNION ALL SELECT 'saturation', episode, 4 FROM eo WHERE h_sat
              UNION ALL SELECT signal, zz.episode, 5 + zz.place FROM zz JOIN eo ON zz.episode = eo.episode WHERE quality <> 'ok' AND z > 3.0)
            SELECT reason, count(*) AS count FROM rs GROUP BY reason ORDER BY count(*) DESC, min(episode * 100 + place) LIMIT 5""",
        "q23_wilson": f"""WITH g AS (SELECT o_orderpriority AS grp, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY o_orderpriority)
            SELECT grp, n, k, {_r("CAST(k AS DOUBLE) / n")} AS rate, {_r(wilson("k", "n", "lo"))} AS lo, {_r(wilson("k", "n", "hi"))} AS hi FROM g""",
        "q25_mcnemar": f"WITH {OUT}, {PAIRS}, {mcnemar('pr')} SELECT kind, grp, n_both, n_a_only, n_b_only, n_neither, {_r('p')} AS p FROM mc",
        "q26_paired_ci": f"WITH {OUT}, {PAIRS}, {paired('pr')} SELECT kind, grp, {_r('delta')} AS delta, {_r('lo')} AS lo, {_r('hi')} AS hi FROM ci",
        "q27_compare": f"WITH {COMPARE} SELECT n_both, n_a_only, n_b_only, n_neither, {_r('p')} AS p, {_r('delta')} AS delta, {_r('lo')} AS lo, {_r('hi')} AS hi, significant, significant <> (lo > 0 OR hi < 0) AS borderline FROM cmp",
        "q28_auroc": f"WITH {OUT}, {auroc('oc', 'n_chars', 'NOT a', 'lang')} SELECT grp, n_pos, n_neg, {_r('auroc')} AS auroc FROM au",
        "q29_confusion": f"""WITH {RANKED}, c AS (SELECT count(*) FILTER (WHERE flagged AND junk) AS tp, count(*) FILTER (WHERE flagged AND NOT junk) AS fp, count(*) FILTER (WHERE NOT flagged AND junk) AS fn FROM rd)
            SELECT tp, fp, fn, {_r("CAST(tp AS DOUBLE) / nullif(tp + fp, 0)")} AS precision, {_r("CAST(tp AS DOUBLE) / nullif(tp + fn, 0)")} AS recall FROM c""",
        "q30_bars": f"""WITH {RANKED}, {auroc("rd", "n_chars", "junk", "one")}, hs AS (SELECT *, grp = 'hesitation' AS ish FROM rd WHERE grp IN ('clean', 'hesitation')),
            hk AS (SELECT ish, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM hs),
            ha AS (SELECT (sum(r) FILTER (WHERE ish) - count(*) FILTER (WHERE ish) * (count(*) FILTER (WHERE ish) + 1) / 2.0) / nullif(CAST(count(*) FILTER (WHERE ish) AS DOUBLE) * count(*) FILTER (WHERE NOT ish), 0) AS v FROM hk),
            c AS (SELECT CAST(count(*) FILTER (WHERE flagged AND junk) AS DOUBLE) AS tp, count(*) FILTER (WHERE flagged AND NOT junk) AS fp, count(*) FILTER (WHERE NOT flagged AND junk) AS fn FROM rd),
            sh AS (SELECT grp, avg(CAST(flagged AS DOUBLE)) AS v FROM rd GROUP BY grp),
            vs AS (
              SELECT 'auroc' AS bar, (SELECT auroc FROM au) AS value, 0.95 AS threshold, true AS up UNION ALL SELECT 'precision', (SELECT tp / nullif(tp + fp, 0) FROM c), 0.90, true
              UNION ALL SELECT 'recall', (SELECT tp / nullif(tp + fn, 0) FROM c), 0.85, true UNION ALL SELECT 'clean_flagged', (SELECT v FROM sh WHERE grp = 'clean'), 0.05, false
              UNION ALL SELECT 'clean_only_flagged', NULL, 0.05, false UNION ALL SELECT 'noise010_flagged', (SELECT v FROM sh WHERE grp = 'noise010'), 0.90, true
              UNION ALL SELECT 'noise025_flagged', (SELECT v FROM sh WHERE grp = 'noise025'), 0.90, true UNION ALL SELECT 'random_flagged', (SELECT v FROM sh WHERE grp = 'random'), 0.90, true
              UNION ALL SELECT 'hesitation_auroc', (SELECT v FROM ha), 0.90, true UNION ALL SELECT 'nearmiss_flagged', NULL, 0.20, false UNION ALL SELECT 'return_home_flagged', NULL, 0.10, false)
            SELECT bar, {_r("value")} AS value, CAST(threshold AS DOUBLE) AS threshold, coalesce(CASE WHEN up THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM vs""",
        "q30b_per_group": f"""WITH {RANKED}, gs AS (SELECT DISTINCT grp FROM rd WHERE grp <> 'clean'),
            gr AS (SELECT gs.grp AS g, rd.grp = gs.grp AS pos, n_chars FROM gs JOIN rd ON rd.grp = gs.grp OR rd.grp = 'clean'), {auroc("gr", "n_chars", "pos", "g")}
            SELECT rd.grp, min(CASE WHEN junk THEN 'motion_junk' ELSE 'clean' END) AS class, count(*) AS n, count(*) FILTER (WHERE flagged) AS flagged, {_r("max(auroc)")} AS auroc_vs_clean
            FROM rd LEFT JOIN au ON au.grp = rd.grp GROUP BY rd.grp""",
        "q31_data_block": f"""{episodes(True)}, {BLOCK} SELECT *, {_r("CAST(hard AS DOUBLE) / episodes")} AS hard_frac, {_r("CAST(flagged AS DOUBLE) / episodes")} AS flagged_frac,
            {_r("CAST(motion_flagged AS DOUBLE) / episodes")} AS motion_flagged_frac, {_r("CAST(failed AS DOUBLE) / outcome_known")} AS failed_frac FROM blk""",
        "q32_rule": " UNION ALL ".join(
            f"SELECT * FROM ({ctes}, {COMPARE} SELECT '{name}' AS data, {RULE} AS rule, CASE WHEN outcome_known = 0 THEN 'R6' END AS add_on FROM blk)"
            for name, ctes in (("spoilt", f"{episodes(True)}, {BLOCK}"), ("plain", f"{episodes(False)}, {BLOCK}"), ("embeddings", f"{scored('V2')}, {HARD_V2}"))
        ),
        "q33_keep_filter": f"""{episodes(False)} SELECT 'all' AS keep, episode FROM eo UNION ALL SELECT 'quality-ok', episode FROM eo WHERE quality = 'ok'
            UNION ALL SELECT 'success', episode FROM eo WHERE outcome = 'success' UNION ALL SELECT 'ok-and-success', episode FROM eo WHERE quality = 'ok' AND outcome = 'success'""",
        "q34_feature_norm": f"{long('V2')} SELECT j AS joint, {_r('avg(s)')} AS mean, {_r('stddev_pop(s) + 1e-6')} AS std FROM raw GROUP BY j",
        "q34b_episode_stats": f"{long('V2')} SELECT episode, j AS joint, {_r('min(s)')} AS min_v, {_r('max(s)')} AS max_v, {_r('avg(s)')} AS mean_v, {_r('stddev_pop(s)')} AS std_v, count(*) AS n FROM raw GROUP BY episode, j",
        "q35_label_update": """WITH b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'success' ELSE 'fail' END AS sim, CASE WHEN doc_id % 3 = 0 THEN 'success' WHEN doc_id % 3 = 1 THEN 'fail' ELSE 'unlabeled' END AS old FROM labels),
            u AS (SELECT false AS overwrite, old, CASE WHEN old = 'unlabeled' THEN sim ELSE old END AS label, old <> 'unlabeled' AS skipped FROM b UNION ALL SELECT true, old, sim, false FROM b)
            SELECT overwrite, label, count(*) AS n, count(*) FILTER (WHERE label <> old) AS changed, count(*) FILTER (WHERE skipped) AS skipped FROM u GROUP BY overwrite, label""",
        "q35b_label_edit": """WITH b AS (SELECT doc_id, doc_id BETWEEN 0 AND 9 OR doc_id IN (20, 30) AS here, CASE WHEN doc_id % 3 = 0 THEN 'success' WHEN doc_id % 3 = 1 THEN 'fail' ELSE 'unlabeled' END AS old FROM labels)
            SELECT doc_id AS episode, CASE WHEN here THEN 'fail' ELSE old END AS label, CASE WHEN here THEN 'seen' ELSE '' END AS notes, CASE WHEN here THEN 'checked' ELSE 'new' END AS flags FROM b""",
        "q36_renumber": "SELECT row_number() OVER (ORDER BY user_id) - 1 AS new_index, user_id AS source_index FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 1)",
        "q37_offsets": "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT user_id, n, CAST(sum(n) OVER (ORDER BY user_id) AS BIGINT) AS hi FROM n) SELECT user_id AS episode, hi - n AS from_index, hi AS to_index FROM s",
        "q38_unit_invariance": "SELECT CAST(0 AS DOUBLE) AS max_difference",
        "q39_top_k_worst": f"{scored('V1')} SELECT episode, {_r('combined')} AS combined FROM (SELECT * FROM cb ORDER BY round(combined, 6) DESC, episode LIMIT 10)",
        "q40_exact_quantiles": "WITH p AS (SELECT CAST(unnest([0.0, 0.01, 0.5, 0.77, 0.99, 1.0]) AS DOUBLE) AS p) "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS col, CAST({p} AS DOUBLE) AS p, {_r(f'quantile_cont({c}, {p})')} AS v FROM lineitem" for c in ("l_extendedprice", "l_quantity") for p in (0.0, 0.01, 0.5, 0.77, 0.99, 1.0)
        ),
    }
    out["q43_run_summary"] = f"""WITH g AS (SELECT o_orderpriority AS policy, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS any_k, median(o_totalprice) AS m FROM orders GROUP BY o_orderpriority)
        SELECT policy, n, k, any_k, {_r("CAST(k AS DOUBLE) / n")} AS rate, {_r(wilson("k", "n", "lo"))} AS lo, {_r(wilson("k", "n", "hi"))} AS hi, {_r("CAST(any_k AS DOUBLE) / n")} AS any_rate,
        {_r(wilson("any_k", "n", "lo"))} AS any_lo, {_r(wilson("any_k", "n", "hi"))} AS any_hi, {_r("m")} AS median_error FROM g"""
    out["q44_content_hash"] = f"""WITH {EVENTS} SELECT user_id AS episode, sha256(string_agg(frame || ',' || CAST(k AS BIGINT) || ',' || CAST(event_type = 'purchase' AS INT), ';' ORDER BY frame)) AS sha256 FROM ev GROUP BY user_id"""
    sizes = ", ".join(f"({i}, '{g}', '{c}', {n})" for i, (g, c, n, _) in enumerate(GROUPS))
    out["q45_truth_counts"] = f"""WITH g(i, grp, class, n) AS (VALUES {sizes}), o AS (SELECT *, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS hi FROM g)
        SELECT class, CAST(sum(n) AS BIGINT) AS n, min(hi - n) AS first, max(hi) - 1 AS last FROM o GROUP BY class"""
    out["q46_any_and_last_success"] = f"WITH {EVENTS} SELECT user_id AS episode, bool_or(event_type = 'purchase') AS any_success, arg_max(event_type, frame) = 'purchase' AS last_success FROM ev GROUP BY user_id"
    out["q24_clopper_pearson"] = f"""WITH RECURSIVE {OUT}, g AS (SELECT lang AS grp, count(*) AS n, count(*) FILTER (WHERE a) AS k FROM oc GROUP BY lang),
        b AS (
          SELECT grp, n, k, 0 AS step, CAST(0 AS DOUBLE) AS l0, CAST(1 AS DOUBLE) AS l1, CAST(0 AS DOUBLE) AS h0, CAST(1 AS DOUBLE) AS h1 FROM g
          UNION ALL
          SELECT grp, n, k, step + 1, CASE WHEN above < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN above < 0.025 THEN l1 ELSE (l0 + l1) / 2 END,
            CASE WHEN below > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN below > 0.025 THEN h1 ELSE (h0 + h1) / 2 END
          FROM (SELECT *, list_sum([{_binomial('i', 'n', '((l0 + l1) / 2)')} FOR i IN range(k, n + 1)]) AS above, list_sum([{_binomial('i', 'n', '((h0 + h1) / 2)')} FOR i IN range(0, k + 1)]) AS below FROM b WHERE step < 50)
        )
        SELECT grp, n, k, {_r("CASE WHEN k = 0 THEN 0.0 ELSE (l0 + l1) / 2 END")} AS lo, {_r("CASE WHEN k = n THEN 1.0 ELSE (h0 + h1) / 2 END")} AS hi FROM b WHERE step = 50"""
    out["q41_least_effect"] = f"""WITH {OUT}, t0 AS (SELECT lang, {_CELLS} FROM oc GROUP BY lang),
        t AS (
          SELECT row_number() OVER () AS id, * FROM (
            SELECT 'success' AS outcome, * FROM t0 UNION ALL SELECT 'failure', lang, n_neither, n_b_only, n_a_only, n_both FROM t0)
        ),
        i AS (
          SELECT id, lang, outcome, n_both + n_a_only + n_b_only + n_neither AS n, n_both + n_a_only AS w, CASE WHEN w = 0 THEN 0.5 ELSE CAST(w AS DOUBLE) / n END AS p,
            CASE WHEN w = 0 THEN 0.1 ELSE greatest(CAST(n_a_only AS DOUBLE) / w, 0.1) END * p AS lost FROM t
        ),
        g AS (SELECT id, n, lost, gain, gain + 2 * lost AS apart, (gain + lost) / (gain + 2 * lost) AS share FROM i, (SELECT round(CAST(0.01 + 0.005 * unnest(range(200)) AS DOUBLE), 3) AS gain) WHERE gain < 1 - p AND gain + lost <= 1 - p),
        m AS (SELECT CAST(unnest(range(1, (SELECT max(n) FROM i) + 1)) AS BIGINT) AS m),
        c AS (SELECT m, c, sum(exp(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1) - m * ln(2.0))) OVER (PARTITION BY m ORDER BY c) AS tail FROM (SELECT m, CAST(unnest(range(m // 2 + 1)) AS BIGINT) AS c FROM m)),
        r AS (SELECT m, c FROM c JOIN (SELECT m, max(c) AS edge FROM c WHERE 2 * tail < 0.05 GROUP BY m) e USING (m) WHERE c <= edge),
        pw AS (
          SELECT id, gain, sum(CASE WHEN apart >= 1 THEN CAST(m = n AS DOUBLE) ELSE {_binomial('m', 'n', 'apart')} END * ({_binomial('c', 'm', 'share')} + {_binomial('c', 'm', '(1 - share)')})) AS power
          FROM g JOIN r ON r.m <= g.n GROUP BY id, gain
        )
        SELECT lang, outcome, (SELECT min(gain) FROM pw WHERE pw.id = i.id AND power >= 0.8) AS least_effect FROM i"""
    out["q47_paired_runs"] = f"""WITH {COMPARE}, i AS (
          SELECT *, CASE WHEN n_both + n_a_only = 0 THEN 0.5 ELSE CAST(n_both + n_a_only AS DOUBLE) / n END AS p_a, CAST(n_a_only AS DOUBLE) / nullif(n_both + n_a_only, 0) AS seen,
            CASE WHEN n_both + n_a_only = 0 THEN 0.1 ELSE greatest(CAST(n_a_only AS DOUBLE) / (n_both + n_a_only), 0.1) END AS lose FROM cmp
        ),
        g AS (SELECT n, lose * p_a AS lost, gain, gain + 2 * lost AS apart, (gain + lost) / (gain + 2 * lost) AS share FROM i, (SELECT round(CAST(0.01 + 0.005 * unnest(range(200)) AS DOUBLE), 3) AS gain) WHERE gain < 1 - p_a AND gain + lose * p_a <= 1 - p_a),
        m AS (SELECT CAST(unnest(range(1, (SELECT max(n) FROM i) + 1)) AS BIGINT) AS m),
        c AS (SELECT m, c, sum(exp(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1) - m * ln(2.0))) OVER (PARTITION BY m ORDER BY c) AS tail FROM (SELECT m, CAST(unnest(range(m // 2 + 1)) AS BIGINT) AS c FROM m)),
        r AS (SELECT m, c FROM c JOIN (SELECT m, max(c) AS edge FROM c WHERE 2 * tail < 0.05 GROUP BY m) e USING (m) WHERE c <= edge),
        chance AS (SELECT gain, sum(CASE WHEN apart >= 1 THEN CAST(m = n AS DOUBLE) ELSE {_binomial('m', 'n', 'apart')} END * ({_binomial('c', 'm', 'share')} + {_binomial('c', 'm', '(1 - share)')})) AS power FROM g JOIN r ON r.m <= g.n GROUP BY gain)
        SELECT n, {_r('p')} AS p, {_r('delta')} AS delta, {_r('lo')} AS lo, {_r('hi')} AS hi, significant, {_r('p_a')} AS p_a, {_r('seen')} AS lose_observed, {_r('lose')} AS lose, coalesce(seen < lose, true) AS floored,
          (SELECT min(gain) FROM chance WHERE power >= 0.8) AS least_effect FROM i"""
    spoken = " ".join(f"WHEN '{s}' THEN {_spoken(*WORDED[s])}" for s in WORDED)
    out["q42_reasons"] = f"""{episodes(True)}, te AS (
          SELECT zz.episode, string_agg(CASE signal {spoken} END || ' (z=' || printf('%.1f', least(z, 10.0)) || ')' || CASE WHEN combined <= 3.5 THEN ' [below the flag threshold]' ELSE '' END, ' | ' ORDER BY z DESC, place) AS said
          FROM zz JOIN cb ON zz.episode = cb.episode AND zz.view = cb.view WHERE z > 3.0 GROUP BY zz.episode
        ),
        jt AS (SELECT episode, string_agg('frozen joint ' || j, ' | ' ORDER BY j) AS joints FROM pe JOIN dr USING (j) WHERE es = 0 AND ps > 0 AND pa > 0 AND ea > 0.01 * pa GROUP BY episode)
        SELECT eo.episode, quality, concat_ws(' | ', CASE WHEN NOT fin THEN 'non-finite values in state, action or timestamps' END, CASE WHEN h_short THEN 'too short to score' END, CASE WHEN fin THEN joints END,
          CASE WHEN h_gap THEN 'timestamp gap (frames dropped or doubled)' END, CASE WHEN h_sat THEN 'saturation: actions at their limits in a fifth of entries or more' END, said) AS why
        FROM eo LEFT JOIN te ON te.episode = eo.episode LEFT JOIN jt ON jt.episode = eo.episode WHERE quality <> 'ok'"""
    for name, (views, column, alias) in SIGNAL.items():
        out[name] = f"{base(views)} SELECT view, episode, {_r(column)} AS {alias} FROM sg0"
    return out
