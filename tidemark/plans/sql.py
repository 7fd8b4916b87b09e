"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

from tidemark.constants import BACKENDS, BUDGETS, CATEGORIES, CLASSES, DEFAULT_POLICY, POLICIES, Policy

DELIVERIES = """deliveries AS (
  SELECT user_id AS video_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1e7 AS DOUBLE)) AS BIGINT) AS ts_ms,
         least(CAST(1 AS DOUBLE), value / CAST(400 AS DOUBLE)) AS score, event_id AS arrival, event_type AS kind, CAST(259200 AS BIGINT) AS duration_ms
  FROM events)"""
FRAMES = DELIVERIES + """, frames AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY arrival) AS n FROM deliveries) WHERE n = 1)"""
KEYFRAMES = "keyframes AS (SELECT DISTINCT video_id, ts_ms AS kf_ms FROM deliveries WHERE kind = 'signup')"
HELD = """held AS (
  SELECT *, greatest(0.0::DOUBLE, least(2000.0::DOUBLE, coalesce((ts_ms - lag(ts_ms) OVER w) / 2.0::DOUBLE, ts_ms::DOUBLE)))
          + greatest(0.0::DOUBLE, least(2000.0::DOUBLE, coalesce((lead(ts_ms) OVER w - ts_ms) / 2.0::DOUBLE, (duration_ms - ts_ms)::DOUBLE))) AS held,
         row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ts_ms) AS place
  FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms))"""


def six(x: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def unit(x: str) -> str:
    return f"CASE WHEN ({x}) < 0 THEN 0::DOUBLE WHEN ({x}) > 1 THEN 1::DOUBLE ELSE ({x}) END"


def anchors(threshold: float, gap: int) -> str:
    """Greedy independent flags: from each that counts to the first at least the gap later."""
    flagged = f"flagged AS (SELECT video_id, ts_ms FROM frames WHERE score >= {threshold}::DOUBLE)"
    if gap <= 0:
        return f"{flagged}, independents AS (SELECT video_id, count(*) AS independent FROM flagged GROUP BY 1)"
    return f"""{flagged},
    jumps AS (SELECT a.video_id, a.ts_ms, min(b.ts_ms) AS next_ms FROM flagged a LEFT JOIN flagged b ON a.video_id = b.video_id AND a.ts_ms + {gap} <= b.ts_ms GROUP BY 1, 2),
    anchors(video_id, ts_ms) AS (
      SELECT video_id, min(ts_ms) FROM flagged GROUP BY 1
      UNION ALL SELECT j.video_id, j.next_ms FROM anchors c JOIN jumps j ON c.video_id = j.video_id AND c.ts_ms = j.ts_ms WHERE j.next_ms IS NOT NULL),
    independents AS (SELECT video_id, count(*) AS independent FROM anchors GROUP BY 1)"""


def evidence(p: Policy) -> str:
    return f"""WITH RECURSIVE {FRAMES}, {HELD}, {anchors(p.frame_threshold, p.gap_ms)},
    evidence AS (
      SELECT h.video_id, count(*) AS n_frames, max(score) AS max_score, avg(score) FILTER (place <= 3) AS topk_mean, count(*) FILTER (score >= {p.frame_threshold}::DOUBLE) AS flagged,
             coalesce(any_value(i.independent), 0) AS independent, {unit("sum(held) / max(duration_ms)")} AS coverage
      FROM held h LEFT JOIN independents i ON h.video_id = i.video_id GROUP BY 1)"""


def judged(p: Policy) -> str:
    t = f"{p.frame_threshold}::DOUBLE"
    yes = f"(independent >= {p.min_flagged} OR max_score >= {p.single_threshold}::DOUBLE)"
    strength, persistence = unit(f"(topk_mean - {t}) / (1 - {t})"), unit(f"independent / {max(1, p.min_flagged)}::DOUBLE")
    sure = f"0.5::DOUBLE + 0.5::DOUBLE * ({unit(f'0.7::DOUBLE * ({strength}) + 0.3::DOUBLE * ({persistence})')})"
    doubt = f"0.5::DOUBLE + 0.5::DOUBLE * (1 - ({unit(f'max_score / {t}')})) * (0.4::DOUBLE + 0.6::DOUBLE * ({unit('coverage')}))"
    confidence = f"floor(least(0.99::DOUBLE, CASE WHEN {yes} THEN {sure} ELSE {doubt} END) * 100 + 0.5::DOUBLE) / 100::DOUBLE"
    return f"{evidence(p)}, judged AS (SELECT *, {yes} AS contains_inappropriate_content, {confidence} AS confidence FROM evidence)"


def verdict(p: Policy) -> str:
    return f"""{judged(p)} SELECT video_id, n_frames, {six("max_score")} AS max_score, {six("topk_mean")} AS topk_mean, flagged, independent, {six("coverage")} AS coverage,
    contains_inappropriate_content, confidence FROM judged"""


def what_if() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({judged(p)} SELECT video_id, '{p.id}' AS policy, contains_inappropriate_content, confidence FROM judged)" for p in POLICIES.values())


def spans(p: Policy) -> str:
    return f"""WITH {FRAMES}, marked AS (
      SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms) <= 2000 THEN 0 ELSE 1 END AS new FROM frames WHERE score >= {p.frame_threshold}::DOUBLE),
    numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY ts_ms) AS BIGINT) AS segment FROM marked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY score DESC, ts_ms) AS place FROM numbered),
    spans AS (
      SELECT video_id, segment, greatest(0, min(ts_ms) - 600) AS start_ms, least(max(ts_ms) + 600, max(duration_ms)) AS end_ms,
             max(score) AS peak_score, max(ts_ms) FILTER (place = 1) AS peak_ts_ms
      FROM ranked GROUP BY 1, 2)"""


CATEGORY_ROWS = """scored AS (SELECT d.doc_id, d.source, (1 - l.quality)::DOUBLE AS sexual, l.toxic::DOUBLE AS violence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def logits(values: str) -> str:
    """The five sums of every fifth component of a list."""
    part = lambda k: f"coalesce(list_sum(list_transform(list_filter(range(1, len({values}) + 1), lambda i: (i - 1) % 5 = {k}), lambda i: ({values})[i]::DOUBLE)), 0::DOUBLE)"
    return f"[{', '.join(part(k) for k in range(5))}]"


def vectors() -> str:
    raised = "list_transform(logits, lambda x: exp(x - list_max(logits)))"
    return f"""WITH v AS (SELECT vec_id AS frame_id, {logits("embedding")} AS logits FROM embeddings),
    e AS (SELECT frame_id, {raised} AS r FROM v), s AS (SELECT frame_id, list_transform(r, lambda x: x / (r[1] + r[2] + r[3] + r[4] + r[5])) AS p FROM e)"""


def weighted(p: Policy) -> str:
    return unit(" + ".join(f"p[{k + 1}] * {w}::DOUBLE" for k, w in enumerate(p.weights)))


def hashes() -> str:
    # an 8 x 8 image on a 9 x 8 grid: cell g is column g * 8 // 9 of its row
    column = [g * 8 // 9 for g in range(9)]
    bits = [f"CASE WHEN embedding[{8 * y + column[x] + 1}] < embedding[{8 * y + column[x + 1] + 1}] THEN 1 ELSE 0 END" for y in range(8) for x in range(8)]
    digits = [f"substr('0123456789abcdef', 1 + {' + '.join(f'{8 >> j} * ({bits[4 * k + j]})' for j in range(4))}, 1)" for k in range(16)]
    return f"hashes AS (SELECT vec_id AS frame_id, {' || '.join(digits)} AS hash FROM embeddings)"


DEVICES = """devices AS (
  SELECT c_custkey AS device_id, c_custkey % 3 <> 0 AS webgpu, c_custkey % 5 <> 0 AS webgl, c_custkey % 7 <> 0 AS wasm, c_custkey % 2 = 0 AS webcodecs,
         greatest(1, coalesce(CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 17 END, 2)) AS cores, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 13 END AS memory_gb, c_custkey % 6 = 0 AS save_data
  FROM customer),
tiered AS (
  SELECT *, CASE WHEN NOT webgpu AND NOT webgl THEN 'low' WHEN memory_gb <= 2 THEN 'low' WHEN cores <= 2 THEN 'low'
                 WHEN webgpu AND cores >= 8 AND (memory_gb IS NULL OR memory_gb >= 8) THEN 'high' ELSE 'medium' END AS tier,
         CASE WHEN webgpu THEN 'webgpu' WHEN webgl THEN 'webgl' WHEN wasm THEN 'wasm' ELSE 'cpu' END AS backend FROM devices)"""


def by_tier(field: str) -> str:
    return "CASE tier " + " ".join(f"WHEN '{t}' THEN {getattr(b, field)}" for t, b in BUDGETS.items()) + " END"


def tier_budget() -> str:
    less = lambda f, by, low: f"CAST(CASE WHEN save_data THEN greatest({low}, floor(({by_tier(f)}) * {by}::DOUBLE + 0.5::DOUBLE)) ELSE {by_tier(f)} END AS BIGINT)"
    return f"""WITH {DEVICES} SELECT device_id, tier, {less("survey_frames", 0.6, 6)} AS survey_frames, {less("max_frames", 0.5, 16)} AS max_frames, {less("max_ms", 0.6, 0)} AS max_ms,
    CAST({by_tier("target_ms")} AS BIGINT) AS target_ms, CAST({by_tier("concurrency")} AS BIGINT) AS concurrency FROM tiered"""


PLAN = """sized AS (SELECT video_id, max(ts_ms) + 1 AS d FROM deliveries GROUP BY 1),
      counted AS (SELECT *, greatest(1, least(16, greatest(1, d // 250), 120)) AS n FROM sized),
      cells AS (SELECT video_id, d, n, unnest(range(0, n)) AS slot FROM counted WHERE d > 0),
      plan AS (SELECT video_id, slot, CAST(floor((slot + 0.5::DOUBLE) * (d / n::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS ts_ms FROM cells)"""


def chosen(levels: int = 8) -> str:
    """all_frames, refined and requests: survey and refinement under the medium budget, one level of halves after the other."""
    rank = "floor((0.15::DOUBLE + greatest(sa, sb)) * log2(1 + (b - a) / 250::DOUBLE) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE"
    lookup = lambda x, at: f"{x} ASOF LEFT JOIN all_frames f ON x.video_id = f.video_id AND x.{at} >= f.ts_ms LEFT JOIN firsts g ON x.video_id = g.video_id"
    parts = [
        FRAMES.replace(", frames AS (", ", all_frames AS ("),
        PLAN,
        "firsts AS (SELECT video_id, min(ts_ms) AS first_ms, arg_min(score, ts_ms) AS first_score FROM all_frames GROUP BY 1)",
        f"answers AS (SELECT x.video_id, x.ts_ms, coalesce(f.ts_ms, g.first_ms) AS served_ms, coalesce(f.score, g.first_score) AS score FROM {lookup('plan x', 'ts_ms')})",
        "room AS (SELECT video_id, greatest(0, 120 - count(*)) AS room FROM answers GROUP BY 1)",
        "near AS (SELECT *, lag(ts_ms) OVER w AS before, lag(score) OVER w AS before_score, lead(ts_ms) OVER w IS NULL AS ends FROM answers WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms))",
        """open1 AS (SELECT video_id, coalesce(before, 0) AS a, ts_ms AS b, coalesce(before_score, score) AS sa, score AS sb, CAST('Infinity' AS DOUBLE) AS q FROM near
          UNION ALL SELECT n.video_id, n.ts_ms, s.d, n.score, n.score, CAST('Infinity' AS DOUBLE) FROM near n JOIN sized s ON n.video_id = s.video_id WHERE ends)""",
        "done0 AS (SELECT video_id, a, b, sa, sb, q, 0 AS level, a AS mid, a AS served_ms, sa AS score FROM open1 WHERE FALSE)",
    ]
    for k in range(1, levels + 1):
        parts += [
            f"next{k} AS (SELECT video_id, a, b, sa, sb, least(q, {rank}) AS q, {k} AS level, CAST(floor((a + b) / 2.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS mid FROM open{k} WHERE b - a >= 500)",
            f"asked{k} AS (SELECT x.*, coalesce(f.ts_ms, g.first_ms) AS served_ms, coalesce(f.score, g.first_score) AS score FROM {lookup(f'next{k} x', 'mid')})",
            f"""done{k} AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY q DESC, level, a) AS place FROM (SELECT * FROM done{k - 1} UNION ALL SELECT * FROM asked{k})) JOIN room USING (video_id)
              WHERE place <= room)""".replace("EXCLUDE (place)", "EXCLUDE (place, room)"),
            f"""open{k + 1} AS (SELECT video_id, a, mid AS b, sa, score AS sb, q FROM done{k} WHERE level = {k} UNION ALL SELECT video_id, mid, b, score, sb, q FROM done{k} WHERE level = {k})""",
        ]
    parts += [
        f"refined AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY q DESC, level, a) AS place FROM done{levels})",
        "requests AS (SELECT video_id, ts_ms, 0 AS level, served_ms, score FROM answers UNION ALL SELECT video_id, mid, level, served_ms, score FROM refined)",
    ]
    return "WITH " + ", ".join(parts)


#: The keyframe that a request at x, within `far` of it, goes to: the nearest free one of those around it, in the list kfs.
AROUND = """list_sort(list_transform(list_filter(kfs[greatest(1, least(len(kfs), len(list_filter(kfs, lambda k: k < {x})) + 1) - 1):least(len(kfs), len(list_filter(kfs, lambda k: k < {x})) + 1) + 1],
      lambda k: abs(k - {x}) <= {far} AND NOT list_contains({taken}, k)), lambda k: {{'d': abs(k - {x}), 'k': k}}))[1].k"""


def snapped_survey() -> str:
    """deliveries, sized, keyframes, key_lists, asked (video_id, slot, ts_ms, on_keyframe)."""
    got = AROUND.format(x="centre", far="w / 2", taken="taken")
    return f"""{FRAMES.replace(", frames AS (", ", all_frames AS (")}, {KEYFRAMES}, key_lists AS (SELECT video_id, list(kf_ms ORDER BY kf_ms) AS kfs FROM keyframes GROUP BY 1),
      sized AS (SELECT video_id, max(ts_ms) + 1 AS d, least(16, greatest(1, (max(ts_ms) + 1) // 250)) AS n FROM deliveries GROUP BY 1),
      slots AS (SELECT s.video_id, slot, (slot + 0.5::DOUBLE) * (d / n::DOUBLE) AS centre, d / n::DOUBLE AS w, coalesce(kfs, []) AS kfs FROM sized s, unnest(range(n)) AS u(slot), (SELECT 1) LEFT JOIN key_lists k ON k.video_id = s.video_id),
      walk(video_id, slot, ts_ms, own, taken) AS (
        SELECT DISTINCT video_id, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) FROM slots
        UNION ALL
        SELECT video_id, slot, t, own, list_append(taken, t) FROM (SELECT s.video_id, s.slot, taken, CAST(floor(centre + 0.5::DOUBLE) AS BIGINT) AS own, coalesce({got}, CAST(floor(centre + 0.5::DOUBLE) AS BIGINT)) AS t
          FROM walk JOIN slots s ON s.video_id = walk.video_id AND s.slot = walk.slot + 1)),
      asked AS (SELECT video_id, min(slot) AS slot, ts_ms, arg_min(ts_ms <> own, slot) AS on_keyframe FROM walk WHERE slot >= 0 GROUP BY video_id, ts_ms)"""


def snapped_refinement(levels: int = 18) -> str:
    """Survey and refinement on keyframes; frames of error events have no score. One level of halves after the other, all of them kept."""
    rank = "floor((0.15::DOUBLE + greatest(sa, sb)) * log2(1 + (b - a) / 250::DOUBLE) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE"
    lookup = lambda x, at: f"{x} ASOF LEFT JOIN seen f ON x.video_id = f.video_id AND x.{at} >= f.ts_ms LEFT JOIN firsts g ON x.video_id = g.video_id"
    own = "CAST(floor((a + b) / 2.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    parts = [
        snapped_survey(),
        "seen AS (SELECT video_id, ts_ms, CASE WHEN kind <> 'error' THEN score END AS score FROM all_frames)",
        "firsts AS (SELECT video_id, min(ts_ms) AS first_ms, arg_min({'s': score}, ts_ms).s AS first_score FROM seen GROUP BY 1)",
        f"answers AS (SELECT x.video_id, x.ts_ms, x.on_keyframe, coalesce(f.ts_ms, g.first_ms) AS served_ms, CASE WHEN f.ts_ms IS NULL THEN g.first_score ELSE f.score END AS score FROM {lookup('asked x', 'ts_ms')})",
        "room AS (SELECT video_id, greatest(0, 120 - count(*)) AS room FROM answers WHERE score IS NOT NULL GROUP BY 1)",
        "failed AS (SELECT video_id, list(ts_ms) AS lost FROM answers WHERE score IS NULL GROUP BY 1)",
        "near AS (SELECT *, lag(ts_ms) OVER w AS before, lag(score) OVER w AS before_score, lead(ts_ms) OVER w IS NULL AS ends FROM answers WHERE score IS NOT NULL WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms))",
        """open1 AS (SELECT video_id, coalesce(before, 0) AS a, ts_ms AS b, coalesce(before_score, score) AS sa, score AS sb, CAST('Infinity' AS DOUBLE) AS q FROM near
          UNION ALL SELECT n.video_id, n.ts_ms, s.d, n.score, n.score, CAST('Infinity' AS DOUBLE) FROM near n JOIN sized s ON n.video_id = s.video_id WHERE ends)""",
    ]
    got = AROUND.format(x="((a + b) / 2.0::DOUBLE)", far="(b - a) / 4.0::DOUBLE", taken="lost")
    for k in range(1, levels + 1):
        parts += [
            f"next{k} AS MATERIALIZED (SELECT o.video_id, a, b, sa, sb, least(q, {rank}) AS q, {k} AS level, {own} AS own, coalesce({got}, {own}) AS mid, lost FROM (SELECT o.*, coalesce(kfs, []) AS kfs, coalesce(lost, []) AS lost FROM open{k} o LEFT JOIN key_lists USING (video_id) LEFT JOIN failed USING (video_id) WHERE b - a >= 500) o)",
            f"asked{k} AS MATERIALIZED (SELECT x.video_id, a, b, sa, sb, q, level, mid, mid <> own AS on_keyframe, coalesce(f.ts_ms, g.first_ms) AS served_ms, CASE WHEN f.ts_ms IS NULL THEN g.first_score ELSE f.score END AS score FROM {lookup(f'(SELECT * FROM next{k} WHERE NOT list_contains(lost, mid)) x', 'mid')})",
            f"open{k + 1} AS MATERIALIZED (SELECT video_id, a, mid AS b, sa, coalesce(score, sa) AS sb, q FROM asked{k} UNION ALL SELECT video_id, mid, b, coalesce(score, sb), sb, q FROM asked{k})",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM asked{k}" for k in range(1, levels + 1))
    parts.append(f"""best AS (SELECT *, row_number() OVER w AS place, coalesce(sum((score IS NOT NULL)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS recorded FROM ({every}) WINDOW w AS (PARTITION BY video_id ORDER BY q DESC, level, a))""")
    return f"""WITH RECURSIVE {', '.join(parts)}
      SELECT video_id, CAST(NULL AS BIGINT) AS place, ts_ms, 0 AS level, CAST(NULL AS DOUBLE) AS priority, on_keyframe, served_ms, {six('score')} AS score FROM answers
      UNION ALL SELECT video_id, place, mid, level, {six('q')}, on_keyframe, served_ms, {six('score')} FROM best JOIN room USING (video_id) WHERE recorded < room"""


def all_queries() -> dict[str, str]:
    p = POLICIES[DEFAULT_POLICY]
    plan = PLAN
    strict = POLICIES["strict"]
    rest = [c for c in CATEGORIES]
    nearest = """SELECT video_id, ts_ms, kf_ms FROM (
      SELECT f.video_id, f.ts_ms, k.kf_ms, row_number() OVER (PARTITION BY f.video_id, f.ts_ms ORDER BY abs(k.kf_ms - f.ts_ms), k.kf_ms) AS n
      FROM frames f LEFT JOIN keyframes k ON f.video_id = k.video_id AND abs(k.kf_ms - f.ts_ms) <= 5000) WHERE n = 1"""
    dominant = "CASE list_position(p, list_max(p)) " + " ".join(f"WHEN {k + 1} THEN '{c}'" for k, c in enumerate(CLASSES)) + " END"
    made = {
        **{f"scan_verdict_{k}": verdict(v) for k, v in POLICIES.items()},
        "what_if": what_if(),
        "segments": f"{spans(p)} SELECT video_id, segment, start_ms, end_ms, {six('peak_score')} AS peak_score, peak_ts_ms FROM spans",
        "coverage": f"WITH {FRAMES}, {HELD} SELECT video_id, {six(unit('sum(held) / max(duration_ms)'))} AS coverage FROM held GROUP BY 1",
        "independent_flagged": f"""WITH RECURSIVE {FRAMES}, {anchors(0.3, 400)} SELECT f.video_id, f.flagged, i.independent
          FROM (SELECT video_id, count(*) AS flagged FROM flagged GROUP BY 1) f JOIN independents i ON f.video_id = i.video_id""",
        "topk_mean": f"WITH {FRAMES}, {HELD} SELECT video_id, {six('avg(score)')} AS topk_mean FROM held WHERE place <= 3 GROUP BY 1",
        "early_exit": f"""{judged(strict)} SELECT video_id, contains_inappropriate_content AND (max_score >= 0.98::DOUBLE OR (independent >= 2 AND topk_mean >= {strict.frame_threshold + 0.2}::DOUBLE)) AS early_exit FROM judged""",
        "verdict_json": f"""{judged(p)} SELECT video_id, '{{"contains_inappropriate_content":' || contains_inappropriate_content || ',"confidence":' || CAST(confidence AS VARCHAR) || '}}' AS verdict FROM judged""",
        "restricted_report": f"""{spans(p)} SELECT video_id, segment,
          CASE WHEN start_ms >= 60000 THEN (start_ms // 60000) || ':' || lpad(CAST((start_ms % 60000) // 1000 AS VARCHAR), 2, '0') ELSE '0:' || printf('%.1f', start_ms / 1000.0::DOUBLE) END AS starts,
          {six("least(100::DOUBLE, greatest(0::DOUBLE, start_ms / 259200::DOUBLE * 100))")} AS left_pct, {six("greatest(0.6::DOUBLE, (end_ms - start_ms) / 259200::DOUBLE * 100)")} AS width_pct,
          CAST(CAST(floor(peak_score * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '%' AS peak FROM spans""",
        "peak_category": f"""WITH {CATEGORY_ROWS}, long AS (SELECT source, 'sexual' AS category, sexual AS score FROM scored UNION ALL SELECT source, 'violence', violence FROM scored),
          peaks AS (SELECT source, category, greatest(0::DOUBLE, max(score)) AS peak FROM long WHERE score IS NOT NULL GROUP BY 1, 2)
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY peak DESC, category) AS place FROM peaks""",
        "merge_detectors": f"""WITH {CATEGORY_ROWS} SELECT doc_id, CAST((sexual IS NOT NULL)::INT + (violence IS NOT NULL)::INT AS BIGINT) AS n_categories, sexual,
          CASE WHEN violence IS NOT NULL THEN greatest(violence, violence * 0.5::DOUBLE + 0.25::DOUBLE) END AS violence FROM scored""",
        "combine_categories": f"""WITH {CATEGORY_ROWS} SELECT doc_id, coalesce(greatest(sexual, violence), 0::DOUBLE) AS score, coalesce(greatest(sexual, violence * 0.5::DOUBLE), 0::DOUBLE) AS half_violence FROM scored""",
        "screened_sets": f"""WITH {CATEGORY_ROWS}, sets AS (SELECT source, bool_or(sexual IS NOT NULL) AS s, bool_or(violence IS NOT NULL) AS v FROM scored GROUP BY 1)
          SELECT source, array_to_string(list_filter([CASE WHEN s THEN 'sexual' END, CASE WHEN v THEN 'violence' END], lambda x: x IS NOT NULL), ',') AS screened,
          array_to_string(list_filter({rest}, lambda x: NOT (x = 'sexual' AND s) AND NOT (x = 'violence' AND v)), ',') AS unscreened FROM sets""",
        "frame_score": f"{vectors()} SELECT frame_id, " + ", ".join(f"{six(weighted(q))} AS {k}" for k, q in POLICIES.items()) + " FROM s",
        "dominant_class": f"{vectors()} SELECT frame_id, {dominant} AS dominant FROM s",
        "softmax": f"{vectors()} SELECT frame_id, CAST(k AS BIGINT) AS \"at\", {six('p[k + 1]')} AS p FROM s, range(0, 5) t(k)",
        "detector_scan": f"""{vectors()} SELECT frame_id, {six(f"greatest({weighted(p)}, {unit('p[2]')})")} AS score, 'sexual,violence' AS screened, '{",".join(c for c in CATEGORIES if c not in ("sexual", "violence"))}' AS unscreened, 1::DOUBLE AS neutral_by_default FROM s""",
        "merge_crops": f"""WITH h AS (SELECT vec_id AS frame_id, embedding[1:((len(embedding) + 1) // 2)] AS x, embedding[((len(embedding) + 1) // 2 + 1):] AS y FROM embeddings),
          v AS (SELECT frame_id, {logits("x")} AS a, {logits("y")} AS b FROM h),
          e AS (SELECT frame_id, list_transform(a, lambda x: exp(x - list_max(a))) AS a, list_transform(b, lambda x: exp(x - list_max(b))) AS b FROM v)
          SELECT frame_id, {", ".join(six(f"greatest(a[{k + 1}] / (a[1] + a[2] + a[3] + a[4] + a[5]), b[{k + 1}] / (b[1] + b[2] + b[3] + b[4] + b[5]))") + f" AS {c.lower()}" for k, c in enumerate(CLASSES))} FROM e""",
        "hit_probability": f"{spans(p)} SELECT video_id, segment, {six('least(1::DOUBLE, 16 * (end_ms - start_ms)::DOUBLE / 259200::DOUBLE)')} AS probability FROM spans",
        "frame_rate": "SELECT fps, count(*) AS seconds FROM (SELECT date_trunc('second', ts) AS s, count(*) AS fps FROM events GROUP BY 1) GROUP BY 1",
        "report": f"""{judged(p)} SELECT '| ' || video_id || ' | ' || CASE WHEN contains_inappropriate_content THEN 'flagged' ELSE 'clean' END || ' | ' || printf('%.2f', confidence) || ' | '
          || CAST(CAST(floor(coverage * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '% | ' || CASE WHEN n_frames * 20 < 1000 THEN CAST(n_frames * 20 AS VARCHAR) || ' ms' ELSE printf('%.2f s', n_frames * 20 / 1000.0::DOUBLE) END || ' |' AS value FROM judged""",
        "dhash": f"WITH {hashes()} SELECT * FROM hashes",
        "near_dup_banded": f"""WITH {hashes()}, counted AS (SELECT hash, count(*) AS frames FROM hashes WHERE hash <> repeat('0', 16) GROUP BY 1),
          pairs AS (SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) AS BIGINT) AS distance, a.frames AS frames_a, b.frames AS frames_b
                    FROM counted a JOIN counted b ON a.hash < b.hash) SELECT * FROM pairs WHERE distance <= 6""",
        "near_hash_groups": f"""WITH RECURSIVE {hashes()}, counted AS (SELECT hash, count(*) AS frames FROM hashes WHERE hash <> repeat('0', 16) GROUP BY 1),
          near AS MATERIALIZED (SELECT a.hash AS a, b.hash AS b FROM counted a JOIN counted b ON a.hash <> b.hash AND bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) <= 6),
          reach(a, b) AS (SELECT hash, hash FROM counted UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
          least AS (SELECT a AS hash, min(b) AS group_hash FROM reach GROUP BY 1), n AS (SELECT a AS hash, count(*) AS n FROM near GROUP BY 1)
          SELECT hash, frames, coalesce(n, 0) AS n_near, group_hash FROM counted JOIN least USING (hash) LEFT JOIN n USING (hash)""",
        "first_delivered": f"WITH {FRAMES} SELECT video_id, ts_ms, arrival, {six('score')} AS score FROM frames",
        "survey_plan": f"WITH {DELIVERIES}, {plan} SELECT * FROM plan",
        "survey_lookup": f"""WITH {FRAMES}, {plan}, firsts AS (SELECT video_id, min(ts_ms) AS first FROM frames GROUP BY 1)
          SELECT q.video_id, q.slot, q.ts_ms, coalesce(f.ts_ms, g.first) AS served_ms FROM plan q ASOF LEFT JOIN frames f ON q.video_id = f.video_id AND q.ts_ms >= f.ts_ms LEFT JOIN firsts g ON q.video_id = g.video_id""",
        "keyframe_asof": f"""WITH {FRAMES}, {KEYFRAMES}, firsts AS (SELECT video_id, min(kf_ms) AS first FROM keyframes GROUP BY 1)
          SELECT f.video_id, f.ts_ms, coalesce(k.kf_ms, g.first) AS kf_ms FROM frames f ASOF LEFT JOIN keyframes k ON f.video_id = k.video_id AND f.ts_ms >= k.kf_ms LEFT JOIN firsts g ON f.video_id = g.video_id""",
        "nearest_keyframe": f"WITH {FRAMES}, {KEYFRAMES} {nearest}",
        "range_mitigation": f"""{spans(p)} SELECT video_id, ts_ms FROM frames f WHERE EXISTS (SELECT 1 FROM spans s WHERE s.video_id = f.video_id AND f.ts_ms BETWEEN s.start_ms - 250 AND s.end_ms)""",
        "player_state": f"""WITH v AS ({verdict(p)}), raw AS ({judged(p)} SELECT video_id, coverage FROM judged), s AS ({spans(p)} SELECT * FROM spans), {FRAMES}, ends AS (SELECT video_id, max(ts_ms) AS ts_ms FROM frames GROUP BY 1),
          counted AS (SELECT video_id, count(*) AS segments FROM s GROUP BY 1),
          state AS (SELECT v.video_id, contains_inappropriate_content AS flagged, raw.coverage, coalesce(c.segments, 0) AS segments,
            EXISTS (SELECT 1 FROM s WHERE s.video_id = e.video_id AND e.ts_ms BETWEEN s.start_ms - 250 AND s.end_ms) AS in_span
            FROM v JOIN raw ON v.video_id = raw.video_id JOIN ends e ON v.video_id = e.video_id LEFT JOIN counted c ON v.video_id = c.video_id)
          SELECT video_id, segments, in_span, segments > 0 AND coverage >= 0.9::DOUBLE AS trustworthy, flagged AND (NOT (segments > 0 AND coverage >= 0.9::DOUBLE) OR in_span) AS obscured FROM state""",
        "timer_histogram": """WITH t AS (SELECT event_type AS name, event_id, value AS ms FROM events WHERE isfinite(value) AND value >= 0),
          late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id DESC) AS n FROM t) WHERE n <= 512),
          whole AS (SELECT name, count(*) AS count, max(ms) AS max FROM t GROUP BY 1),
          part AS (SELECT name, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, avg(ms) AS mean FROM late GROUP BY 1)
          SELECT whole.name, whole.count, floor(p50 * 100 + 0.5::DOUBLE) / 100::DOUBLE AS p50, floor(p95 * 100 + 0.5::DOUBLE) / 100::DOUBLE AS p95,
          floor(mean * 100 + 0.5::DOUBLE) / 100::DOUBLE AS mean, floor(whole.max * 100 + 0.5::DOUBLE) / 100::DOUBLE AS max FROM whole JOIN part ON whole.name = part.name""",
        "throughput": f"""WITH {DELIVERIES}, t AS (SELECT video_id, count(*) FILTER (kind = 'purchase') AS n, (max(ts_ms) - min(ts_ms)) / 1000::DOUBLE AS s FROM deliveries GROUP BY 1)
          SELECT video_id, CASE WHEN s > 0 THEN {six("n / s")} ELSE 0::DOUBLE END AS per_second FROM t""",
        "counters": f"""WITH {DELIVERIES}, c AS (SELECT video_id, kind, count(*) AS n FROM deliveries GROUP BY 1, 2)
          SELECT video_id, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS counters FROM c GROUP BY 1""",
        "long_tasks": "SELECT user_id AS scan_id, count(*) AS tasks, max(value) AS worst_ms FROM events WHERE value >= 50 GROUP BY 1",
        "latest_progress": "SELECT conv_id, turn, max(role) AS role FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id) GROUP BY 1, 2",
        "tier_budget": tier_budget(),
        "capabilities": f"""WITH {DEVICES} SELECT device_id, tier || ' tier - ' || backend || ' - ' || cores || ' cores' || CASE WHEN memory_gb IS NOT NULL THEN ' - ' || memory_gb || ' GB' ELSE '' END || CASE WHEN webcodecs THEN ' - WebCodecs' ELSE '' END AS description,
          CASE backend {" ".join(f"WHEN '{b}' THEN '{'>'.join(BACKENDS[k:])}'" for k, b in enumerate(BACKENDS))} END AS chain,
          array_to_string(list_filter([CASE WHEN device_id % 9 <> 0 AND NOT webgpu THEN 'a GPU interface is there, but no adapter could be had' END, CASE WHEN NOT webcodecs THEN 'no codec interface: frames are taken by seeking, which is slower' END,
            CASE WHEN NOT webgpu AND NOT webgl THEN 'no GPU backend: inference runs on the processor, and slower' END], lambda x: x IS NOT NULL), '; ') AS notes FROM tiered""",
        "timeline_axis": f"""WITH {DELIVERIES}, sized AS (SELECT video_id, max(ts_ms) + 1 AS d FROM deliveries GROUP BY 1), marks AS (SELECT video_id, share, d * share AS ms FROM sized, (SELECT unnest([0, 0.25, 0.5, 0.75, 1])::DOUBLE AS share))
          SELECT video_id, share, CASE WHEN ms >= 60000 THEN CAST(floor(ms / 60000) AS BIGINT) || ':' || lpad(CAST(CAST(floor(ms / 1000 - 60 * floor(ms / 60000)) AS BIGINT) AS VARCHAR), 2, '0') ELSE '0:' || printf('%.1f', ms / 1000) END AS label FROM marks""",
        "luma_means": f"""WITH p AS (SELECT vec_id AS frame_id, list_transform(range(0, 16), lambda i: 0.299::DOUBLE * embedding[4 * i + 1]::DOUBLE + 0.587::DOUBLE * embedding[4 * i + 2]::DOUBLE + 0.114::DOUBLE * embedding[4 * i + 3]::DOUBLE) AS luma FROM embeddings)
          SELECT frame_id, {six("list_sum(luma) / 16")} AS mean_luma FROM p""",
        "model_fitness": f"""WITH v AS (SELECT {logits("embedding")} AS l, label % 2 = 0 AS clean FROM embeddings), m AS (SELECT max(l[2]) - min(l[2]) AS swing, count(*) FILTER (clean AND l[1] > l[2]) / count(*) FILTER (clean) AS ratio FROM v)
          SELECT {six("swing")} AS swing, {six("ratio")} AS ratio, swing >= 4 AND ratio >= 0.67::DOUBLE AS fit FROM m""",
        "governor": f"""WITH {DELIVERIES}, t AS (SELECT video_id, quantile_disc(score * 400, 0.5) AS p50, count(*) AS n FROM deliveries GROUP BY 1),
          g AS (SELECT *, n >= 6 AND p50 > 0 AND p50 / 45::DOUBLE > 1.5::DOUBLE AS throttled, least(3::DOUBLE, p50 / 45::DOUBLE) AS f FROM t)
          SELECT video_id, CAST(CASE WHEN throttled THEN greatest(16, floor(120 / f + 0.5::DOUBLE)) ELSE 120 END AS BIGINT) AS max_frames,
          CAST(CASE WHEN throttled THEN floor(250 * least(2::DOUBLE, f) + 0.5::DOUBLE) ELSE 250 END AS BIGINT) AS min_gap_ms, throttled, CASE WHEN throttled THEN {six("f")} ELSE 1::DOUBLE END AS factor FROM g""",
        "resolution_floor": f"""WITH {DELIVERIES}, s AS (SELECT video_id, floor(ts_ms / 100::DOUBLE) AS slot, count(*) - 1 AS again FROM deliveries GROUP BY 1, 2), t AS (SELECT video_id, CAST(sum(again) AS BIGINT) AS duplicates FROM s GROUP BY 1)
          SELECT video_id, duplicates, CAST(CASE WHEN duplicates <= 2 THEN 250 ELSE floor(least(250 * pow(1.6::DOUBLE, duplicates - 2), greatest(250::DOUBLE, 259200 / 8::DOUBLE)) + 0.5::DOUBLE) END AS BIGINT) AS floor_ms FROM t""",
        "source_decision": """WITH f AS (SELECT o_orderkey AS file_id, o_orderstatus <> 'P' AS local, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice * 1000) AS BIGINT) END AS size, o_orderkey % 7 <> 0 AS api, o_orderkey % 3 <> 0 AS iso FROM orders),
          d AS (SELECT file_id, CASE WHEN NOT api THEN 'no codec API' WHEN NOT local THEN 'remote' WHEN NOT iso THEN 'container' WHEN coalesce(size, 0) > 314572800 THEN 'size' ELSE 'indexed' END AS reason FROM f)
          SELECT file_id, CASE WHEN reason = 'indexed' THEN 'webcodecs' ELSE 'video-element' END AS kind, reason FROM d""",
        "url_validation": "SELECT page_id, coalesce(regexp_matches(lower(trim(url)), '^https?://[^\\s/]+'), FALSE) AS accepted FROM pages",
        "median_gap": f"""WITH {FRAMES}, s AS (SELECT video_id, ts_ms, arrival % 90 AS dur, kind = 'signup' AS sync FROM frames), anysync AS (SELECT video_id, bool_or(sync) AS marked, min(ts_ms) AS first, count(*) FILTER (sync) AS k FROM s GROUP BY 1),
          i AS (SELECT s.video_id, s.ts_ms, s.dur, CASE WHEN a.marked THEN s.sync ELSE s.ts_ms = a.first END AS sync FROM s JOIN anysync a ON s.video_id = a.video_id),
          ends AS (SELECT video_id, arg_max(ts_ms + dur, ts_ms) AS last, count(*) FILTER (sync) AS keyframes FROM i GROUP BY 1),
          fm AS (SELECT video_id, list_sort(list(dur)) AS v FROM i WHERE dur > 0 GROUP BY 1),
          gaps AS (SELECT video_id, ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY ts_ms) AS gap FROM i WHERE sync),
          gm AS (SELECT video_id, list_sort(list(gap)) AS v FROM gaps WHERE gap > 0 GROUP BY 1),
          t AS (SELECT e.video_id, greatest(1, last) AS duration_ms, keyframes, coalesce(fm.v[len(fm.v) // 2 + 1]::DOUBLE, 40::DOUBLE) AS frame_ms, gm.v[len(gm.v) // 2 + 1] AS keyframe_gap_ms
                FROM ends e LEFT JOIN fm ON e.video_id = fm.video_id LEFT JOIN gm ON e.video_id = gm.video_id)
          , r AS (SELECT *, CASE WHEN keyframes >= 2 AND keyframe_gap_ms / greatest(1::DOUBLE, frame_ms) > 24 THEN keyframe_gap_ms::DOUBLE ELSE frame_ms END AS resolution_ms FROM t)
          SELECT *, greatest(250, CAST(floor(resolution_ms + 0.5::DOUBLE) AS BIGINT)) AS sampling_gap_ms FROM r""",
        "random_access": f"""WITH {FRAMES}, {plan}, m AS (SELECT video_id, bool_or(kind = 'signup') AS marked FROM frames GROUP BY 1),
          numbered AS (SELECT f.video_id, f.ts_ms, row_number() OVER (PARTITION BY f.video_id ORDER BY f.ts_ms) AS n, f.kind = 'signup' AS sync, m.marked FROM frames f JOIN m ON f.video_id = m.video_id),
          keyed AS (SELECT *, sync OR (NOT marked AND n = 1) AS key FROM numbered),
          k AS (SELECT *, last_value(CASE WHEN key THEN n END IGNORE NULLS) OVER w AS kn, last_value(CASE WHEN key THEN ts_ms END IGNORE NULLS) OVER w AS kt FROM keyed WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
          g AS (SELECT video_id, ts_ms, CASE WHEN coalesce(n - kn > 24, FALSE) THEN kt ELSE ts_ms END AS served_ms, key OR coalesce(n - kn > 24, FALSE) AS on_keyframe, n FROM k),
          q AS (SELECT p.video_id, p.slot, p.ts_ms, coalesce(f.ts_ms, (SELECT min(g.ts_ms) FROM g WHERE g.video_id = p.video_id)) AS sample_ms FROM plan p ASOF LEFT JOIN frames f ON p.video_id = f.video_id AND p.ts_ms >= f.ts_ms)
          SELECT q.video_id, q.slot, q.ts_ms, g.served_ms, g.on_keyframe FROM q JOIN g ON q.video_id = g.video_id AND q.sample_ms = g.ts_ms""",
        "refine_plan": f"""{chosen()} SELECT video_id, place, mid AS ts_ms, level, {six("q")} AS priority, served_ms, {six("score")} AS score FROM refined""",
        "snapped_survey": f"WITH RECURSIVE {snapped_survey()} SELECT video_id, slot, ts_ms, on_keyframe FROM asked",
        "snapped_refinement": snapped_refinement(),
        "scan_stats": f"""{chosen()}, c AS (SELECT video_id, count(*) FILTER (level = 0) AS surveyed, count(*) FILTER (level > 0) AS refined, count(*) FILTER (score IS NULL) AS failed, count(DISTINCT served_ms) AS frames FROM requests GROUP BY 1)
          SELECT *, surveyed + refined - frames AS duplicates FROM c""",
        "selected_verdict": f"""{judged(p).replace(FRAMES, chosen().removeprefix("WITH ") + ", frames AS (SELECT DISTINCT video_id, served_ms AS ts_ms, score, CAST(259200 AS BIGINT) AS duration_ms FROM requests)")}
          SELECT video_id, n_frames, {six("max_score")} AS max_score, {six("coverage")} AS coverage, contains_inappropriate_content, confidence FROM judged""",
        "perceptual_dedupe": f"""WITH RECURSIVE {hashes()}, rows AS (SELECT CAST(e.label AS BIGINT) AS video_id, h.frame_id AS arrival, ('0x' || h.hash)::UBIGINT AS h, (h.frame_id % 97) / 97.0::DOUBLE AS score,
            row_number() OVER (PARTITION BY e.label ORDER BY h.frame_id) AS n FROM hashes h JOIN embeddings e ON h.frame_id = e.vec_id),
          fold(video_id, n, held, kept, arrival, score, inherited) AS (
            SELECT DISTINCT video_id, CAST(0 AS BIGINT), CAST([] AS UBIGINT[]), CAST([] AS DOUBLE[]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), FALSE FROM rows
            UNION ALL
            SELECT video_id, n, CASE WHEN hit OR h = 0 THEN held ELSE list_append(held, h)[-24:] END, CASE WHEN hit OR h = 0 THEN kept ELSE list_append(kept, own)[-24:] END, arrival,
                   CASE WHEN hit THEN kept[len(gaps) - list_position(list_reverse(gaps), list_min(gaps)) + 1] ELSE own END, hit
            FROM (SELECT r.video_id, r.n, r.h, r.score AS own, r.arrival, held, kept, list_transform(held, lambda x: bit_count(xor(x, r.h))) AS gaps, h <> 0 AND coalesce(list_min(list_transform(held, lambda x: bit_count(xor(x, r.h)))) <= 12, FALSE) AS hit
                  FROM fold JOIN rows r ON r.video_id = fold.video_id AND r.n = fold.n + 1))
          SELECT video_id, arrival, score, inherited FROM fold WHERE n > 0""",
        "streaming_segments": f"{spans(p)} SELECT video_id, segment, start_ms, end_ms, {six('peak_score')} AS peak_score, peak_ts_ms FROM spans",
        "streaming_verdict": f"{judged(p)} SELECT video_id, n_frames, contains_inappropriate_content, confidence FROM judged",
        "scan_outcomes": f"""WITH {DELIVERIES}, o AS (SELECT *, row_number() OVER w AS step, ts_ms - min(ts_ms) OVER (PARTITION BY video_id) AS elapsed, coalesce(lag(kind = 'purchase' AND score > 0.475::DOUBLE) OVER w, FALSE) AS cancelled
            FROM deliveries WINDOW w AS (PARTITION BY video_id ORDER BY ts_ms, arrival)),
          l AS (SELECT *, kind = 'error' AS failed, kind <> 'error' AND row_number() OVER (PARTITION BY video_id, ts_ms, kind = 'error' ORDER BY step) > 1 AS duplicate FROM o),
          b AS (SELECT *, coalesce(count(*) FILTER (NOT failed AND NOT duplicate) OVER v, 0) AS frames, coalesce(max(elapsed) OVER v, 0) AS spent, least(16, count(*) OVER (PARTITION BY video_id)) AS surveys FROM l WINDOW v AS (PARTITION BY video_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          e AS (SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN frames >= 48 THEN 'frame-budget' WHEN spent > 200000 THEN 'time-budget' END AS reason FROM b),
          stops AS (SELECT video_id, min(step) AS at, arg_min(reason, step) AS reason FROM e WHERE reason IS NOT NULL GROUP BY 1),
          r AS (SELECT e.video_id, any_value(s.reason) AS reason, count(*) FILTER (made AND NOT failed AND NOT duplicate) AS sampled, count(*) FILTER (made AND failed) AS failed, count(*) FILTER (made AND duplicate) AS duplicates,
            coalesce(max(elapsed) FILTER (made), 0) AS elapsed_ms, min(spent) FILTER (made AND step >= surveys AND frames > 0) AS first FROM (SELECT e.*, s.at IS NULL OR e.step < s.at AS made FROM e LEFT JOIN stops s USING (video_id)) e LEFT JOIN stops s USING (video_id) GROUP BY 1),
          t AS (SELECT *, coalesce(reason, CASE WHEN sampled >= 48 THEN 'frame-budget' WHEN elapsed_ms > 200000 THEN 'time-budget' ELSE 'complete' END) AS stop_reason FROM r)
          SELECT video_id, stop_reason, CASE WHEN sampled = 0 AND stop_reason <> 'cancelled' THEN 'no-frames' ELSE stop_reason END AS outcome, sampled, failed, duplicates, elapsed_ms, coalesce(first, CASE WHEN sampled > 0 THEN elapsed_ms END) AS first_verdict_ms FROM t""",
    }
    made["streaming_histogram"] = made["timer_histogram"]
    return made
