"""Queries on framed signals, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import signals, speech
from lectern.queries import _AMP
from lectern.registry import ORACLE_SQL, query
from lectern.sources import tables as S

#: The limits for vectors as frames of 64 samples at 256 Hz, whose bins are 4 Hz apart.
LIMITS = signals.Limits(low_share=0.4, low_bin=10, low_frames=1, noise_zcr=0.45, noise_centroid=16.0, noise_flatness=0.5, noise_frames=2, tone_bin=8.0, tone_mad=7.0, centroid_mad=1.5, centroid_off=7.0, tone_flatness=0.62, no_speech=0.2)
L = LIMITS
_FEATURES = f"fe as (select f.vec_id, label clip, frame_no, rms_dbfs, zcr, dominant_bin, centroid, flatness, low_share from ({_AMP.join(['with ', ' select vec_id, label, frame_no from a'])}) f join ({ORACLE_SQL['frame_levels']}) using (vec_id) join ({ORACLE_SQL['frame_spectrum']}) using (vec_id))"
#: Samples a second: 3 s are then no multiple of a frame, so the exact first and last samples have cases of their own.
RATE = 250
EDGE = 750
_SIGNAL = """pc0 as (select label clip, frame_no, max(frame_no) over (partition by label) last, v from a), pc as (select clip, frame_no * 64 pos, case when frame_no = last then v[1 : 21 + 4 * (clip % 10)] else v end v from pc0),
    sg as (select clip, pos + generate_subscripts(v, 1) - 1 i, unnest(v) x from pc), sn as (select clip, count(*) al, count(*) // 64 c from sg group by 1)"""
_QUIET = f"20 * log10(sqrt(greatest(avg(x * x) - avg(x) ** 2, 0) + 1e-12) + 1e-12) <= {L.silent}"
_EDGES = f"""{_SIGNAL}, hd as (select clip, i // 64 no, any_value(c) c, {_QUIET} q from sg join sn using (clip) group by 1, 2), tl as (select clip, (al - 1 - i) // 64 no, any_value(c) c, {_QUIET} q from sg join sn using (clip) group by clip, (al - 1 - i) // 64),
    h as (select clip, bool_and(q) silent, min(case when no < c and not q then no end) f from hd group by 1), t as (select clip, min(case when no < c and not q then no end) f from tl group by 1),
    x1 as (select clip, {_QUIET} q from sg where i < {EDGE} group by 1), x2 as (select clip, {_QUIET} q from sg join sn using (clip) where i >= al - {EDGE} group by 1),
    eg as (select sn.clip, al, c, silent, coalesce(h.f, c) * 64 hs, coalesce(t.f, c) * 64 ts, al >= {EDGE} and x1.q pq, al >= {EDGE} and x2.q sq from sn join h using (clip) join t using (clip) join x1 using (clip) join x2 using (clip)),
    eh as (select *, case when hs < {EDGE} and pq then {EDGE} else hs end hh, case when ts < {EDGE} and sq then {EDGE} else ts end tt from eg),
    ed as (select clip, 'silent' kind, 0 s, al e from eh where silent union all select clip, 'leading', 0, hh from eh where not silent and c > 0 and hh >= {EDGE} union all select clip, 'trailing', al - tt, al from eh where not silent and c > 0 and tt >= {EDGE})"""
#: A detector for these signals: speech is what is loud in frames of 16 samples.
_SPEECH = {"level": -17.0, "frame": 0.064, "silence": 0.13, "speech": 0.1, "margin": 0.02}
_GAPS = f"""vf as (select clip, i // 16 no from sg group by 1, 2 having count(*) = 16 and avg(x * x) >= pow(10, {_SPEECH['level'] / 10})),
    vr as (select clip, min(no) * 16 s, (max(no) + 1) * 16 e from (select *, no - row_number() over (partition by clip order by no) g from vf) group by clip, g),
    vm as (select *, case when s - lag(e) over (partition by clip order by s) < {_SPEECH['silence'] * RATE} then 0 else 1 end new from vr), vn as (select *, sum(new) over (partition by clip order by s) g from vm),
    vs as (select clip, greatest(0, min(s) - 5) s, least(any_value(al), max(e) + 5) e from vn join sn using (clip) group by clip, g having max(e) - min(s) >= {_SPEECH['speech'] * RATE}),
    vo as (select *, max(e) over (partition by clip order by s, e rows between unbounded preceding and 1 preceding) b from vs), vp as (select *, sum(case when s <= b then 0 else 1 end) over (partition by clip order by s, e) g from vo), vq as (select clip, min(s) s, max(e) e from vp group by clip, g),
    vg as (select clip, e s, lead(s) over (partition by clip order by s) e from vq union all select clip, 0, al from sn where clip not in (select clip from vq)),
    ns as (select vg.clip, s, e from vg join sg on sg.clip = vg.clip and i >= s and i < e where (e - s) / {RATE} >= {L.no_speech} group by all having sum(x * x) > 0 and 10 * log10(avg(x * x)) >= {L.no_speech_level} - 1e-6)"""
_MED = "list_aggregate({}, 'median')"
_TONE = f"""tw as (select clip, list({{'frame_no': frame_no, 'rms': rms_dbfs, 'bin': dominant_bin::double, 'c': centroid, 'fl': flatness}}) over (partition by clip order by frame_no rows between current row and {L.tone_frames - 1} following) m from fe),
    tx as (select *, list_transform(m, lambda x: x.bin) b, list_transform(m, lambda x: x.c) c, list_transform(m, lambda x: x.rms) r, list_transform(m, lambda x: x.fl) fl from tw where len(m) = {L.tone_frames}),
    ty as (select *, {_MED.format('b')} tone, {_MED.format('c')} middle from tx),
    tz as (select clip, tone, middle, unnest(m) x from ty where list_min(r) >= {L.tone_level} and list_max(r) - list_min(r) <= {L.tone_range} and tone >= {L.tone_bin} and {_MED.format('list_transform(b, lambda x: abs(x - tone))')} <= {L.tone_mad}
      and {_MED.format('list_transform(c, lambda x: abs(x - middle))')} <= {L.centroid_mad} and {_MED.format('list_transform(c, lambda x: abs(x - tone))')} <= {L.centroid_off} and {_MED.format('fl')} <= {L.tone_flatness}),
    tone as (select distinct clip, x.frame_no frame_no from tz where abs(x.bin - tone) <= {2 * L.tone_mad} and abs(x.c - middle) <= {2 * L.centroid_mad})"""


def _runs(name: str, rows: str, least: int) -> str:
    return f"{name} as (select clip, '{name}' kind, min(frame_no) s, max(frame_no) + 1 e from (select clip, frame_no, frame_no - row_number() over (partition by clip order by frame_no) i from {rows}) group by clip, i having count(*) >= {least})"


def _features(spark, d):
    return signals.features(S.frames(spark, d), 64, 8)


def _detector():
    return speech.EnergyDetector(**_SPEECH)


@query(f'with {_AMP}, {_EDGES} select clip, kind, s "start", e "end" from ed')
def edge_silence(spark, d):
    """Silence at the edges of signals whose lengths are no multiples of a frame, in samples."""
    return signals.edge_silence(S.pieces(spark, d), 64, RATE, LIMITS)


@query(f'with {_AMP}, {_SIGNAL}, {_GAPS} select clip, s "start", e "end" from ns')
def no_speech(spark, d):
    """Loud stretches that a detector takes for no speech, in samples."""
    return speech.no_speech(S.pieces(spark, d), RATE, _detector, LIMITS.no_speech, LIMITS.no_speech_level)


@query(f"with {_FEATURES}, {_TONE} select * from tone")
def rolling_tone(spark, d):
    return signals.rolling_tone(_features(spark, d), LIMITS)


@query(f"""with {_AMP}, {_FEATURES}, {_EDGES}, {_GAPS}, {_TONE},
    lf as (select clip, frame_no, rms_dbfs >= {L.low_level} and low_share >= {L.low_share} flag, rms_dbfs >= {L.low_level} and dominant_bin <= {L.low_bin} support from fe),
    lx as (select *, coalesce(max(case when not support then frame_no end) over (partition by clip order by frame_no rows between unbounded preceding and 1 preceding) + 1, 0) l,
      coalesce(min(case when not support then frame_no end) over (partition by clip order by frame_no rows between 1 following and unbounded following), count(*) over (partition by clip)) r, frame_no - sum(flag::int) over (partition by clip order by frame_no) i from lf),
    ls as (select distinct min_by(l, frame_no) s, max_by(r, frame_no) e, clip from lx where flag group by clip, i having count(*) >= {L.low_frames}),
    lm as (select *, max(e) over (partition by clip order by s, e rows between unbounded preceding and 1 preceding) b from ls), ln as (select *, sum(case when s <= b then 0 else 1 end) over (partition by clip order by s, e rows unbounded preceding) g from lm),
    low as (select clip, 'low' kind, min(s) s, max(e) e from ln group by clip, g),
    {_runs('noise', f"(select * from fe where rms_dbfs >= {L.noise_level} and zcr >= {L.noise_zcr} and centroid >= {L.noise_centroid} and flatness >= {L.noise_flatness})", L.noise_frames)},
    {_runs('tones', 'tone', L.tone_frames)}
    select clip, kind, s "start", e "end" from ed union all select clip, kind, s * 64, e * 64 from low union all select clip, kind, s * 64, e * 64 from noise union all select clip, 'tone', s * 64, e * 64 from tones union all select clip, 'no speech', s, e from ns""")
def issue_detect(spark, d):
    """All issues, those of the plug-in detector too, in samples."""
    return signals.issues(_features(spark, d), S.pieces(spark, d), 64, RATE, LIMITS, include_vad=True, loader=_detector)


@query(f"""with {_AMP}, p as (select label clip, list_sum(list_transform(v, lambda x: x * x)) / len(v) p, list_max(list_transform(v, lambda x: abs(x))) peak from a),
    g as (select clip, avg(case when p >= 1e-7 then p end) / 10 gate, max(peak) top from p group by 1), m as (select clip, avg(p) mean from p join g using (clip) where p >= 1e-7 and p >= gate group by 1)
    select clip, round(10 * log10(mean), 4) "level", round(case when mean is not null then least(-20 - 10 * log10(mean), -3 - 20 * log10(top)) end, 4) gain from g left join m using (clip)""")
def gain_to_target(spark, d):
    return signals.gain_to_target(S.frames(spark, d), -20.0, -3.0)


_CUTS = f"""{_AMP}, s as (select label clip, frame_no * 64 + generate_subscripts(v, 1) - 1 pos, unnest(v) x from a),
    fr as (select clip, pos // 3 no from s group by 1, 2 having count(*) = 3 and sqrt(avg(x * x) + 1e-12) >= pow(10, -2.5)),
    pa as (select clip, lag(no) over (partition by clip order by no) + 1 a, no b from fr), pq as (select clip, a, a * 3 + 64 l, b * 3 - 64 r from pa where (b - a) * 3 > 128),
    cuts as (select pq.clip, a, min_by(pos, (abs(x), pos)) filter (where pos between l - 1 and l) s, min_by(pos, (abs(x), pos)) filter (where pos between r and r + 1) e from pq join s on s.clip = pq.clip and (pos between l - 1 and l or pos between r and r + 1) group by 1, 2)"""


def _whole(spark, d):
    return S.frames(spark, d).select("clip", (F.col("frame_no") * 64).alias("pos"), "samples")


@query(f'with {_CUTS} select clip, s "start", e "end" from cuts where e > s')
def pause_cuts(spark, d):
    return signals.pause_cuts(_whole(spark, d), 256, 0.5)


@query(f"with {_CUTS} select clip, count(*) samples, round(sum(x), 5) total from s where not exists (select 1 from cuts c where c.clip = s.clip and c.e > c.s and s.pos >= c.s and s.pos < c.e) group by 1")
def pause_apply(spark, d):
    p = _whole(spark, d)
    left = signals.pause_apply(p, signals.pause_cuts(p, 256, 0.5))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return left.groupBy("clip").agg(F.sum(F.size("samples")).alias("samples"), F.round(F.sum(total), 5).alias("total"))


@query("""with s as (select vec_id, embedding[1 : 40 + vec_id % 25] x from embeddings), f as (select vec_id, x, unnest(range(0, len(x) // 25)) frame_no from s)
    select vec_id, frame_no, cast(len(x[frame_no * 25 + 1 : frame_no * 25 + 25]) as bigint) n, cast(x[frame_no * 25 + 1] as double) "first", cast(x[frame_no * 25 + 25] as double) "last" from f""")
def frame_signal(spark, d):
    """Signals of 40 to 64 samples in whole frames of 25."""
    x = S.read(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (40 + F.col("vec_id") % 25).cast("int")).alias("samples"))
    ends = [F.element_at("frame", i).cast("double").alias(n) for i, n in ((1, "first"), (-1, "last"))]
    return signals.frame_signal(x, 25).select("vec_id", "frame_no", F.size("frame").cast("long").alias("n"), *ends)
