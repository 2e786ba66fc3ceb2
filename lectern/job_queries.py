"""Queries on jobs, books and their parts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.plans import status
from lectern.queries import MARKERS, chapter_markers
from lectern.registry import query
from lectern.sources import files
from lectern.sources import tables as S



def _events(spark, d):
    """Signups start, errors ask to stop, purchases end in one of three states, views and clicks are partial updates."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "purchase", "finish").otherwise("update")
    number, view = F.col("event_id"), F.col("event_type") == "view"
    end = F.when(number % 3 == 0, "completed").when(number % 3 == 1, "failed").otherwise("stopped")
    return S.read(spark, d, "events").select(
        F.col("user_id").alias("project"), F.struct("ts", "event_id").alias("at"), kind.alias("kind"), "event_id",
        F.when(kind == "finish", end).alias("state"), F.when(view | (kind == "finish"), F.col("value") / 400).alias("fraction"),
        F.when(view, number % 50 - 2).alias("completed"), F.when(view & (number % 2 == 0), F.lit(40).cast("long")).alias("total"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("eta"), F.when(number % 5 == 0, F.concat(F.lit("chunk "), number % 7)).alias("phase"),
        F.when(number % 4 == 0, F.concat(F.lit("event "), number)).alias("message"),
    )


_FOLD = f"""ev as (select user_id project, ts, event_id, case event_type when 'signup' then 'start' when 'error' then 'stop' when 'purchase' then 'finish' else 'update' end kind,
      case when event_type = 'purchase' then case event_id % 3 when 0 then 'completed' when 1 then 'failed' else 'stopped' end end state, case when event_type in ('view', 'purchase') then value / 400 end fraction,
      case when event_type = 'view' then event_id % 50 - 2 end completed, case when event_type = 'view' and event_id % 2 = 0 then 40::bigint end total, case when event_type = 'click' then value end eta,
      case when event_id % 5 = 0 then 'chunk ' || event_id % 7 end phase, case when event_id % 4 = 0 then 'event ' || event_id end message from events),
    li as (select project, list({{'kind': kind, 'state': state, 'phase': phase, 'message': message, 'fraction': fraction, 'completed': completed, 'total': total, 'eta': eta}} order by ts, event_id) l from ev group by 1),
    fo as (select project, list_reduce(l, lambda a, x: case
        when x.kind = 'start' and a.state not in ('running', 'stopping') then {{'kind': '', 'state': 'running', 'phase': 'starting', 'message': '{status.MESSAGES['starting']}', 'fraction': 0.0::double, 'completed': 0::bigint, 'total': 0::bigint, 'eta': null::double}}
        when x.kind = 'update' then {{'kind': '', 'state': a.state, 'phase': coalesce(x.phase, a.phase), 'message': coalesce(x.message, a.message), 'fraction': case when x.fraction is null then a.fraction else greatest(0, least(1, x.fraction)) end, 'completed': case when x.completed is null then a.completed else greatest(0, x.completed) end, 'total': coalesce(x.total, a.total), 'eta': coalesce(x.eta, a.eta)}}
        when x.kind = 'stop' and a.state in ('running', 'stopping') then {{'kind': '', 'state': 'stopping', 'phase': 'stopping', 'message': '{status.MESSAGES['stopping']}', 'fraction': a.fraction, 'completed': a.completed, 'total': a.total, 'eta': null::double}}
        when x.kind = 'finish' then {{'kind': '', 'state': x.state, 'phase': x.state, 'message': coalesce(x.message, x.state), 'fraction': case when x.fraction is null then a.fraction else greatest(0, least(1, x.fraction)) end, 'completed': a.completed, 'total': a.total, 'eta': null::double}}
        else a end, {{'kind': '', 'state': 'idle', 'phase': 'idle', 'message': '{status.MESSAGES['idle']}', 'fraction': 0.0::double, 'completed': 0::bigint, 'total': 0::bigint, 'eta': null::double}}) s from li)"""


@query(f"with {_FOLD} select project, s.state state, s.phase phase, s.message message, round(s.fraction, 6) fraction, s.completed completed, s.total total, round(s.eta, 6) eta from fo")
def job_state(spark, d):
    return status.job_state(_events(spark, d)).withColumns({c: F.round(c, 6) for c in ("fraction", "eta")})


@query(f"with {_FOLD}, r as (select project, s.state in ('running', 'stopping') active, s from fo) select project, case when active then 'interrupted' else s.state end state, case when active then 'interrupted' else s.phase end phase, case when not active then round(s.eta, 6) end eta, round(s.fraction, 6) fraction from r")
def job_restart(spark, d):
    """The jobs' snapshots as the next run finds them."""
    again = status.restarted(status.job_state(_events(spark, d)))
    return again.select("project", "state", "phase", F.round("eta", 6).alias("eta"), F.round("fraction", 6).alias("fraction"))


@query("""with ev as (select user_id project, event_id, event_type t, row_number() over w i, count_if(event_type = 'purchase') over w g from events where event_type in ('signup', 'purchase') window w as (partition by user_id order by ts, event_id))
    select project, event_id, i = min(i) over (partition by project, g) accepted, first(event_id) over (partition by project, g order by i) holder from ev where t = 'signup'""")
def single_slot(spark, d):
    return status.single_slot(_events(spark, d)).select("project", F.col("at.event_id").alias("event_id"), "accepted", F.col("holder.event_id").alias("holder"))


@query("""with s as (select event_id, case event_type when 'signup' then 'interrupted' when 'error' then 'halted' when 'purchase' then 'completed' else 'running' end state, value / 450 fraction, case when event_id % 7 = 0 then null else value - 5 end eta, event_id % 40 - 1 completed from events)
    select event_id, array_to_string(list_filter([case when state = 'halted' then 'state' end, case when fraction > 1 then 'fraction' end, case when eta < 0 then 'eta' end, case when completed < 0 then 'completed' end], lambda x: x is not null), ',') faults from s""")
def snapshot_quarantine(spark, d):
    state = F.when(F.col("event_type") == "signup", "interrupted").when(F.col("event_type") == "error", "halted").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    rows = S.read(spark, d, "events").select("event_id", state.alias("state"), (F.col("value") / 450).alias("fraction"), F.when(F.col("event_id") % 7 != 0, F.col("value") - 5).alias("eta"), (F.col("event_id") % 40 - 1).alias("completed"))
    return status.snapshot_faults(rows).select("event_id", F.array_join("faults", ",").alias("faults"))


@query("""with p as (select o_orderkey, o_custkey % 40 done, 40 + o_orderkey % 29056 total, floor(o_totalprice / 5000) elapsed, o_orderkey % 3 * 1000 cached from orders),
    q as (select *, greatest(0, cast(round_even(case when done > 0 then elapsed * (total - done) / done end, 0) as bigint)) s from p)
    select o_orderkey, format('{:,}', done) || '/' || format('{:,}', total) || ' (' || cast(100 * done // total as varchar) || '%), ETA ' ||
    case when done = 0 then 'calculating…' when s < 60 then printf('%ds', s) when s < 3600 then printf('%dm %02ds', s // 60, s % 60) else printf('%dh %02dm', s // 3600, s // 60 % 60) end || case when cached > 0 then '; ' || format('{:,}', cached) || ' cached skipped' else '' end line from q""")
def progress_line(spark, d):
    o = S.read(spark, d, "orders")
    done, total = F.col("o_custkey") % 40, 40 + F.col("o_orderkey") % 29056
    return o.select("o_orderkey", status.progress_line(done, total, F.floor(F.col("o_totalprice") / 5000), F.col("o_orderkey") % 3 * 1000).alias("line"))


@query("select conv_id, max(turn) last_turn, cast(sum(coalesce(length(text), 0)) as bigint) done, round(sum(coalesce(length(text), 0)) * 100.0 / 24000 / (0.5 * (max(turn) + 1)), 6) speed from conversations group by 1")
def live_progress(spark, d):
    """What the running stream of a conversation's chunks shows last."""
    from lectern.streaming import jobs

    return jobs.live_progress(S.read(spark, d, "conversations"), 24_000)


@query("select doc_id // 64 batch, count(*) size, count(*) - count_if(quality = 0) ok, coalesce(string_agg(case when quality = 0 then doc_id end, ',' order by doc_id), '') retained from labels group by 1")
def batch_quality(spark, d):
    """Per batch of 64 indices how many are fine, and the indices of those that are not."""
    bad = F.array_sort(F.collect_list(F.when(F.col("quality") == 0, F.col("doc_id"))))
    rows = S.read(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 64).alias("batch"))
    return rows.agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) - F.count_if(F.col("quality") == 0)).alias("ok"), F.array_join(bad, ",").alias("retained"))


@query("""with n as (select doc_id, split_part(text, chr(10), 1) line, row_number() over (partition by source order by doc_id) n from documents where text is not null and text != '')
    select doc_id, case when length(line) between 1 and 120 then line else 'Chapter ' || n end title from n""")
def chapter_title(spark, d):
    docs = S.read(spark, d, "documents").filter("text is not null and text != ''").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("line"))
    docs = docs.withColumn("line", F.when(F.length("line").between(1, 120), F.col("line")))
    return status.numbered(docs, "source", "doc_id").select("doc_id", F.coalesce("line", F.concat(F.lit("Chapter "), F.col("n").cast("string"))).alias("title"))


@query("select o_orderkey pos, c_custkey item, c_name path from orders join (select c_custkey, c_name from customer where c_custkey % 5 != 0) on c_custkey = o_custkey")
def spine_manifest(spark, d):
    """Ordered references meet their items; unknown ones are skipped, and of two items with one id the last wins."""
    items = S.read(spark, d, "customer").filter("c_custkey % 5 != 0").groupBy(F.col("c_custkey").alias("item")).agg(F.max_by("c_name", "c_custkey").alias("path"))
    return S.read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("item")).join(items, "item").select("pos", "item", "path")


@query("select book, item, tier from (select p_brand book, p_partkey item, case when p_partkey % 97 = 0 then 0 when p_type like 'PROMO%' then 1 when p_type like '%STEEL%' then 2 else 3 end tier, row_number() over (partition by p_brand order by case when p_partkey % 97 = 0 then 0 when p_type like 'PROMO%' then 1 when p_type like '%STEEL%' then 2 else 3 end, p_partkey) r from part) where r = 1")
def priority_pick(spark, d):
    tier = F.when(F.col("p_partkey") % 97 == 0, 0).when(F.col("p_type").startswith("PROMO"), 1).when(F.col("p_type").contains("STEEL"), 2).otherwise(3)
    p = S.read(spark, d, "part").select(F.col("p_brand").alias("book"), F.struct(tier.alias("tier"), F.col("p_partkey").alias("item")).alias("x"))
    return p.groupBy("book").agg(F.min("x").alias("x")).select("book", "x.item", "x.tier")


@query("""with n as (select doc_id, n_chars * 7 samples from documents), p as (select *, (samples + 639) // 640 * 640 padded, (samples * 25 + 15999) // 16000 tokens, samples // 333 mel from n)
    select doc_id, padded, tokens, least(tokens, mel // 2) kept from p""")
def align_tokens(spark, d):
    """Samples padded to 40 ms at 16 kHz, 25 tokens a second, and no more tokens than half the mel frames."""
    samples = F.col("n_chars") * 7
    whole = lambda x: F.floor(x).cast("long")
    p = S.read(spark, d, "documents").select("doc_id", (whole((samples + 639) / 640) * 640).alias("padded"), whole((samples * 25 + 15999) / 16000).alias("tokens"), whole(samples / 333).alias("mel"))
    return p.select("doc_id", "padded", "tokens", F.least("tokens", whole(F.col("mel") / 2)).alias("kept"))


@query("""select label clip, vec_id // 8 chunk, cast(count(*) * 64 + (count(*) - 1) * 31 as bigint) samples, round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 5) total from embeddings group by 1, 2""")
def join_silence(spark, d):
    """The parts of a chunk (8 at most) in order, with 0.12 s of zeros at 256 Hz between them."""
    from lectern.operators.signals import join_parts

    v = S.read(spark, d, "embeddings").select(F.col("label").alias("clip"), F.floor(F.col("vec_id") / 8).alias("chunk"), F.col("vec_id").alias("part"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    j = join_parts(v, ["clip", "chunk"], 31)
    return j.select("clip", "chunk", F.size("samples").cast("long").alias("samples"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_SEED = "(doc_id * 1103515 + (k + 1) * 12345) % 2147483646 + 1"


@query(f"with c as (select doc_id, k, {_SEED} seed from documents, range(6) r(k)), u as (select doc_id, seed from c where k < doc_id % 4) select doc_id, min_by(seed, k) seed from c where not exists (select 1 from u where u.doc_id = c.doc_id and u.seed = c.seed) group by 1")
def fresh_seeds(spark, d):
    """The first candidate seed of each chunk that no earlier attempt has used."""
    c = S.read(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    c = c.withColumn("seed", (F.col("doc_id") * 1103515 + (F.col("k") + 1) * 12345) % 2147483646 + 1)
    used = c.filter(F.col("k") < F.col("doc_id") % 4).select("doc_id", "seed")
    return c.join(used, ["doc_id", "seed"], "left_anti").groupBy("doc_id").agg(F.min_by("seed", "k").alias("seed"))


#: A small invented dictionary in file order: glyph and code; glyphs that share a code are told apart by their ordinal.
GLYPHS = (("ä", "a"), ("à", "a"), ("â", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ö", "o"), ("ó", "o"), ("ü", "u"), ("ú", "u"), ("ß", "s"), ("ñ", "n"), ("ç", "c"))
_CODES = "(values " + ", ".join(f"({i}, '{g}', '{c}')" for i, (g, c) in enumerate(GLYPHS)) + ")"


@query(f"""with d as (select g, c || case when o > 0 then cast(o as varchar) else '' end code from (select g, c, row_number() over (partition by c order by i) - 1 o from {_CODES} t(i, g, c))),
    x as (select doc_id, unnest(string_split(text, '')) ch, generate_subscripts(string_split(text, ''), 1) pos from documents where text is not null and text != '')
    select doc_id, md5(string_agg(coalesce(code, ch), '' order by pos)) coded_md5 from x left join d on g = ch group by 1""")
def dictionary_code(spark, d):
    from lectern.functions.glyphs import dictionary_code as coded

    return S.read(spark, d, "documents").filter("text is not null and text != ''").select("doc_id", F.md5(coded(F.col("text"), GLYPHS).cast("binary")).alias("coded_md5"))


@query(f"""with {MARKERS}, l as (select book, chapter_no * 10 line_no, '[CHAPTER]' line from markers union all select book, chapter_no * 10 + 1, 'TIMEBASE=1/1000' from markers union all select book, chapter_no * 10 + 2, 'START=' || start_ms from markers
    union all select book, chapter_no * 10 + 3, 'END=' || end_ms from markers union all select book, chapter_no * 10 + 4, 'title=Part \\#' || chapter_no || '\\; book ' || book from markers union all select distinct book, 1, 'title=Book \\= ' || book from markers)
    select book, cast(line_no as bigint) line_no, line from l""")
def marker_sheet(spark, d):
    """The lines of each book's marker sheet: its tags, then a block for each chapter."""
    from lectern.plans.sheets import marker_sheet as sheet

    markers = chapter_markers(spark, d).withColumn("title", F.format_string("Part #%d; book  %d", "chapter_no", "book"))
    tags = markers.select("book", F.concat(F.lit("Book = "), F.col("book").cast("string")).alias("title"), F.lit(" ").alias("genre")).distinct()
    return sheet(tags, markers)


@query()
def visible_text(spark, d):
    """The lines of each page that a reader sees, in page order."""
    pages = S.read(spark, d, "pages").select("page_id", F.posexplode(files.visible_text(F.col("html"))).alias("line_no", "line"))
    return pages.select("page_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*', ''), '[?#].*$', '') path, page_id % 3 up, page_id % 7 = 0 deep from pages),
    s as (select page_id, list_concat(['', 'OEBPS'], case up when 0 then [] when 1 then ['..'] else ['..', '..'] end::varchar[], list_filter(string_split(path, '/'), lambda x: x not in ('', '.')), case when deep then ['..', 'x'] else [] end::varchar[]) s from p),
    m as (select page_id, list_reduce(s, lambda a, x: case when a = '!' then a when x != '..' then a || '/' || x when a = '' then '!' else regexp_replace(a, '/[^/]*$', '') end) m from s)
    select page_id, case when m != '!' then substr(m, 2) end member from m""")
def safe_member(spark, d):
    """Page paths as archive members seen from OEBPS, some of them reaching upwards; null where they leave the archive
    and where there is no url."""
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://[^/]*", ""), "[?#].*$", "")
    p = S.read(spark, d, "pages").select("page_id", path.alias("path"))
    deep = F.when(F.col("page_id") % 7 == 0, "/../x").otherwise("")
    href = F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 3).cast("int")), F.regexp_replace(F.regexp_replace("path", "^/+", ""), "%", "%25"), deep)
    return p.select("page_id", files.safe_member(F.lit("OEBPS"), href).alias("member"))