"""All queries of the reference's operators on the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import tables as table_functions
from lectern.functions import text as T
from lectern.operators import intervals, vectors
from lectern.plans import resume, sheets, status, timeline
from lectern.registry import ORACLE_SQL, QUERIES, query
from lectern.sources import tables as S

RATE, BATCH, LIMIT = 24_000, 4, 200


# The character classes of functions.text for RE2
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def _unit(t: str, alone: str = "false", flush: str = "false") -> str:
    return "{'t': %s, 'alone': %s, 'flush': %s}" % (t, alone, flush)


_ABBR = ", ".join(f"'{x}'" for x in T.ABBREVIATIONS)
_CLOSE = r"[\"''”’»)\]}]*$"
_ENDS = rf"(regexp_matches(w, '[.!?]{_CLOSE}') and not (regexp_matches(w, '(^|[^.!?])\.{_CLOSE}') and (lower(regexp_extract(w, '([A-Za-z.]*)\.{_CLOSE}', 1)) in ({_ABBR}) or regexp_matches(lower(regexp_extract(w, '([A-Za-z.]*)\.{_CLOSE}', 1)), '^[a-z](\.[a-z])*$'))))"
SENTENCES = rf"""
    paras as (select doc_id, unnest(regexp_split_to_array(text, '\n+')) p, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) para from documents where text is not null),
    words as (select doc_id, para, unnest(string_split({_ws('p')}, ' ')) w, generate_subscripts(string_split({_ws('p')}, ' '), 1) pos from paras where {_ws('p')} != ''),
    flags as (select *, {_ENDS} e from words),
    ids as (select *, coalesce(sum(e::int) over (partition by doc_id, para order by pos rows between unbounded preceding and 1 preceding), 0) sid from flags),
    sents as (select doc_id, para, sid, string_agg(w, ' ' order by pos) s from ids group by all),
    lists as (select doc_id, list(s order by para, sid) ss from sents group by doc_id)"""


def _fold(units: str, limit: int) -> str:
    """DuckDB: the greedy fold over a list of structs (t, alone, flush)."""
    kind = "struct(o varchar[], c varchar, t varchar, alone boolean, flush boolean)"
    seed = f"{{'o': []::varchar[], 'c': '', 't': '', 'alone': false, 'flush': false}}::{kind}"
    mapped = f"list_transform({units}, lambda u: {{'o': []::varchar[], 'c': '', 't': u.t, 'alone': u.alone, 'flush': u.flush}}::{kind})"
    fits = f"(not u.flush and not u.alone and (a.c = '' or length(a.c) + 1 + length(u.t) <= {limit}))"
    done = f"(case when {fits} or a.c = '' then a.o else list_append(a.o, a.c) end)"
    step = f"{{'o': case when u.alone then list_append({done}, u.t) else {done} end, 'c': case when u.alone then '' when {fits} and a.c != '' then a.c || ' ' || u.t else u.t end, 't': '', 'alone': false, 'flush': false}}::{kind}"
    return f"list_transform([list_reduce(list_prepend({seed}, {mapped}), lambda a, u: {step})], lambda r: case when r.c = '' then r.o else list_append(r.o, r.c) end)[1]"


_CLAUSES = r"list_filter(string_split(regexp_replace(s, '([,;:—–])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: c != '')"
_SLICE = _unit(f"substr(w, k * {LIMIT} + 1, {LIMIT})", "true")
_CUT = f"flatten(list_transform(list_filter(string_split(c, ' '), lambda w: w != ''), lambda w, i: case when length(w) > {LIMIT} then list_transform(range(0, ((length(w) - 1) // {LIMIT}) + 1), lambda k: {_SLICE}) else [{_unit('w', 'false', 'i = 1')}] end))"
_PARTS = f"case when length(s) <= {LIMIT} then [s] else " + _fold(f"flatten(list_transform({_CLAUSES}, lambda c: case when length(c) > {LIMIT} then {_CUT} else [{_unit('c')}] end))", LIMIT) + " end"
_TURNS = "flatten(list_transform(pss, lambda ps, i: list_transform(ps, lambda p: " + _unit("p", f"length(ss[i]) >= 80 and regexp_matches(ss[i], '{T.DIALOGUE_MARKS}')") + ")))"
CHUNKS = f"""{SENTENCES},
    parts as (select doc_id, para, sid, s, {_PARTS} ps from sents),
    units as (select doc_id, list(ps order by para, sid) pss, list(s order by para, sid) ss from parts group by doc_id),
    chunks as (select doc_id, {_fold(_TURNS, LIMIT)} cs from units)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = S.read(spark, d, "documents").filter("text is not null").withColumn("ss", T.sentences(F.col("text")))
    return docs.withColumn("cs", T.pack_chunks(F.col("ss"), LIMIT))


@query(f"select doc_id, {_ws('text')} collapsed from documents")
def collapse_ws(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.collapse_ws(F.col("text")).alias("collapsed"))


@query(f"with {SENTENCES} select d.doc_id, cast(coalesce(len(ss), 0) as bigint) n_sentences, md5(coalesce(array_to_string(ss, chr(10)), '')) sentences_md5 from documents d left join lists using (doc_id)")
def sentences(spark, d):
    """Documents without words, or without text, have none."""
    docs = S.read(spark, d, "documents").withColumn("ss", T.sentences(F.col("text")))
    return docs.select("doc_id", _size("ss").alias("n_sentences"), _digest("ss").alias("sentences_md5"))


def _size(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0)).cast("long")


def _digest(array: str) -> Column:
    return F.md5(F.coalesce(F.array_join(array, "\n"), F.lit("")).cast("binary"))


@query(f"with {SENTENCES}, n as (select doc_id, count(*) n from sents where length(s) >= 80 and regexp_matches(s, '{T.DIALOGUE_MARKS}') group by doc_id) select d.doc_id, coalesce(n, 0) n_dialogue from documents d left join n using (doc_id)")
def dialogue_turns(spark, d):
    docs = S.read(spark, d, "documents").withColumn("said", F.filter(T.sentences(F.col("text")), T.is_dialogue))
    return docs.select("doc_id", _size("said").alias("n_dialogue"))


@query(f"with {CHUNKS} select d.doc_id, cast(coalesce(len(cs), 0) as bigint) n_chunks, md5(coalesce(array_to_string(cs, chr(10)), '')) chunks_md5 from documents d left join chunks using (doc_id)")
def pack_chunks(spark, d):
    """Documents without words, or without text, have none."""
    docs = S.read(spark, d, "documents").withColumn("cs", T.pack_chunks(T.sentences(F.col("text")), LIMIT))
    return docs.select("doc_id", _size("cs").alias("n_chunks"), _digest("cs").alias("chunks_md5"))


@query(f"with {CHUNKS} select doc_id, cast(generate_subscripts(cs, 1) - 1 as bigint) pos, md5(unnest(cs)) chunk_md5 from chunks")
def chunk_text(spark, d):
    """Every chunk of every document, by the table function for SQL."""
    table_functions.register(spark)
    S.read(spark, d, "documents").createOrReplaceTempView("lectern_documents")
    return spark.sql(f"select doc_id, cast(pos as bigint) pos, md5(cast(chunk as binary)) chunk_md5 from lectern_documents, lateral chunk_text(text, {LIMIT})")


@query(f"with {CHUNKS} select doc_id, para, cast(sid as bigint) sid, cast(len(ps) as bigint) n_parts, md5(array_to_string(ps, chr(10))) parts_md5 from parts where length(s) > {LIMIT}".replace("doc_id, para, cast(sid as bigint) sid,", "doc_id, md5(s) sentence_md5,"))
def split_oversized(spark, d):
    s = S.read(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).filter(F.length("s") > LIMIT)
    s = s.withColumn("ps", T.split_oversized(F.col("s"), LIMIT))
    return s.select("doc_id", F.md5(F.col("s").cast("binary")).alias("sentence_md5"), F.size("ps").cast("long").alias("n_parts"), F.md5(F.array_join("ps", "\n").cast("binary")).alias("parts_md5"))


@query(f"""with {CHUNKS} select source, count(*) chapters, cast(sum(length(text)) as bigint) characters, cast(sum(coalesce(len(cs), 0)) as bigint) chunks
    from documents d left join chunks c using (doc_id) where text is not null group by source""")
def corpus_summary(spark, d):
    """Chapters, characters and chunks of each book."""
    return _chunks(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.length("text")).alias("characters"), F.sum(F.size("cs")).cast("long").alias("chunks"))


@query(f"""with {CHUNKS}, each as (select doc_id, unnest(cs) c, generate_subscripts(cs, 1) pos from chunks)
    select source, cast(row_number() over (partition by source order by doc_id, pos) - 1 as bigint) chunk_index, doc_id, cast(length(c) as bigint) n_chars from each join documents using (doc_id)""")
def chunk_book(spark, d):
    c = _numbered_chunks(spark, d, F.length)
    return c.select("source", F.col("idx").alias("chunk_index"), "doc_id", F.col("of").cast("long").alias("n_chars"))


def _numbered_chunks(spark, d, of):
    """source, doc_id, idx (the chunk's number in its source) and `of` each chunk; documents are numbered, not chunks."""
    c = _chunks(spark, d).select("source", "doc_id", F.transform("cs", of).alias("of")).withColumn("n", F.size("of").cast("long"))
    return status.running(c, "source", "doc_id", "n").select("source", "doc_id", "before", F.posexplode("of").alias("pos", "of")).withColumn("idx", F.col("before") + F.col("pos"))


@query(f"""with {CHUNKS}, each as (select doc_id, unnest(cs) c, generate_subscripts(cs, 1) pos from chunks),
    n as (select source, row_number() over (partition by source order by doc_id, pos) - 1 i, doc_id, c from each join documents using (doc_id))
    select source, cast(i as bigint) idx, doc_id, md5(c) text_md5, case when i % 7 < 5 then printf('chunks/%06d.wav', i) end audio_file from n""")
def chunk_manifest(spark, d):
    """The manifest's chunk rows; the file is named where the chunk is complete."""
    c = _numbered_chunks(spark, d, lambda t: F.md5(t.cast("binary")))
    return c.select("source", "idx", "doc_id", F.col("of").alias("text_md5"), F.when(F.col("idx") % 7 < 5, F.format_string("chunks/%06d.wav", "idx")).alias("audio_file"))


@query(f"""with {CHUNKS}, b as (select doc_id, cs, doc_id % (len(cs) + 1) done from chunks where len(cs) > 0)
    select doc_id, cast(len(cs) as bigint) total, cast(done as bigint) completed, md5(array_to_string(cs, chr(10))) texts_md5, md5(array_to_string(list_transform(range(done), lambda i: printf('chunks/%06d.wav', i)), ',')) files_md5 from b""")
def book_manifest(spark, d):
    """Each document's nested manifest as JSON, read back: its chunks in order, with a file for those that are complete."""
    c = _chunks(spark, d).filter(T.has_words(F.col("text"))).select("doc_id", "cs", F.pmod("doc_id", F.size("cs") + 1).cast("long").alias("done"))
    back = c.select("doc_id", F.from_json(sheets.manifest(F.col("doc_id").cast("string"), F.col("cs"), F.col("done")), sheets.MANIFEST).alias("m"))
    join = lambda field, by: F.md5(F.array_join(f"m.chunks.{field}", by).cast("binary"))
    return back.select("doc_id", F.col("m.total").alias("total"), F.col("m.completed").alias("completed"), join("text", "\n").alias("texts_md5"), join("audio_file", ",").alias("files_md5"))


@query(f"""with {CHUNKS}, each as (select doc_id, unnest(cs) c, generate_subscripts(cs, 1) pos from chunks),
    n as (select source, row_number() over (partition by source order by doc_id, pos) - 1 i from each join documents using (doc_id))
    select source, cast(i // {BATCH} as bigint) batch_no, cast(min(i) as bigint) first_index, count(*) size, cast(42 + min(i) as bigint) seed from n group by source, i // {BATCH}""")
def batches(spark, d):
    c = chunk_book(spark, d).groupBy("source", F.floor(F.col("chunk_index") / BATCH).alias("batch_no")).agg(F.min("chunk_index").alias("first_index"), F.count(F.lit(1)).alias("size"))
    return c.withColumn("seed", F.col("first_index") + 42)


@query(f"""with {CHUNKS}, a as (select doc_id book, generate_subscripts(cs, 1) - 1 idx, unnest(cs) t from chunks), b as (select book, idx, case when book % 7 = 0 and idx % 3 = 1 then t || '!' else t end t from a where not (book % 7 = 0 and idx = 9))
    select coalesce(a.book, b.book) book, cast(min(case when a.t is distinct from b.t then coalesce(a.idx, b.idx) end) as bigint) first_difference, count(a.t) saved, count(b.t) now
    from a full join b on a.book = b.book and a.idx = b.idx group by 1 having first_difference is not null""")
def plan_diff(spark, d):
    # outer: every text here has chunks, and the filter that Spark infers for an inner explode would make them twice
    a = _chunks(spark, d).filter(T.has_words(F.col("text"))).select(F.col("doc_id").alias("book"), F.posexplode_outer("cs").alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))
    odd = F.col("book") % 7 == 0
    b = a.filter(~(odd & (F.col("idx") == 9))).withColumn("text", F.when(odd & (F.col("idx") % 3 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return resume.plan_diff(a, b)


@query(r"select doc_id, cast(len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) as bigint) ideographs, cast(len(regexp_extract_all(text, '[\x{30A1}-\x{30FA}]')) as bigint) katakana, cast(len(regexp_extract_all(text, '[à-ÿ]')) as bigint) accented from documents")
def script_profile(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return S.read(spark, d, "documents").select("doc_id", n("[一-鿿]").alias("ideographs"), n("[ァ-ヺ]").alias("katakana"), n("[à-ÿ]").alias("accented"))


@query(r"select p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 80), ''), 'audiobook') slug from part")
def project_slug(spark, d):
    return S.read(spark, d, "part").select("p_partkey", T.project_slug(F.col("p_name")).alias("slug"))


@query("""select doc_id, list_filter([case when text is null or trim(text) = '' then 'blank' end, case when 60 + doc_id % 50 < 80 then 'max_chars' end, case when doc_id % 5 < 1 then 'batch' end, case when lang not in ('de', 'en', 'fr') then 'language' end], lambda x: x is not null) reasons from documents""".replace("select doc_id, list_filter", "select doc_id, array_to_string(list_filter").replace("lambda x: x is not null) reasons", "lambda x: x is not null), ',') reasons"))
def request_check(spark, d):
    rules = (("blank", F.col("text").isNull() | (F.trim("text") == "")), ("max_chars", 60 + F.col("doc_id") % 50 < 80), ("batch", F.col("doc_id") % 5 < 1), ("language", ~F.col("lang").isin("de", "en", "fr")))
    return S.read(spark, d, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])), ",").alias("reasons"))


@query("select lang, count(*) documents, lang in ('de', 'en', 'fr') supported from documents group by lang")
def language_support(spark, d):
    docs, known = S.read(spark, d, "documents"), spark.createDataFrame([("de",), ("en",), ("fr",)], "lang string")
    yes = docs.join(known, "lang", "left_semi").withColumn("supported", F.lit(True))
    no = docs.join(known, "lang", "left_anti").withColumn("supported", F.lit(False))
    return yes.unionByName(no).groupBy("lang", "supported").agg(F.count(F.lit(1)).alias("documents"))


@query(f"""with m as (select doc_id, source, coalesce(strlen(text), 0) n from documents), r as (select *, sum(n) over (partition by source order by doc_id) running from m)
    select doc_id, source, cast(running as bigint) running, n > {8 << 20} or running > {64 << 20} "over", bool_or(n > {8 << 20} or running > {64 << 20}) over (partition by source) book_failed from r""")
def size_caps(spark, d):
    """Every document as a member of its source's archive."""
    m = S.read(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("pos"), F.octet_length("text").cast("long").alias("bytes"))
    return status.size_caps(m).select(F.col("pos").alias("doc_id"), F.col("book").alias("source"), "running", "over", "book_failed")


_SUP = T.SUPERSCRIPTS
_DQ = T.DOUBLE_QUOTES
_PLAIN = "".join(T.PLAIN_MARKS)
# RE2 has no look-behind and look-ahead: what they test is captured and put back
_GAP = WS[:-1]
_BRACKET = rf"\[{_GAP}*[0-9{_SUP}]+{_GAP}*\]"
_C0 = rf"regexp_replace(text, '{_BRACKET}', ' ', 'g')"
_RAISED = rf"([\p{{L}}\p{{N}}_])[{_SUP}]+({_GAP}|$|[.,!?])"
_GLUED = rf"(^|[^\p{{Nd}}])([.!?][\"''”’»)\]]?)[0-9]+({_GAP}|$)"
_C1 = rf"regexp_replace({_C0}, '{_RAISED}', '\1 \2', 'g')"
_C = rf"regexp_replace({_C1}, '{_GLUED}', '\1\2\3', 'g')"
# initials are put between two private characters, and what lies between these is spelled
_DOTTED = r"(^|[^A-Za-z])((?:[A-Z]\.){2,})"
_I = rf"array_to_string(list_transform(string_split(regexp_replace({_C}, '{_DOTTED}', '\1' || chr(57344) || '\2' || chr(57345), 'g'), chr(57344)), lambda p: case when contains(p, chr(57345)) then rtrim(replace(split_part(p, chr(57345), 1), '.', ' ')) || split_part(p, chr(57345), 2) else p end), '')"
_Q = f"translate(regexp_replace({_I}, '[{_DQ}]', '', 'g'), '{_PLAIN}', '{''.join(v.replace(chr(39), chr(39) * 2) for v in T.PLAIN_MARKS.values())}')"
_KEPT = r"[^\p{L}\p{N}\p{M}.,!?''\-、，。｡！？ ]"
_PLAIN_CLASS = "[" + _PLAIN + "]"
# a step each, so that no text is cleaned twice
PREPARED = rf"""i as (select *, {_I} i from documents where text is not null), q as (select *, {_Q.replace(_I, "i")} q from i),
    d as (select *, regexp_replace(regexp_replace(q, '{_GAP}', ' ', 'g'), '\p{{C}}', '', 'g') d from q), k as (select *, regexp_replace(d, '{_KEPT}', ' ', 'g') k from d),
    cleaned as (select *, regexp_replace(k, ' +([.,!?])', '\1', 'g') cleaned from k)"""
_N = {
    "footnotes": rf"len(regexp_extract_all(text, '{_BRACKET}')) + len(regexp_extract_all({_C0}, '{_RAISED}')) + len(regexp_extract_all({_C1}, '{_GLUED}'))",
    "initialisms": rf"len(regexp_extract_all({_C}, '{_DOTTED}'))",
    "quotes": rf"len(regexp_extract_all(i, '[{_DQ}]'))",
    "punctuation": rf"len(regexp_extract_all(i, '{_PLAIN_CLASS}'))",
    "whitespace": rf"len(regexp_extract_all(q, '{_GAP}')) - len(regexp_extract_all(q, ' ')) + (cleaned != k)::int",
    "controls": rf"len(regexp_extract_all(regexp_replace(q, '{_GAP}', ' ', 'g'), '\p{{C}}'))",
    "symbols": rf"len(regexp_extract_all(d, '{_KEPT}'))",
}
_COUNTS = ", ".join(f"cast({v} as bigint) {k}" for k, v in _N.items())

def _cleaned(spark, d):
    return T.clean_text(S.read(spark, d, "documents").filter("text is not null"))


@query(f"with {PREPARED} select doc_id, md5(cleaned) cleaned_md5, {_COUNTS} from cleaned")
def clean_chars(spark, d):
    n = [F.col(c).cast("long").alias(c) for c in T.CHANGES]
    return _cleaned(spark, d).select("doc_id", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"), *n)


def _norm_sql(x: str) -> str:
    out = _ws(f"(case when regexp_matches(left({x}, 1), '^\\p{{Ll}}$') then upper(left({x}, 1)) || substr({x}, 2) else {x} end)")
    for a, b in T.NORMAL_MARKS:
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    return f"list_transform([rtrim({out}, ' ')], lambda t: case when {x} = '' then '{T.NO_TEXT}' when regexp_matches(t, '[.!?\\-,、，。？！]$') then t else t || '.' end)[1]"


@query(f"""with {PREPARED}, c as (select lang batch, {_COUNTS}, cast({_norm_sql('cleaned')} != cleaned as bigint) normalization from cleaned), u as (unpivot c on {', '.join(_N)}, normalization into name category value n)
    select batch, category, cast(sum(n) as bigint) changes, cast(count_if(n > 0) as bigint) prompts from u where n > 0 group by batch, category""")
def cleanup_summary(spark, d):
    """Changes of each kind per batch; the counters are a map without zero entries."""
    rows = _cleaned(spark, d).withColumn("normalization", (T.punc_norm(F.col("cleaned")) != F.col("cleaned")).cast("long"))
    counts = F.map_filter(F.create_map(*[x for c in (*T.CHANGES, "normalization") for x in (F.lit(c), F.col(c).cast("long"))]), lambda k, v: v > 0)
    rows = rows.select(F.col("lang").alias("batch"), F.explode(counts).alias("category", "n"))
    return rows.groupBy("batch", "category").agg(F.sum("n").alias("changes"), F.count(F.lit(1)).alias("prompts"))


@query(f"select doc_id, md5({_norm_sql('text')}) normal_md5 from documents")
def punc_norm(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(T.punc_norm(F.col("text")).cast("binary")).alias("normal_md5"))


@query(f"with {PREPARED} select doc_id, md5('<' || lang || '>[START]' || {_norm_sql('cleaned')} || '[STOP]') prompt_md5, {_norm_sql('cleaned')} != cleaned normalized from cleaned")
def wrap_prompt(spark, d):
    """Prepared text (cleaned, then normalised) in the prompt's marks."""
    docs = _cleaned(spark, d).withColumn("n", T.punc_norm(F.col("cleaned")))
    return docs.select("doc_id", F.md5(F.concat(F.lit("<"), "lang", F.lit(">[START]"), "n", F.lit("[STOP]")).cast("binary")).alias("prompt_md5"), (F.col("n") != F.col("cleaned")).alias("normalized"))


_SRC = SENTENCES.replace("from documents where text is not null", "from src")


@query(f"""with src as (select distinct {_ws('text')} doc_id, {_ws('text')} "text" from conversations where text is not null), {_SRC},
    ends as (select src.doc_id t, case when len(ss) > 1 then list_transform(range(1, len(ss)), lambda i: {{'p': length(array_to_string(ss[1:i], ' ')), 'c': 1}})
        else list_transform(list_filter(range(2, length(src.doc_id)), lambda i: src.doc_id[i] = ' ' and contains(',;:—–', src.doc_id[i - 1])), lambda i: {{'p': i, 'c': 0}}) end places from src left join lists using (doc_id)),
    spaces as (select t, case when len(places) > 0 then places else list_transform(list_filter(range(1, length(t)), lambda i: t[i] = ' '), lambda i: {{'p': i - 1, 'c': 0}}) end places from ends),
    cuts as (select t, list_sort(list_transform(places, lambda x: {{'off': abs(2 * x.p + x.c - length(t)), 'p': x.p}}))[1].p p from spaces),
    parts as (select t, case when p is null then [t] else [trim(left(t, p)), trim(substr(t, p + 1))] end x from cuts)
    select conv_id, turn, cast(len(x) as bigint) n_parts, md5(array_to_string(x, chr(10))) parts_md5 from conversations join parts on t = {_ws('text')}""")
def recovery_split(spark, d):
    """Every turn cut in two balanced parts, as a text is whose speech failed."""
    c = S.read(spark, d, "conversations").filter("text is not null").withColumn("x", T.recovery_split(F.col("text")))
    return c.select("conv_id", "turn", F.size("x").cast("long").alias("n_parts"), F.md5(F.array_join("x", "\n").cast("binary")).alias("parts_md5"))


@query("""with c as (select doc_id, unnest(string_split(lower(text), '')) g from documents where text is not null), v as (select g, count(*) n from c where g != '' group by g),
    r as (select g, row_number() over (order by n desc, g) id from v)
    select doc_id, count(*) graphemes, cast(count_if(id is null or id > 30) as bigint) unknown from c left join r using (g) where g != '' group by doc_id""")
def vocab_coverage(spark, d):
    c = S.read(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split(F.lower("text"), "")).alias("g")).filter("g != ''")
    per_doc = c.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    top = per_doc.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(30).select("g", F.lit(True).alias("known"))
    return per_doc.join(top, "g", "left").groupBy("doc_id").agg(F.sum("n").alias("graphemes"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("unknown"))


@query("""with w as (select doc_id, n_chars n, greatest(1, 1 + cast(ceil((n_chars - 160) / 80.0) as bigint)) k from documents), p as (select doc_id, n, k, unnest(range(0, k)) i from w)
    select doc_id, i part, i * 80 start, least(n, i * 80 + 160) - i * 80 covered from p where i = 0 or (least(n, i * 80 + 160) - i * 80) / 160.0 >= 0.8""")
def partials(spark, d):
    """Overlapping windows of 160 frames; the last stays where it is covered by 80%."""
    docs = S.read(spark, d, "documents").withColumn("k", F.greatest(F.lit(1), 1 + F.ceil((F.col("n_chars") - 160) / 80)))
    p = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part")).withColumn("start", F.col("part") * 80)
    p = p.withColumn("covered", F.least("n_chars", F.col("start") + 160) - F.col("start"))
    return p.filter((F.col("part") == 0) | (F.col("covered") / 160 >= 0.8)).select("doc_id", "part", "start", "covered")


FLAGS = "flags as (select user_id clip, row_number() over (partition by user_id order by ts, event_id) - 1 frame_no, value >= 35 flag, value >= 15 support, value from events)"
SPANS = "spans as (select user_id clip, cast(epoch(date_trunc('second', ts)) as bigint) s, cast(epoch(date_trunc('second', ts)) as bigint) + cast(ceil(60 * value) as bigint) e from events)"
MERGED = "m1 as (select *, max(e) over (partition by clip order by s, e rows between unbounded preceding and 1 preceding) b from (select distinct * from spans) where e > s), m2 as (select *, sum(case when s <= b then 0 else 1 end) over (partition by clip order by s, e rows unbounded preceding) i from m1), merged as (select clip, min(s) s, max(e) e from m2 group by clip, i)"


@query(f"""with {FLAGS}, r as (select clip, frame_no, frame_no - row_number() over (partition by clip order by frame_no) i from flags where flag)
    select clip, min(frame_no) "start", max(frame_no) + 1 "end" from r group by clip, i having count(*) >= 2""")
def flag_runs(spark, d):
    return intervals.flag_runs(S.flags(spark, d), 2)


EXPANDED = f"""{FLAGS}, x as (select *, coalesce(max(case when not support then frame_no end) over (partition by clip order by frame_no rows between unbounded preceding and 1 preceding) + 1, 0) l,
    coalesce(min(case when not support then frame_no end) over (partition by clip order by frame_no desc rows between unbounded preceding and 1 preceding), count(*) over (partition by clip)) r,
    frame_no - sum(flag::int) over (partition by clip order by frame_no) i from flags),
    spans as (select clip, min_by(l, frame_no) s, max_by(r, frame_no) e from x where flag group by clip, i having count(*) >= 2), {MERGED}"""


@query(f'with {EXPANDED} select clip, s "start", e "end" from merged')
def run_expand(spark, d):
    return intervals.expand_runs(S.flags(spark, d), 2)


# spans of support in frames: some reach over the ends of their clip, and one clip in five has none
CLIPS = f"""{FLAGS}, clips as (select clip, count(*) n from flags group by clip), spans as (select clip, greatest(0, least(n, frame_no - 2)) s, greatest(0, least(n, frame_no + 1 + cast(floor(value) as bigint) % 4)) e
    from flags join clips using (clip) where flag and clip % 5 != 0), {MERGED}"""


def _clips(spark, d):
    f = S.flags(spark, d)
    around = f.filter((F.col("clip") % 5 != 0) & F.col("flag")).select("clip", (F.col("frame_no") - 2).alias("start"), (F.col("frame_no") + 1 + F.floor("value") % 4).alias("end"))
    return around, f.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))


@query(f'with {SPANS}, {MERGED} select clip, s "start", e "end" from merged')
def interval_merge(spark, d):
    return intervals.merge_intervals(S.spans(spark, d))


@query(f'with {CLIPS} select clip, s "start", e "end" from merged')
def interval_clamp(spark, d):
    """Intervals cut to their clips, then merged."""
    return intervals.merge_intervals(*_clips(spark, d))


@query(f"""with {CLIPS}, g as (select clip, e "start", lead(s) over (partition by clip order by s) "end" from merged)
    select * from g where "end" is not null union all select clip, 0, n from clips where clip not in (select clip from merged)""")
def interval_gaps(spark, d):
    """Gaps inside clips; clips without intervals are gaps as a whole."""
    around, clips = _clips(spark, d)
    return intervals.interval_gaps(intervals.merge_intervals(around, clips), clips)


@query(f"""with {EXPANDED}, g as (select clip, e a, lead(s) over (partition by clip order by s) b from merged), h as (select g.clip, a, b, round(sqrt(avg(value * value)), 6) rms from g join flags f on f.clip = g.clip and frame_no >= a and frame_no < b where b - a >= 2 group by all)
    select clip, a "start", b "end", rms from h where rms >= 5 - 1e-6""")
def loud_gaps(spark, d):
    frames = S.flags(spark, d)
    return intervals.loud_gaps(frames, intervals.interval_gaps(intervals.expand_runs(frames, 2)), 32, 2, 5.0)


@query(f"""with {EXPANDED}, q as (select clip, 'expanded' kind, s, e from merged) select clip, string_agg(printf('%s at %d-%d', kind, s, e), '; ' order by s, e) report from q group by clip""")
def issue_report(spark, d):
    i = intervals.expand_runs(S.flags(spark, d), 2).withColumn("kind", F.lit("expanded"))
    rows = i.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("x"))
    return rows.select("clip", F.array_join(F.transform("x", lambda x: F.format_string("%s at %d-%d", x["kind"], x["start"], x["end"])), "; ").alias("report"))


ENTRIES = f"""chunks as (select conv_id book, turn pos, turn // 2 chapter, 100 * coalesce(length(text), 0) samples from conversations),
    c as (select *, lag(chapter) over (partition by book order by pos) last from chunks),
    e0 as (select book, pos, chapter, last, 0 part, 'pause' kind, case when last is null then 0 when last != chapter then {round(0.9 * RATE)} else {round(0.18 * RATE)} end n from c union all select book, pos, chapter, last, 1, 'speech', samples from c),
    e1 as (select *, row_number() over w - 1 entry_no, sum(n) over w "end" from e0 where kind = 'speech' or n > 0 window w as (partition by book order by pos, part)),
    entries as (select book, entry_no, kind, chapter, cast(n as bigint) n, cast("end" - n as bigint) "start", cast("end" as bigint) "end", kind = 'speech' and (last is null or last != chapter) starts_chapter from e1)"""


@query(f"with {ENTRIES} select * from entries")
def timeline_entries(spark, d):
    return timeline.timeline(S.narration(spark, d), RATE)


QUERIES["timeline"], ORACLE_SQL["timeline"] = QUERIES.pop("timeline_entries"), ORACLE_SQL.pop("timeline_entries")
MARKERS = f"""{ENTRIES}, e2 as (select *, lag(kind) over (partition by book order by entry_no) bk, lag(n) over (partition by book order by entry_no) bn, max("end") over (partition by book) total from entries),
    m as (select book, "start" - case when bk = 'pause' then bn else 0 end f, total, entry_no from e2 where starts_chapter),
    markers as (select book, row_number() over w chapter_no, cast(round_even(f * 1000 / {RATE}, 0) as bigint) start_ms, cast(round_even(coalesce(lead(f) over w, total) * 1000 / {RATE}, 0) as bigint) end_ms from m window w as (partition by book order by entry_no))"""


@query(f"with {MARKERS} select * from markers")
def chapter_markers(spark, d):
    return timeline.chapter_markers(timeline.timeline(S.narration(spark, d), RATE), RATE)


@query(f"""with {MARKERS}, mk as (select book, chapter_no, (case when book % 5 = 0 and chapter_no = 2 then start_ms - 7 else start_ms end) / 1000 s, (case when book % 7 = 1 and chapter_no = 1 then end_ms + 5000 else end_ms end) / 1000 e from markers),
    b as (select book, max(end_ms) / 1000 - case when book % 11 = 0 then 0.002 else 0 end duration, max(end_ms) / 1000 + book % 4 expected, greatest(2.0, 0.1 * count(*)) tolerance, count(*) - case when book % 9 = 0 then 1 else 0 end n from markers group by 1),
    t as (select mk.*, duration, max(e) over (partition by book order by chapter_no rows between unbounded preceding and 1 preceding) le from mk join b using (book)),
    f as (select book, count(*) chapters, bool_and(s >= 0 and e > s and s >= coalesce(le, 0) and e <= duration + 0.001) ok from t group by 1)
    select book, chapters, array_to_string(list_filter([case when duration <= 0 then 'duration' end, case when abs(duration - expected) > tolerance then 'length' end, case when chapters != n then 'count' end, case when not ok then 'markers' end], lambda x: x is not null), ',') faults from b join f using (book)""")
def marker_topology(spark, d):
    """Books whose markers, length or number of chapters were tampered with, and the rules that they break."""
    m, book, no = chapter_markers(spark, d), F.col("book"), F.col("chapter_no")
    start = F.when((book % 5 == 0) & (no == 2), F.col("start_ms") - 7).otherwise(F.col("start_ms"))
    end = F.when((book % 7 == 1) & (no == 1), F.col("end_ms") + 5000).otherwise(F.col("end_ms"))
    whole = m.groupBy("book").agg((F.max("end_ms") / 1000).alias("whole"), F.count(F.lit(1)).alias("n"))
    books = whole.select("book", (F.col("whole") - F.when(book % 11 == 0, 0.002).otherwise(0.0)).alias("duration"), (F.col("whole") + book % 4).alias("expected"), timeline.expected_tolerance(F.col("n")).alias("tolerance"), (F.col("n") - F.when(book % 9 == 0, 1).otherwise(0)).alias("chapters_expected"))
    faults = timeline.marker_faults(m.select("book", "chapter_no", (start / 1000).alias("start"), (end / 1000).alias("end")), books)
    return faults.select("book", "chapters", F.array_join("faults", ",").alias("faults"))


@query(f"with {ENTRIES} select book, cast(round_even(max(\"end\") * 1000 / {RATE}, 0) as bigint) duration_ms from entries group by book")
def time_ms(spark, d):
    return timeline.timeline(S.narration(spark, d), RATE).groupBy("book").agg(timeline.round_ms(F.max("end"), RATE).alias("duration_ms"))


@query()
def balance_segments(spark, d):
    return timeline.balance_segments(timeline.timeline(S.narration(spark, d), RATE), 4)


@query(f"""with {ENTRIES}, all_ as (select book, "start" at_sample, kind from entries union all select book, "end", 'issue' from entries where n > 20000) select book, at_sample, kind, count(*) n from all_ group by all""")
def timeline_union(spark, d):
    e = timeline.timeline(S.narration(spark, d), RATE)
    rows = e.select("book", F.col("start").alias("at_sample"), "kind").unionByName(e.filter("n > 20000").select("book", F.col("end").alias("at_sample"), F.lit("issue").alias("kind")))
    return rows.groupBy("book", "at_sample", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with w as (select conv_id, turn, coalesce(length(text), 0) chars, sum(coalesce(length(text), 0)) over (partition by conv_id order by turn) done, sum(coalesce(length(text), 0)) over (partition by conv_id) total from conversations)
    select conv_id, turn, round(100.0 * done / {RATE} / greatest(0.5 * (turn + 1), 1e-9), 6) speed, case when done = 0 then 0.0 else round(0.5 * (turn + 1) * (total - done) / done, 6) end eta from w""")
def eta_curve(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    chars = F.coalesce(F.length("text"), F.lit(0))
    c = S.read(spark, d, "conversations").withColumns({"done": F.sum(chars).over(w), "total": F.sum(chars).over(Window.partitionBy("conv_id")), "elapsed": 0.5 * (F.col("turn") + 1)})
    eta = F.when(F.col("done") == 0, F.lit(0.0)).otherwise(F.round(F.col("elapsed") * (F.col("total") - F.col("done")) / F.col("done"), 6))
    return c.select("conv_id", "turn", F.round(100.0 * F.col("done") / RATE / F.greatest("elapsed", F.lit(1e-9)), 6).alias("speed"), eta.alias("eta"))


@query(rf"""with w as (select conv_id, turn, greatest(1, len(list_filter(string_split({_ws("coalesce(text, '')")}, ' '), lambda x: x != ''))) n, 0.05 * (turn * 37 % 400) s from conversations)
    select conv_id, turn, case when s < greatest(0.25, 0.04 * n) then 'truncated' when s > 15 + 5 * n then 'implausible' else 'ok' end verdict from w""")
def duration_plausible(spark, d):
    n = F.greatest(F.lit(1), F.size(F.filter(F.split(T.collapse_ws(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")))
    c = S.read(spark, d, "conversations").withColumns({"n": n, "s": 0.05 * (F.col("turn") * 37 % 400)})
    return c.select("conv_id", "turn", F.when(F.col("s") < F.greatest(F.lit(0.25), 0.04 * F.col("n")), "truncated").when(F.col("s") > 15 + 5 * F.col("n"), "implausible").otherwise("ok").alias("verdict"))


FILES = "files as (select l_orderkey project, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 idx, l_returnflag != 'R' valid, l_partkey size, l_shipdate mtime, l_linestatus = 'F' cached from lineitem)"
PREFIX = f"{FILES}, prefix as (select project, coalesce(min(case when not valid then idx end), count(*)) prefix, count(*) scheduled from files group by project)"


@query(f"with {PREFIX} select project, prefix, scheduled, case when prefix = scheduled then prefix else prefix // {BATCH} * {BATCH} end resume_at from prefix")
def durable_prefix(spark, d):
    return resume.resume_index(resume.durable_prefix(S.files(spark, d)), BATCH)


@query(f"with {FILES} select project, idx, size from files f where valid and not exists (select 1 from files c where c.cached and c.idx % 2 = 0 and c.project = f.project and c.idx = f.idx and c.size = f.size and c.mtime = f.mtime)")
def scan_work(spark, d):
    f = S.files(spark, d)
    return resume.scan_work(f, f.filter("cached and idx % 2 = 0").select("project", "idx", "size", "mtime")).select("project", "idx", "size")


_SCAN = f"""{PREFIX}, cache as (select project, idx, size + case when idx % 4 = 3 then 1 else 0 end size, mtime, 1 + project % 2 v from files where cached),
    work as (select f.project, f.idx, f.size, f.mtime from files f join prefix using (project) where f.idx < prefix and not exists (select 1 from cache c where c.v = 2 and c.project = f.project and c.idx = f.idx and c.size = f.size and c.mtime = f.mtime))"""


def _scan(spark, d):
    """Caches of two versions of the detector, some of their entries of another size."""
    f = S.files(spark, d)
    size = F.col("size") + F.when(F.col("idx") % 4 == 3, 1).otherwise(0)
    return resume.scan_plan(f, f.filter("cached").select("project", "idx", size.alias("size"), "mtime", (1 + F.col("project") % 2).alias("detector_version")), 2)


@query(f"with {_SCAN} select project, idx, size from work")
def scan_remainder(spark, d):
    """Files below the frontier that this version of the detector has not found clean."""
    return _scan(spark, d)[0].select("project", "idx", "size")


@query(f"""with {_SCAN}, t as (select project, count(*) n from work group by 1), st as (select project, count(*) n from cache join prefix using (project) where idx >= prefix group by 1)
    select project, cast(prefix as bigint) durable, coalesce(t.n, 0) to_scan, cast(prefix as bigint) - coalesce(t.n, 0) cached_skipped, coalesce(st.n, 0) stale from prefix left join t using (project) left join st using (project)""")
def scan_counts(spark, d):
    """How many files of each project are scanned, spared by the cache, and dropped from it."""
    return _scan(spark, d)[1]


@query(f"""with {FILES}, old as (select project, idx, true known, case when idx % 5 = 0 then null else size end size from files where cached),
    new as (select project, idx, true known, case when idx % 7 = 0 then null when idx % 3 = 0 then size + 1 else size end size from files where valid)
    select project, count(*) filter (ia is null) added, count(*) filter (ib is null) removed, count(*) filter (ia and ib and x is distinct from y) changed
    from (select coalesce(a.project, b.project) project, a.known ia, b.known ib, a.size x, b.size y from old a full join new b on a.project = b.project and a.idx = b.idx) group by 1 having added + removed + changed > 0""")
def cache_changes(spark, d):
    """Effective changes from one verified set to the next."""
    f = S.files(spark, d)
    size = F.when(F.col("idx") % 7 != 0, F.when(F.col("idx") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    old = f.filter("cached").select("project", "idx", F.when(F.col("idx") % 5 != 0, F.col("size")).alias("size"))
    return resume.cache_changes(old, f.filter("valid").select("project", "idx", size.alias("size")))


@query(f"""with {FILES}, t as (select project, idx, mtime + (idx % 3 - 1) * interval 1 day mtime from files where idx % 2 = 1), c as (select project, idx, mtime done from files where valid)
    select t.project, min(t.idx) cap from t left join c on t.project = c.project and t.idx = c.idx where done is null or done <= t.mtime group by t.project""")
def debris_guard(spark, d):
    f = S.files(spark, d)
    temps = f.filter("idx % 2 = 1").select("project", "idx", F.expr("mtime + make_dt_interval(cast(idx % 3 - 1 as int))").alias("mtime"))
    return resume.debris_guard(f, temps)


@query(f"""with {FILES}, old as (select project, idx, size from files where cached), touched as (select project, idx, size + 1 size, valid clean from files where idx % 3 = 0)
    select project, idx, size from old where not exists (select 1 from touched t where t.project = old.project and t.idx = old.idx) union all select project, idx, size from touched where clean""")
def cache_merge(spark, d):
    f = S.files(spark, d)
    return resume.cache_merge(f.filter("cached"), f.filter("idx % 3 = 0").select("project", "idx", (F.col("size") + 1).alias("size"), F.col("valid").alias("clean")))


@query(f"with {FILES} select project, lpad(cast(idx as varchar), 6, '0') file_key, size from files where valid and size > 0")
def cache_json(spark, d):
    """The verified files of a project as one JSON object with padded keys, and read back as rows."""
    f = S.files(spark, d).filter("valid and size > 0").groupBy("project").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lpad(F.col("idx").cast("string"), 6, "0").alias("k"), F.col("size").alias("v")))))).alias("j"))
    return f.select("project", F.explode(F.from_json("j", "map<string,bigint>")).alias("file_key", "size"))


@query("select c_custkey, o_orderkey from (select o_custkey c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders) where r = 1")
def latest_per_key(spark, d):
    return S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("select o_orderkey, coalesce(p.done, cast(o_orderkey % 5 as bigint)) completed from orders left join (select l_orderkey, count(*) done from lineitem where l_linestatus = 'F' group by 1) p on o_orderkey = l_orderkey")
def progress_override(spark, d):
    done = S.read(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("done"))
    return S.read(spark, d, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("done", F.col("o_orderkey") % 5).alias("completed"))


@query("""with l as (select l_orderkey k, count(*) n, count_if(l_linestatus = 'F') done from lineitem group by 1)
    select o_orderkey, o_orderpriority || ' (' || format('{:,}', done) || '/' || format('{:,}', n) || ')' as "label" from orders join l on k = o_orderkey where o_orderstatus != 'F' and done < n""")
def incomplete_projects(spark, d):
    n = S.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    o = S.read(spark, d, "orders").filter("o_orderstatus != 'F'").join(n, F.col("o_orderkey") == F.col("l_orderkey")).filter("done < n")
    return o.select("o_orderkey", F.concat("o_orderpriority", F.lit(" ("), F.format_number("done", 0), F.lit("/"), F.format_number("n", 0), F.lit(")")).alias("label"))


@query("select event_id, case when s < 60 then printf('%ds', s) when s < 3600 then printf('%dm %02ds', s // 60, s % 60) else printf('%dh %02dm', s // 3600, s // 60 % 60) end duration from (select event_id, greatest(0, cast(round_even(value * 20 - 500, 0) as bigint)) s from events)")
def format_duration(spark, d):
    return S.read(spark, d, "events").select("event_id", T.format_duration(F.col("value") * 20 - 500).alias("duration"))


@query("select event_id, round(20 * log10(value / 500 + 1e-12), 6) db, round(pow(10, (value / 10 - 50) / 20), 6) amplitude, round(greatest(0, least(1, value / 400)), 6) level from events")
def level_math(spark, d):
    v = F.col("value")
    return S.read(spark, d, "events").select("event_id", F.round(20 * F.log10(v / 500 + 1e-12), 6).alias("db"), F.round(F.pow(F.lit(10.0), (v / 10 - 50) / 20), 6).alias("amplitude"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 400)), 6).alias("level"))


_ALIAS = "(values ('click', 'model-a', 'Model A'), ('view', 'model-b', 'Model B'), ('', 'model-b', 'Model B'), ('error', 'model-c', null))"


@query(f"select event_id, id, coalesce(\"label\", id, 'unknown') as \"label\" from events left join {_ALIAS} a(alias, id, \"label\") on lower(trim(event_type)) = alias")
def resolve_alias(spark, d):
    dim = spark.sql(f"select * from values ('click', 'model-a', 'Model A'), ('view', 'model-b', 'Model B'), ('', 'model-b', 'Model B'), ('error', 'model-c', null) as a(alias, id, label)")
    return S.read(spark, d, "events").join(F.broadcast(dim), F.lower(F.trim("event_type")) == F.col("alias"), "left").select("event_id", "id", F.coalesce("label", "id", F.lit("unknown")).alias("label"))


_LAST = "last as (select user_id project, event_type state from (select *, row_number() over (partition by user_id, event_id % 20 order by ts desc, event_id desc) r from events) where r = 1)"


@query(f"with {_LAST} select project, cast(count_if(state in ('error', 'purchase')) as bigint) detected, cast(count_if(state = 'purchase') as bigint) fixed, cast(count_if(state = 'error') as bigint) retained from last group by project")
def project_quality(spark, d):
    e = S.read(spark, d, "events").groupBy(F.col("user_id").alias("project"), F.col("event_id") % 20).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return e.groupBy("project").agg(F.count_if(F.col("state").isin("error", "purchase")).alias("detected"), F.count_if(F.col("state") == "purchase").alias("fixed"), F.count_if(F.col("state") == "error").alias("retained"))


@query("select user_id, round(sum(least(value, 30 + event_id % 50)) / sum(value), 6) fraction from events group by user_id")
def assembly_progress(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.least("value", 30 + F.col("event_id") % 50)) / F.sum("value"), 6).alias("fraction"))


@query("select distinct user_id from events where event_type = 'purchase' except select user_id from events where event_type = 'error' and value > 450")
def fixed_minus_retained(spark, d):
    e = S.read(spark, d, "events")
    return e.filter("event_type = 'purchase'").select("user_id").subtract(e.filter("event_type = 'error' and value > 450").select("user_id"))


@query("with l as (select user_id, max_by(event_type, (ts, event_id)) state from events group by 1) select user_id, case when user_id % 10 = 0 then user_id * 2 when state in ('error', 'click') then user_id end picked from l")
def monitored_pick(spark, d):
    last = S.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.select("user_id", F.coalesce(F.when(F.col("user_id") % 10 == 0, F.col("user_id") * 2), F.when(F.col("state").isin("error", "click"), F.col("user_id"))).alias("picked"))


@query("select label, dim, round(m / sqrt(sum(m * m) over (partition by label)), 6) x from (select label, dim, avg(x) m from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 dim from embeddings) group by label, dim)")
def speaker_centroid(spark, d):
    return vectors.centroids(S.read(spark, d, "embeddings")).select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_EL = "e as (select vec_id, label, unnest(embedding)::double x, cast(generate_subscripts(embedding, 1) - 1 as bigint) dim from embeddings)"


@query(f"with {_EL}, c as (select label other, dim, avg(x) m from e group by 1, 2), s as (select vec_id, other, round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) similarity from e join c using (dim) group by 1, 2) select vec_id, other, similarity from (select *, row_number() over (partition by vec_id order by similarity desc, other) r from s) where r <= 1")
def voice_similarity(spark, d):
    v = S.read(spark, d, "embeddings")
    return vectors.voice_similarity(v, vectors.centroids(v), 1).drop("rank")


@query(f"with {_EL} select label, dim, round(avg(x), 6) mean, round(stddev_samp(x), 6) std from e group by 1, 2")
def stats_pool(spark, d):
    return vectors.stats_pool(S.read(spark, d, "embeddings")).withColumn("dim", F.col("dim").cast("long"))


@query(f"with {_EL} select vec_id, dim, round(avg(x) over w, 6) mean, round(max(x) over w, 6) max from e window w as (partition by vec_id, dim // 20)")
def segment_pool(spark, d):
    return vectors.segment_pool(S.read(spark, d, "embeddings"), 20).withColumn("dim", F.col("dim").cast("long"))


@query(f"with {_EL} select vec_id, dim, round(x - avg(x) over (partition by label, dim), 6) x from e")
def clip_mean_norm(spark, d):
    return vectors.mean_norm(S.read(spark, d, "embeddings")).withColumn("dim", F.col("dim").cast("long"))


_AMP = "f as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 frame_no, embedding from embeddings), a as (select vec_id, label, frame_no, list_transform(embedding, lambda x: x::double * case when (frame_no // 13) % 3 = label % 3 then 0.0001 else 1.0 end) v from f)"


@query(f"""with {_AMP}, c as (select vec_id, list_transform(v, lambda x: x - list_sum(v) / len(v)) c from a)
    select vec_id, round(20 * log10(sqrt(list_sum(list_transform(c, lambda x: x * x)) / len(c)) + 1e-12), 4) rms_dbfs, round(list_sum(list_transform(range(1, len(c)), lambda i: case when (c[i] < 0) != (c[i + 1] < 0) then 1.0 else 0.0 end)) / (len(c) - 1), 6) zcr from c""")
def frame_levels(spark, d):
    return vectors.frame_levels(S.frames(spark, d))


@query(f"""with {_AMP}, x0 as (select vec_id, unnest(v) x, generate_subscripts(v, 1) - 1 j from a), x as (select vec_id, j, x - avg(x) over (partition by vec_id) x from x0), b as (select j, k, (0.5 - 0.5 * cos(2 * pi() * j / 64)) h from range(64) t(j), range(33) u(k)),
    p0 as (select vec_id, k, pow(sum(x * h * cos(-2 * pi() * j * k / 64)), 2) + pow(sum(x * h * sin(-2 * pi() * j * k / 64)), 2) p from x join b using (j) group by 1, 2), p1 as (select vec_id, k, case when k = 0 then 0.0 else p end p from p0)
    select vec_id, max_by(k, p) dominant_bin, round(sum(k * p) / (sum(p) + 1e-30), 4) centroid, round(exp(avg(ln(p + 1e-30))) / (avg(p) + 1e-30), 6) flatness, round(sum(case when k <= 8 then p else 0 end) / (sum(p) + 1e-30), 6) low_share from p1 group by vec_id""")
def frame_spectrum(spark, d):
    return vectors.frame_spectrum(S.frames(spark, d), 64)


@query("""with v as (select vec_id, label, list_transform(embedding[1:40 + vec_id % 25], lambda x: x::double) v from embeddings), m as (select *, max(len(v)) over (partition by label) most from v)
    select vec_id, cast(most as bigint) n, cast(most - len(v) as bigint) n_padding, round(list_sum(v), 5) total from m""")
def pad_ragged(spark, d):
    cut = S.read(spark, d, "embeddings").select("label", "vec_id", F.transform(F.slice(F.col("embedding"), F.lit(1), (40 + F.col("vec_id") % 25).cast("int")), lambda x: x.cast("double")).alias("v"))
    p = vectors.pad_ragged(cut)
    return p.select("vec_id", F.size("v").cast("long").alias("n"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_padding"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""with t as (select vec_id, list_transform(embedding, lambda x: cast(floor(abs(x::double) * 40) as int)) t from embeddings), p as (select vec_id, t, coalesce(list_position(t, 3), 0) a, coalesce(list_position(t, 4), 0) b from t)
    select vec_id, array_to_string(list_filter(t[a + 1:case when b > 0 then b - 1 else least(len(t), 1001) end], lambda x: x < 8), ',') tokens from p""")
def trim_tokens(spark, d):
    t = S.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int")).alias("t"))
    return t.select("vec_id", F.array_join(F.transform(vectors.trim_tokens(F.col("t"), 3, 4, 8), lambda x: x.cast("string")), ",").alias("tokens"))
