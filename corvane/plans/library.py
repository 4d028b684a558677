"""Queries over a library of files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import context, evidence, identify, paths, scoring, titles
from corvane.operators import dedup, linking, planning, vectors
from corvane.session import table
from corvane.sources import files

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The items with some of their columns, repeated deliveries once."""
    return table(spark, sf_dir, "media_item").select(*(columns or ["*"])).distinct()


_ITEM = "with item as (select distinct * from media_item)\n"


# -- sources -------------------------------------------------------------------------------------


@query(
    """with f as (select distinct id, path, file_size, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) ext, string_split(path, '/') parts from media_item),
g as (select *, regexp_replace(parts[-1], '\\.[^.]*$', '') stem from f)
select id, ext, case when ext in ('mp4','mkv','avi','ts','m2ts','mts','mov','wmv','flv','webm') then 'Movie' when ext in ('mp3','flac','ape','aac','ogg','wma','wav','m4a','dsf') then 'Music'
  when ext in ('epub','pdf','mobi','azw3','txt','cbz') then 'Novel' when ext = 'strm' then 'Strm' end kind
from g where file_size >= 1048576 and len(parts) - 1 <= 10
  and not list_has_any(parts[:-2], ['.git','.DS_Store','Thumbs.db','__MACOSX','Library','.Trash','.cache','.npm','.cargo','.rustup','node_modules','BDMV','CERTIFICATE','STREAM','PLAYLIST','CLIPINF','AUXDATA','BACKUP','META'])
  and not (path like '%/BDMV/%' or path like '%/CERTIFICATE/%' or path like '%/SAMPLE/%' or path like '%/sample/%' or path like '%/Trailer/%' or path like '%/trailers/%')
  and not (ext in ('m2ts','mts','ts') and regexp_full_match(stem, '[0-9]+'))
  and ext in ('mp4','mkv','avi','ts','m2ts','mts','mov','wmv','flv','webm','mp3','flac','ape','aac','ogg','wma','wav','m4a','dsf','epub','pdf','mobi','azw3','txt','cbz','strm')"""
)
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan takes up, with their kind."""
    listed = items(spark, sf_dir, "id", "path", "file_size").withColumnRenamed("file_size", "length")
    return files.select_media(listed).select("id", "ext", "kind")


@query(
    """select doc_id, nullif(trim(regexp_extract(text, '<title>([^<]*)</title>', 1)), '') title, try_cast(nullif(regexp_extract(text, '<year>\\s*([0-9]{4})', 1), '') as int) "year",
  length(regexp_extract(text, '(?s)<plot>(.*?)</plot>', 1)) plot_chars from documents where text like '%<movie>%'"""
)
def sidecar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of metadata files among the documents."""
    docs = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("<movie>")))
    return docs.select("doc_id", *[c.alias(n) for n, c in files.sidecar_fields(F.col("text")).items()])


# -- names ---------------------------------------------------------------------------------------

_NAMES = r"""
, named as (select id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') stem from item where path is not null),
cleaned as (select id, trim(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)ColorTV|WEBDL', ' ', 'g'), '(?i)HDS|FRDS|BeAst|HDCTV|OurTV|AoE|字幕侠|片源网|人人影视|射手网', ' ', 'g'), '\s+', ' ', 'g')) c from named),
grp as (select *, case when regexp_matches(c, '(?i)\bWEB-DL$') then null else nullif(regexp_extract(c, '-([A-Za-z0-9]+)$', 1), '') end release_group from cleaned),
body as (select *, case when release_group is null then c else regexp_replace(c, '-[A-Za-z0-9]+$', '') end b from grp),
tags as (select *,
  upper(nullif(regexp_extract(b, '(?i)\b(1080[pi]|2160[pi]|720[pi]|4[UK])\b', 1), '')) resolution,
  nullif(regexp_extract(b, '(?i)\b(WEB-?DL|BluRay|Remux|HDTV|CAM|WEBRip|BDRip|BRRip)\b', 1), '') source,
  replace(upper(nullif(regexp_extract(b, '(?i)\b(H\.?26[45]|HEVC|AV1|x26[45]|x264)\b', 1), '')), 'HEVC', 'H.265') codec,
  nullif(regexp_extract(b, '(?i)\b(AAC|FLAC|DTS|Atmos|DD5\.?1)\b', 1), '') audio,
  case when try_cast(regexp_extract(c, '(?:^|[.\s_\-\[\(])(\d{4})(?:$|[.\s_\-\]\)])', 1) as int) between 1900 and 2030 then regexp_extract(c, '(?:^|[.\s_\-\[\(])(\d{4})(?:$|[.\s_\-\]\)])', 1)::int end y,
  case when try_cast(regexp_extract(c, '(?i)(.+?)[.\s_-]+(\d{4})', 2) as int) between 1900 and 2030 then regexp_extract(c, '(?i)(.+?)[.\s_-]+(\d{4})', 2)::int end my
  from body),
formed as (select *, case
  when regexp_matches(c, '(?i)(.+?)[.\s_-]+S(\d{1,2})\s*E(\d{1,3})') then 'sxxexx' when regexp_matches(c, '(?i)(.+?)[.\s_-]+(\d{1,2})x(\d{1,3})') then 'nxnn'
  when regexp_matches(c, '(?i).*\[([^\[\]]+?)\s*第(\d{1,2})季\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)') then 'bracket_zh'
  when regexp_matches(c, '(?i).*\[([^\[\]]+?)\s+(\d{1,2})(?:st|nd|rd|th)\s+Season\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)') then 'bracket_en'
  when my is not null then 'movie' else 'fallback' end form,
  nullif(concat_ws('.', resolution, source, codec, audio, release_group), '') suffix from tags),
parts as (select *, case form when 'sxxexx' then regexp_extract(c, '(?i)(.+?)[.\s_-]+S(\d{1,2})\s*E(\d{1,3})', ['t', 's', 'e']) when 'nxnn' then regexp_extract(c, '(?i)(.+?)[.\s_-]+(\d{1,2})x(\d{1,3})', ['t', 's', 'e'])
  when 'bracket_zh' then regexp_extract(c, '(?i).*\[([^\[\]]+?)\s*第(\d{1,2})季\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)', ['t', 's', 'e']) when 'bracket_en' then regexp_extract(c, '(?i).*\[([^\[\]]+?)\s+(\d{1,2})(?:st|nd|rd|th)\s+Season\].*?\[(\d{1,3})\](?:[.\[\s_-]|$)', ['t', 's', 'e']) end got from formed)
select id, case when got is not null then regexp_replace(regexp_replace(trim(got.t), '[.\-_ ]+$', ''), '\s+', ' ', 'g')
    when form = 'movie' then regexp_replace(regexp_replace(trim(regexp_extract(c, '(?i)(.+?)[.\s_-]+(\d{4})', 1)), '[.\-_ ]+$', ''), '\s+', ' ', 'g')
    else trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\b(1080[pi]|2160[pi]|720[pi]|4[UK])\b', ' ', 'g'), '(?i)\b(H\.?26[45]|HEVC|AV1|x26[45]|x264)\b', ' ', 'g'),
      '(?i)\b(WEB-?DL|BluRay|Remux|HDTV|CAM|WEBRip|BDRip|BRRip)\b', ' ', 'g'), '(?i)\b(AAC|FLAC|DTS|Atmos|DD5\.?1)\b', ' ', 'g'), '-[A-Za-z0-9]+$', ' '), '\s+', ' ', 'g')) end raw_title,
  case when form = 'movie' then my else y end "year",
  got.s::int season, got.e::int episode,
  resolution, codec, source, release_group, case when form = 'movie' and trim(regexp_extract(c, '(?i)(.+?)[.\s_-]+(\d{4})(.*)$', 3)) = '' then null else suffix end media_suffix, form,
  case form when 'sxxexx' then 0.96 when 'nxnn' then 0.95 when 'movie' then 0.92 when 'fallback' then 0.55 else 0.97 end::float confidence
from parts"""


@query(_ITEM + _NAMES)
def identify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file names say: title, year, season, episode, tags, and the form of the name."""
    rows = items(spark, sf_dir, "id", "path").filter("path is not null")
    return rows.select("id", identify.identify(paths.stem(F.col("path"))).alias("p")).select("id", "p.*")


_BRACKETS = r""", told as (select id, replace(replace(parsed.raw_title, '[', ''), ']', '') t, parsed.season s, parsed.episode e from item where parsed.raw_title is not null and parsed.season is not null and parsed.episode is not null),
named as (select 'zh:' || id id, '[Sub][' || t || ' 第' || s || '季][' || lpad(e::varchar, greatest(2, length(e::varchar))::int, '0') || '][1080p]' stem from told union all select 'en:' || id, '[Sub] [' || t || ' ' || s || 'th Season][' || e || '].1080p.x264-GRP' from told),
"""


@query(_ITEM + _BRACKETS + _NAMES.split("\n", 2)[2])
def bracket_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names in brackets say, made of the titles, seasons and episodes of the items."""
    p = F.col("parsed")
    told = items(spark, sf_dir, "id", F.translate(p["raw_title"], "[]", "").alias("t"), p["season"].alias("s"), p["episode"].alias("e")).filter("t is not null and s is not null and e is not null")
    zh = F.concat(F.lit("[Sub]["), "t", F.lit(" 第"), F.col("s").cast("string"), F.lit("季]["), F.format_string("%02d", "e"), F.lit("][1080p]"))
    en = F.concat(F.lit("[Sub] ["), "t", F.lit(" "), F.col("s").cast("string"), F.lit("th Season]["), F.col("e").cast("string"), F.lit("].1080p.x264-GRP"))
    names = told.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")).alias("id"), x.alias("n")) for k, x in (("zh", zh), ("en", en))])).alias("r")).select("r.*")
    return names.select("id", identify.identify(F.col("n")).alias("p")).select("id", "p.*")


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '(?i)[\s._-]*(?:[\(\[]?\d{{4}}[\)\]]?)?(?:[\s._-]+(?:4k|2160p|1080p|720p|hdr|dv|dovi|高码|低码|web-?dl|bluray|remux|h265|x265|x264|aac|dts|atmos))+\s*$', ''), '\s*[\(\[](\d{{4}})[\)\]]\s*$', ''), '(?i)\s+\d+(?:-\d+)?季(?:全集)?(?:\(\d+\))?\s*$', ''), '[._]+', ' ', 'g'), '\s+', ' ', 'g'))"
_NOISY = r"({0} like '202%' or regexp_matches({0}, '(?i)^[\d\s\.\-_\(\)]*(?:hq|hdr|dv|dovi|web-?dl|bluray|remux|x26[45]|h\.?26[45]|aac|dts|atmos|2160p|1080p|720p)+[\d\s\.\-_\(\)]*$') or (regexp_matches({0}, '^[\x00-\x7f]*$') and length(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')) <= 3))"
_NAMED = r"not ({0} like '.%') and not regexp_matches(trim({0}), '(?i)^(?:season\s*\d{{1,2}}|s\d{{1,2}}|e\d{{1,3}}|ep?\d{{1,3}}|complete|\d{{4}}|\d{{1,3}})$')"


def _plain_sql(x: str) -> str:
    text = _PLAIN.format(x)
    return f"case when {_NAMED.format(x)} and {text} <> '' and not {_NOISY.format(text)} then {text} end"


@query(
    _ITEM
    + rf""", f as (select id, coalesce(parsed.raw_title, '') t, coalesce(parsed.confidence, 0::float) conf, parsed.year y, parsed.season s, parsed.episode e, list_reverse(list_filter(string_split(path, '/')[:-2], lambda x: x <> '')) d from item where parsed is not null and path is not null),
m as (select *, e is null and regexp_matches(trim(t), '(?i)^S(\d{{1,2}})E(\d{{1,3}})(?:[\s._-].*|\s*\(\d+\))?$') both_, e is null and regexp_matches(trim(t), '(?i)^(?:E|EP)?(\d{{1,3}})(?:[\s._-].*|\s*\(\d+\))?$') alone from f),
n as (select *, case when both_ then coalesce(s, regexp_extract(trim(t), '(?i)^S(\d{{1,2}})E', 1)::int) else s end s1,
  case when both_ then regexp_extract(trim(t), '(?i)^S\d{{1,2}}E(\d{{1,3}})', 1)::int when alone then regexp_extract(trim(t), '(?i)^(?:E|EP)?(\d{{1,3}})', 1)::int else e end e1, coalesce({_plain_sql("t")}, t) t1 from m),
up as (select id, unnest(d[:3]) dir, unnest(range(len(d[:3]))) lvl from n),
found as (select id, arg_min(try_cast(coalesce(nullif(regexp_extract(dir, '(?i)Season\s*(\d{{1,2}})', 1), ''), nullif(regexp_extract(dir, '(?i)S(\d{{1,2}})\s*$', 1), '')) as int), lvl) filter (coalesce(nullif(regexp_extract(dir, '(?i)Season\s*(\d{{1,2}})', 1), ''), nullif(regexp_extract(dir, '(?i)S(\d{{1,2}})\s*$', 1), '')) is not null) fs,
  arg_min(try_cast(regexp_extract(dir, '[\[(\s](\d{{4}})[\])\s]', 1) as int), lvl) filter (try_cast(regexp_extract(dir, '[\[(\s](\d{{4}})[\])\s]', 1) as int) between 1900 and 2030) fy,
  arg_min({_plain_sql("dir")}, lvl) filter (lvl < 2 and {_plain_sql("dir")} is not null) ft from up group by id)
select id, case when (trim(t1) = '' or regexp_matches(trim(t1), '(?i)^(?:(?:s\d{{1,2}}(?:e\d{{1,3}})?|e\d{{1,3}}|ep?\d{{1,3}}|\d{{1,3}})(?:\s*\(\d+\))?|(?:s\d{{1,2}}e\d{{1,3}}|e\d{{1,3}}|ep?\d{{1,3}})(?:[\s._-]+.*)?|s\d{{1,2}}e\d.*)$') or {_NOISY.format("trim(t1)")}) then coalesce(ft, t1) else t1 end raw_title,
  coalesce(y, fy) "year", coalesce(s1, fs) season, e1 episode,
  round(greatest(conf, case when s1 is distinct from s or e1 is distinct from e then 0.72::float else 0 end, case when s1 is null and fs is not null then 0.84::float else 0 end, case when y is null and fy is not null then 0.80::float else 0 end,
    case when (trim(t1) = '' or regexp_matches(trim(t1), '(?i)^(?:(?:s\d{{1,2}}(?:e\d{{1,3}})?|e\d{{1,3}}|ep?\d{{1,3}}|\d{{1,3}})(?:\s*\(\d+\))?|(?:s\d{{1,2}}e\d{{1,3}}|e\d{{1,3}}|ep?\d{{1,3}})(?:[\s._-]+.*)?|s\d{{1,2}}e\d.*)$') or {_NOISY.format("trim(t1)")}) and ft is not null then 0.76::float else 0 end)::double, 6) confidence from n left join found using (id)"""
)
def infer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, years and seasons that names lack, from the folders above."""
    rows = items(spark, sf_dir, "id", "path", F.col("parsed")).filter("parsed is not null and path is not null")
    p = F.col("parsed")
    known = context.infer(F.coalesce(p["raw_title"], F.lit("")), p["year"], p["season"], p["episode"], F.coalesce(p["confidence"], F.lit(0).cast("float")), paths.ancestors(F.col("path"), 3))
    return rows.select("id", known.alias("c")).select("id", "c.raw_title", "c.year", "c.season", "c.episode", F.round(F.col("c.confidence").cast("double"), 6).alias("confidence"))


@query(
    _ITEM
    + r""", q as (select id, trim(parsed.raw_title) t, trim(replace(replace(replace(trim(parsed.raw_title), '.', ' '), '_', ' '), '  ', ' ')) f from item where trim(parsed.raw_title) <> ''),
w as (select *, list_filter(string_split_regex(f, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') ws from q),
n as (select *, list_filter(ws, lambda x: lower(x) not in ('1080p','720p','2160p','4k','webrip','web-dl','bluray','brrip','x264','x265','h264','h265','hevc','aac','dts','hdr','dv')) nw from w),
b as (select *, array_to_string(nw, ' ') bare, array_to_string(list_filter(nw, lambda x: not regexp_matches(x, '^(19|20)[0-9]{2}$') and not regexp_matches(lower(x), '^s[0-9]{2}e[0-9]{2}$')), ' ') idf from n),
v as (select id, unnest([t, f, bare, trim(replace(replace(replace(bare, '.', ' '), '_', ' '), '  ', ' ')), idf, trim(replace(replace(replace(idf, '.', ' '), '_', ' '), '  ', ' '))]) x, unnest(range(6)) pos from b),
u as (select id, trim(x) x, pos from v where trim(x) <> ''),
d as (select *, row_number() over (partition by id, lower(x) order by pos) r from u)
select id, x variant, row_number() over (partition by id order by pos) pos from d where r = 1"""
)
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms under which each item's title is looked up, in their order."""
    rows = items(spark, sf_dir, "id", F.col("parsed.raw_title").alias("t"))
    return rows.select("id", F.posexplode(titles.variants(F.col("t"))).alias("p", "variant")).select("id", "variant", (F.col("p") + 1).cast("bigint").alias("pos"))


@query(
    _ITEM
    + r""", q as (select id, trim(replace(replace(replace(parsed.raw_title, '.', ' '), '_', ' '), '  ', ' ')) t from item where media_type = 'Music' and parsed.raw_title is not null),
d as (select id, t, unnest([' - ', ' – ', ' — ']) d, unnest([0, 1, 2]) p from q),
c as (select id, p, trim(t[:instr(t, d) - 1]) artist, trim(t[instr(t, d) + 3:]) title from d where instr(t, d) > 0),
k as (select id, (row_number() over (partition by id order by p) - 1)::int pos, artist, title from c where artist <> '' and title <> ''),
w as (select id, t, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') ws from q where id not in (select id from k))
select * from k union all select id, 0, case when len(ws) >= 2 then ws[1] else t end, case when len(ws) >= 2 then array_to_string(ws[2:], ' ') else t end from w"""
)
def music_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists and titles under which music items are looked up."""
    rows = items(spark, sf_dir, "id", "media_type", F.col("parsed.raw_title").alias("t")).filter("media_type = 'Music' and t is not null")
    return rows.select("id", F.posexplode(titles.artist_and_title(F.col("t"))).alias("pos", "q")).select("id", "pos", "q.artist", "q.title")


_QF = "trim(replace(replace(replace({0}, '.', ' '), '_', ' '), '  ', ' '))"


@query(
    _ITEM
    + rf""", hint as (select id, 10000 + j o, h from (select id, j, {_QF.format("d")} h from (select id, unnest(list_reverse(list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda x: x <> ''))[:4]) d, unnest(range(4)) j from item) where d is not null) where h <> '' and not regexp_full_match(lower(h), 'season 0?[12]|s0?[12]|s[0-9]{{0,5}}')),
src as (select id, 0 o, trim(parsed.raw_title) t from item union all select id, 100 + i, trim(x) from (select id, unnest(content_evidence.title_candidates) x, unnest(range(len(content_evidence.title_candidates))) i from item) union all select id, o, trim(h) from (select *, row_number() over (partition by id, lower(h) order by o) k from hint) where k = 1),
q as (select *, {_QF.format("t")} f from src where t <> ''), w as (select *, list_filter(string_split_regex(f, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') ws from q),
nw as (select *, list_filter(ws, lambda x: lower(x) not in ('1080p','720p','2160p','4k','webrip','web-dl','bluray','brrip','x264','x265','h264','h265','hevc','aac','dts','hdr','dv')) nws from w),
b as (select *, array_to_string(nws, ' ') bare, array_to_string(list_filter(nws, lambda x: not regexp_matches(x, '^(19|20)[0-9]{{2}}$') and not regexp_matches(lower(x), '^s[0-9]{{2}}e[0-9]{{2}}$')), ' ') idf from nw),
v as (select id, o, unnest([t, f, bare, {_QF.format("bare")}, idf, {_QF.format("idf")}]) x, unnest(range(6)) k from b), u as (select id, o, k, trim(x) x from v where trim(x) <> ''),
d as (select *, row_number() over (partition by id, lower(x) order by o, k) r from u)
select id, (row_number() over (partition by id order by o, k) - 1)::int pos, x form from d where r = 1"""
)
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms to look each item up by: of its title, of titles seen in its content, and of its folders."""
    plan = titles.query_plan(F.col("parsed.raw_title"), F.col("content_evidence.title_candidates"), paths.ancestors(F.col("path"), 4))
    return items(spark, sf_dir, "id", plan.alias("forms")).select("id", F.posexplode("forms").alias("pos", "form"))


# -- scores --------------------------------------------------------------------------------------

_SCORES = """select id, h * 0.4::double + v * 0.3::double + r * 0.2::double + a * 0.1::double score,
  case when q.height is null then 'unknown' when q.height >= 2160 then '4K' when q.height >= 1080 then '1080p' when q.height >= 720 then '720p' when q.height >= 480 then '480p' else q.height || 'p' end label
from (select id, quality q, case when quality.height is null then 50 when quality.height >= 2160 then 100 when quality.height >= 1080 then 80 when quality.height >= 720 then 60 else 40 end h,
  case quality.video_codec when 'AV1' then 95 when 'H.265' then 90 when 'HEVC' then 90 when 'H.264' then 70 else 50 end v,
  case when quality.video_bitrate is null then 50 else least(100, quality.video_bitrate::double / 50e6::double * 100) end r,
  case quality.audio_codec when 'DTS' then 95 when 'Atmos' then 95 when 'FLAC' then 90 when 'AAC' then 65 else 50 end a from item where quality is not null)"""


@query(_ITEM + f"select id, round(score, 6) score, label from ({_SCORES})")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The technical quality of each probed item, and the label of its resolution."""
    q = F.col("quality")
    rows = items(spark, sf_dir, "id", "quality").filter("quality is not null")
    return rows.select("id", F.round(scoring.quality_score(q["height"], q["video_codec"], q["video_bitrate"], q["audio_codec"]), 6).alias("score"), scoring.resolution_label(q["height"]).alias("label"))


_TRUST = """, t as (select id, media_type, path, file_size, parsed p, scraped s, quality, content_evidence ce, hash, identity_resolution.confirmation_state st, least(greatest(parsed.confidence, 0::float), 1::float) pt,
  (scraped.confidence + case scraped.source when 'LocalNfo' then 0.08 when 'Tmdb' then 0.06 when 'MusicBrainz' then 0.06 when 'OpenLibrary' then 0.06 when 'AiAssist' then -0.05 when 'Guess' then -0.12 else 0 end::float)::float sc from item),
t2 as (select *, case when s.confidence is null then null else least(greatest((least(greatest(sc, 0::float), 1::float) + case st when 'Confirmed' then 0.18 when 'HighConfidenceCandidate' then 0.10 when 'AmbiguousCandidates' then -0.08 when 'InsufficientEvidence' then -0.14 else 0 end::float)::float, 0::float), 1::float) end stt from t),
t3 as (select *, coalesce(stt, 0::float) >= 0.72::float and (coalesce(stt, 0::float) + 0.03::float)::float >= coalesce(pt, 0::float) trusted, case when trim(p.raw_title) <> '' then p.raw_title end ptitle, case when trim(s.title) <> '' then s.title end stitle from t2),
pref as (select *, ptitle is not null or stitle is not null has_title, case when ptitle is null or (stitle is not null and trusted) then stitle else ptitle end title,
  case when ptitle is null and stitle is null then null when ptitle is null or (stitle is not null and trusted) then 'Scraped' else 'Parsed' end origin,
  case when p.year is null or (s.year is not null and trusted) then s.year else p.year end y, case when p.season is null or (s.season_number is not null and trusted) then s.season_number else p.season end sn,
  case when p.episode is null or (s.episode_number is not null and trusted) then s.episode_number else p.episode end ep from t3)
"""


@query(_ITEM + _TRUST + 'select id, title, origin, y "year", sn season, ep episode from pref')
def preferred_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the title, year, season and episode to trust, looked up or parsed, and where the title is from."""
    rated = dedup.judged(table(spark, sf_dir, "media_item"), scored=False)
    return rated.select("id", "title", "origin", "year", "season", "episode")


# -- duplicates ----------------------------------------------------------------------------------


@query(_ITEM + "select hash.full_hash digest, count(*) n, min(id) first, max(id) last from item where hash.full_hash is not null group by 1 having count(*) > 1")
def exact_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with equal content."""
    return dedup.exact_groups(items(spark, sf_dir, "id", "hash"), F.col("hash.full_hash"))


_DEPTHS = """with s as (select doc_id, text, strlen(text) size from documents), a as (select *, count(*) over (partition by size) n from s),
b as (select *, case when size is not null and n > 1 then md5(encode(text)[1:65536]) end h from a)
select doc_id, size, h is not null has_prefix_hash, h is not null and count(*) over (partition by size, h) > 1 has_full_hash from b"""


@query(_DEPTHS)
def progressive_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document had to be hashed to tell it from the others."""
    hashed = dedup.progressive_hash(table(spark, sf_dir, "documents"), "doc_id", "text")
    return hashed.select(F.col("key").alias("doc_id"), "size", F.col("prefix_hash").isNotNull().alias("has_prefix_hash"), F.col("full_hash").isNotNull().alias("has_full_hash"))


@query(_DEPTHS)
def progressive_hash_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its former name, by which longer texts were asked for."""
    return progressive_hashes(spark, sf_dir)


@query("select md5(text) digest, count(*) n, min(doc_id) first, max(doc_id) last from documents where text is not null group by 1 having count(*) > 1")
def exact_document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal text, by progressive hashes."""
    hashed = dedup.progressive_hash(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "id")
    return dedup.exact_groups(hashed, F.col("full_hash"))


_CLUSTER = """select dir, count_if(v) >= 3 and count_if(v and epi) >= 2 cluster from (
  select regexp_replace(path, '/?[^/]*$', '') dir, ext in ('mkv','mp4','avi','mov','m4v','ts','m2ts','wmv','webm') v,
    regexp_matches(upper(stem), 'S01E|S02E|S03E|S04E|EP') or regexp_matches(trim(stem), '^[0-9]{1,3}$') epi
  from (select path, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) ext, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') stem from item)) group by dir"""


@query(_ITEM + _CLUSTER)
def folder_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each folder holds a run of episodes."""
    return dedup.folder_clusters(items(spark, sf_dir, "id", "path"))


_KEYS = (
    _TRUST
    + f""", cl as ({_CLUSTER}),
pv as (select pref.*, case st when 'Confirmed' then 1.0 when 'HighConfidenceCandidate' then 0.82 when 'AmbiguousCandidates' then 0.42 when 'InsufficientEvidence' then 0.18 else 0 end::float trust,
  case when media_type is null or media_type not in ('TvShow', 'Strm') then 'feature' when regexp_matches(lower(path), '/extras/|/featurettes/|/behind the scenes/|/specials/|特别篇|花絮') then 'extras' when cl.cluster then 'season_cluster'
    when regexp_matches(lower(path), '/season |/s01|/s02|/s03|/s04|/s1/|/s2/') then 'season' else 'loose' end pv,
  's' || 'x' dummy from pref left join cl on cl.dir = regexp_replace(path, '/?[^/]*$', '')),
keyed as (select *, 'S' || lpad(coalesce(sn, 0)::varchar, greatest(2, length(coalesce(sn, 0)::varchar))::int, '0') || 'E' || lpad(coalesce(ep, 0)::varchar, greatest(2, length(coalesce(ep, 0)::varchar))::int, '0') epi from pv),
k as (select *, coalesce(case when trust >= 0.82::float then case when s.tmdb_id is not null then case when media_type in ('TvShow', 'Strm') then 'tmdb:tv:' || s.tmdb_id || ':' || epi || ':' || pv else 'tmdb:movie:' || s.tmdb_id || ':' || coalesce(s.year, y, 0) end
    when s.musicbrainz_id is not null then 'musicbrainz:' || s.musicbrainz_id when s.openlibrary_id is not null then 'openlibrary:' || s.openlibrary_id end end,
  'fallback:' || title || '|' || coalesce(y, 0) || '|' || epi || ':' || pv) version_key from keyed)
"""
)


@query(_ITEM + _KEYS + "select id, version_key, pv provenance from k")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that the versions of one work share, and where each item stands."""
    return dedup.judged(table(spark, sf_dir, "media_item")).select("id", "version_key", "provenance")


@query(
    _ITEM
    + _KEYS
    + "select version_key, count(*) n from k where version_key is not null group by version_key having count(*) > 1 and not (count(hash.full_hash) = count(*) and min(hash.full_hash) = max(hash.full_hash))"
)
def version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of which there are several versions."""
    return dedup.version_groups(dedup.judged(table(spark, sf_dir, "media_item"))).select("version_key", "n")


def _suffix_sql(x: str) -> str:
    points = [("hdr", 0.28), ("dv|dovi|dolby vision", 0.3), ("remux", 0.36), ("atmos", 0.2), ("truehd|dts-hd", 0.16)]
    return " + ".join(f"case when regexp_matches(lower(coalesce({x}, '')), '{words}') then {n}::double else 0 end" for words, n in points)


def _release_sql(x: str) -> str:
    tiers = [("remux|uhd blu|ultra hd blu", 0.48), ("bluray|blu-ray|bdrip", 0.24), ("web-dl|webdl", 0.12), ("webrip", 0.06), ("hdtv", -0.04), ("cam|ts|tc", -0.45)]
    return "case " + " ".join(f"when regexp_matches(lower(coalesce({x}, '')), '{words}') then {n}::double" for words, n in tiers) + " else 0 end"


_SUBS, _TRACKS = "coalesce(ce.subtitles, [])", "coalesce(ce.container.track_titles, [])"
_FORCED = "(contains(lower(coalesce({0}, '')), 'forced') and not contains(lower(coalesce({0}, '')), 'full'))"
_COMMENT = "contains(lower(coalesce({0}, '')), 'commentary')"
_OWN = f"len(list_filter({_TRACKS}, lambda t: not {_COMMENT.format('t')}))"
_FULL = f"len(list_filter({_SUBS}, lambda t: not {_FORCED.format('t.track_title')} and not {_COMMENT.format('t.track_title')}))"
_EFFECTIVE = (
    _KEYS
    + f""", sc as (select *, coalesce(quality.quality_score, 0) q, coalesce(case when has_title then case when origin = 'Scraped' then coalesce(stt, 0::float) else coalesce(pt, 0::float) end end, stt, pt, 0::float) mc,
  case when quality.video_bitrate is null then 0 else least(quality.video_bitrate::double / 4e6::double, 1.1::double) end + case when quality.audio_bitrate is null then 0 else least(quality.audio_bitrate::double / 512e3::double, 0.35::double) end
  + case when quality.duration_secs >= 1200 then 0.18::double else 0 end + case lower(trim(quality.resolution_label)) when '2160p' then 0.65 when '4k' then 0.65 when '1440p' then 0.4 when '1080p' then 0.24 when '720p' then 0.08 else 0 end::double
  + case when regexp_matches(lower(quality.video_codec), '265|hevc') then 0.12::double else 0 end + case when regexp_matches(lower(quality.audio_codec), 'truehd|dts-hd|atmos') then 0.2::double when contains(lower(quality.audio_codec), 'dts') then 0.1::double else 0 end
  + {" + ".join(_suffix_sql(f"p.{c}") for c in ("media_suffix", "source", "resolution"))} + {" + ".join(_release_sql(f"p.{c}") for c in ("media_suffix", "source"))}
  + case when len({_SUBS}) > 0 then 0.22::double + greatest(least(len({_SUBS}), 3)::double - 1, 0) * 0.05::double else 0 end
  + case when len(list_filter({_SUBS}, lambda t: lower(coalesce(t.language, '')) in ('zh','zho','chi','chs','cht','en','eng'))) > 0 then 0.08::double else 0 end
  + case when abs(ce.runtime_secs - quality.duration_secs) <= 3 then 0.08::double when abs(ce.runtime_secs - quality.duration_secs) >= 90 then -0.18::double else 0 end
  + case when {_OWN} >= 2 then 0.16::double when {_OWN} = 1 then 0.06::double else 0 end + case when len(coalesce(ce.container.stream_languages, [])) >= 2 then 0.08::double else 0 end + case when {_FULL} >= 2 then 0.12::double else 0 end vq,
  case when regexp_matches(lower(path), '/sample/| sample|-sample') then -1.25::double else 0 end + case when regexp_matches(lower(path), '/extras/|/featurettes/|/behind the scenes/|/specials/|特别篇|花絮') then -0.85::double else 0 end
  + case when len({_SUBS}) > 0 and len(list_filter({_SUBS}, lambda t: not {_FORCED.format('t.track_title')})) = 0 then -0.55::double when len({_SUBS}) > 0 then 0.18::double else 0 end
  + case when len(list_filter(coalesce(ce.risk_flags, []), lambda f: contains(lower(f), 'failed'))) > 0 then -0.15::double else 0 end + case when abs(ce.runtime_secs - quality.duration_secs) >= 180 then -0.4::double else 0 end
  + case when media_type = 'Movie' and quality.duration_secs < 2400 then -0.75::double when media_type in ('TvShow', 'Strm') and quality.duration_secs < 600 then -0.55::double else 0 end
  + case pv when 'season_cluster' then 0.14 when 'season' then 0.08 when 'loose' then 0.02 when 'extras' then -0.65 else 0 end::double compl from k),
ef as (select *, round(q + vq + compl + 0.35::double * mc::double + 0.45::double * trust::double, 9) effective from sc),
r as (select *, row_number() over (partition by version_key order by effective desc, q desc, trust desc, mc desc, file_size desc nulls last, id desc) rn, count(*) over g n, count(hash.full_hash) over g h, min(hash.full_hash) over g lo, max(hash.full_hash) over g hi,
  min(compl) over g least_completeness, max(mc) over g most_confidence, max(file_size) over g largest from ef where version_key is not null window g as (partition by version_key))
"""
)


@query(_ITEM + _EFFECTIVE + "select version_key, n, id keep_id, round(effective, 6) keep_score, round(least_completeness, 6) least_completeness, most_confidence, largest from r where rn = 1 and n > 1 and not (h = n and lo = hi)")
def version_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version to keep of each work, by its effective score."""
    return dedup.version_groups(dedup.judged(table(spark, sf_dir, "media_item"))).withColumn("keep_score", F.round("keep_score", 6)).withColumn("least_completeness", F.round("least_completeness", 6))


# -- lookups -------------------------------------------------------------------------------------


@query("select item_id, max(probed_at) probed_at, arg_max(probe_id, (probed_at, probe_id)) probe_id from (select distinct item_id, probed_at, probe_id from probe_record) group by item_id")
def newest_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last probe of each item."""
    return linking.newest(table(spark, sf_dir, "probe_record").select("item_id", "probed_at", "probe_id"), ["item_id"], "probed_at")


@query(_ITEM + "select id, media_type from item where id not in (select item_id from probe_record where item_id is not null)")
def unprobed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without any probe."""
    probes = table(spark, sf_dir, "probe_record").select(F.col("item_id").alias("id"))
    return linking.with_cache(items(spark, sf_dir, "id", "media_type"), probes, ["id"])[1]


@query("select probe_id, item_id from (select distinct probe_id, item_id, probed_at from probe_record) where probed_at is null or epoch(timestamp '2025-01-01') - floor(epoch(probed_at)) <= 365 * 86400")
def fresh_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes not older than a year at the start of 2025."""
    rows = table(spark, sf_dir, "probe_record").select("probe_id", "item_id", "probed_at").distinct()
    at = F.floor(F.unix_micros(F.col("probed_at").cast("timestamp")) / 1_000_000)
    return linking.alive(rows.withColumn("updated_at", at), F.lit(1_735_689_600), 365).select("probe_id", "item_id")


@query(
    """with c as (select distinct d.content_id, m.scraped.source source, m.scraped.title title from duplicate_item d join media_item m on m.id = d.item_index where m.scraped is not null),
r as (select *, list_position(['LocalNfo', 'Tmdb', 'MusicBrainz', 'OpenLibrary', 'AiAssist', 'Guess'], source) p from c)
select content_id, source, title from (select *, row_number() over (partition by content_id order by p, title nulls first) n from r where p > 0) where n = 1 and content_id is not null"""
)
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looked-up title of each duplicate group by the first source in order that has one."""
    looked = table(spark, sf_dir, "media_item").filter("scraped is not null").select(F.col("id").alias("item_index"), F.col("scraped.source").alias("source"), F.col("scraped.title").alias("title"))
    answers = table(spark, sf_dir, "duplicate_item").filter("content_id is not null").select("content_id", "item_index").join(looked, "item_index").select("content_id", "source", "title")
    return linking.first_source(answers, "content_id", "source", ["LocalNfo", "Tmdb", "MusicBrainz", "OpenLibrary", "AiAssist", "Guess"])


def _bare_sql(x: str) -> str:
    form = f"trim(replace(replace(replace({x}, '.', ' '), '_', ' '), '  ', ' '))"
    noise = "'1080p','720p','2160p','4k','webrip','web-dl','bluray','brrip','x264','x265','h264','h265','hevc','aac','dts','hdr','dv'"
    return f"array_to_string(list_filter(string_split_regex({form}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '' and lower(x) not in ({noise})), ' ')"


@query(
    _ITEM
    + f""", q as (select id, parsed.year y, content_evidence.title_candidates seen, {_bare_sql("trim(parsed.raw_title)")} bare from item where media_type = 'Movie' and trim(parsed.raw_title) <> ''),
f as (select id, y, lower(bare) own, [lower(bare), lower(array_to_string(list_filter(string_split(bare, ' '), lambda x: not regexp_matches(x, '^(19|20)[0-9]{{2}}$') and not regexp_matches(lower(x), '^s[0-9]{{2}}e[0-9]{{2}}$')), ' '))] forms,
  list_filter(list_transform(coalesce(seen, []), lambda x: lower({_bare_sql("x").replace("lambda x:", "lambda v:").replace("x <> ''", "v <> ''").replace("lower(x) not", "lower(v) not")})), lambda x: x <> '') shown from q),
m as (select distinct id, title, original_title, try_cast(release_date[:4] as int) cy, vote_average from tmdb_movie),
c as (select id cid, cy, vote_average, lower({_bare_sql("title")}) theirs, coalesce(lower({_bare_sql("original_title")}), '') orig from m),
met as (select distinct f.id, c.cid from (select id, y, unnest(list_distinct(forms)) form from f) f join (select cid, cy, unnest(list_distinct([theirs, orig])) form from c) c on f.form = c.form and f.form <> '' and (f.y is null or c.cy is null or abs(f.y - c.cy) <= 1)),
j as (select f.*, c.*, list_position(list_transform(shown, lambda s: s = theirs or s = orig), true) hit from met join f using (id) join c using (cid)),
g as (select id, cid, (case when own <> '' and (theirs = own or orig = own) then 1.2::double when own <> '' and (contains(theirs, own) or contains(own, theirs) or (orig <> '' and contains(orig, own))) then 0.7::double else 0 end
  + case when y is null or cy is null then 0 when y = cy then 0.45::double when abs(y - cy) = 1 then 0.12::double else -0.25::double end
  + 0.18::double * len(list_filter(case when hit > 0 then shown[:hit - 1] else shown end, lambda s: contains(theirs, s) or contains(s, theirs) or (orig <> '' and contains(orig, s)))) + case when hit > 0 then 0.48::double else 0 end
  + case when vote_average >= 7 then 0.05::double else 0 end)::float score from j),
r as (select *, row_number() over w rank, (score - lead(score) over w)::float gap from g window w as (partition by id order by score desc, cid))
select id, cid tmdb_id, round(score::double, 5) score, rank, round(gap::double, 5) gap from r where rank <= 5"""
)
def film_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five films of the catalogue for each film item by the forms of its title, with their scores."""
    asked = items(spark, sf_dir, "id", F.col("parsed.raw_title").alias("title"), F.col("parsed.year").alias("year"), F.col("parsed.season").alias("season"), "media_type", F.col("content_evidence.title_candidates").alias("seen")).filter("media_type = 'Movie'")
    films = table(spark, sf_dir, "tmdb_movie").select("id", "title", F.col("original_title").alias("original"), F.expr("try_cast(substring(release_date, 1, 4) as int)").alias("year"), F.col("vote_average").alias("rating")).distinct()
    return linking.lookups(asked, films).select("id", F.col("c_id").alias("tmdb_id"), F.round(F.col("score").cast("double"), 5).alias("score"), "rank", F.round(F.col("gap").cast("double"), 5).alias("gap"))


@query(
    _ITEM
    + """, f as (select id, path, regexp_replace(path, '/?[^/]*$', '') dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') stem from item)
select distinct a.id, b.path companion from f a join f b on a.dir = b.dir and a.path <> b.path and a.stem <> '' and (b.stem = a.stem or starts_with(b.stem, a.stem || '.') or starts_with(b.stem, a.stem || '-'))"""
)
def companion_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files beside an item that are named like it."""
    rows = items(spark, sf_dir, "id", "path")
    return linking.companions(rows, rows.select("path")).distinct()


@query(
    _ITEM
    + """, big as (select regexp_replace(path, '/?[^/]*$', '') dir, count(*) files from item group by 1 having count(*) >= 3),
up as (select id, l depth, array_to_string(string_split(path, '/')[:len(string_split(path, '/')) - 1 - l], '/') dir from item, unnest([0, 1, 2]) u(l) where len(string_split(path, '/')) - 2 - l >= 1)
select id, depth, dir, files from (select up.id, up.depth::int depth, big.dir, big.files, row_number() over (partition by id order by depth) r from up join big using (dir)) where r = 1"""
)
def nearest_full_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the nearest folder above it, of three, that holds three files at least."""
    rows = items(spark, sf_dir, "id", "path")
    folders = planning.tree(rows.withColumn("file_size", F.lit(0))).filter("files >= 3").select("dir", "files")
    return linking.nearest_above(rows, folders, 3).select("id", "depth", "dir", "files")


@query(
    """with q as (select vec_id q, embedding::double[] v from embeddings where vec_id % 20 = 0)
select query_id, id, round(similarity, 6) similarity, rank from (
  select q.q query_id, e.vec_id id, round(list_cosine_similarity(q.v, e.embedding::double[]), 9) similarity, row_number() over (partition by q.q order by round(list_cosine_similarity(q.v, e.embedding::double[]), 9) desc, e.vec_id) rank
  from q, embeddings e where q.q <> e.vec_id) where rank <= 10"""
)
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one."""
    rows = table(spark, sf_dir, "embeddings")
    blocks = max(1, rows.count() // 20_000)
    found = vectors.nearest(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, blocks, max(1, blocks // 20))
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


# -- content -------------------------------------------------------------------------------------


@query(
    r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) x, unnest(range(len(string_split_regex(text, '\r?\n')))) pos from documents where source = 'subtitle' and text is not null),
t as (select doc_id, pos, replace(trim(x), '\N', ' ') t from l),
c as (select doc_id, pos, case when regexp_matches(t, '^\d{2}:\d{2}:\d{2}|^\d+$') then '' else trim(replace(regexp_replace(t, '\{[^}]+\}|<[^>]+>', '', 'g'), '&nbsp;', ' ')) end line from t),
k as (select *, row_number() over (partition by doc_id order by pos) n from c where strlen(line) >= 2 and not (line like '[%' and line like '%]')),
p as (select *, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[-:|"'']+|[-:|"'']+$', '', 'g'), '[._]+', ' ', 'g'), '\s+', ' ', 'g'))) form,
  case when regexp_matches(lower(line), 'previously on|last time on|前情提要|上集回顾') then 4 when regexp_matches(lower(line), 'you are watching|you''re watching|from the series') then 3
    when regexp_matches(line, '(?i)S\d{1,2}E\d{1,3}|(?:Episode|EP|E)\s*\d{1,3}|第\s*\d{1,3}\s*集') then 2 else 1 end signal, case when length(line) between 4 and 48 then 2 else 1 end readable from k where n <= 64),
o as (select *, row_number() over (partition by doc_id order by signal desc, readable desc, strlen(line), n) r from p),
d as (select *, row_number() over (partition by doc_id, form order by r) copy from o where form <> '')
select doc_id, (row_number() over (partition by doc_id order by r) - 1)::int pos, line from d where copy = 1 qualify row_number() over (partition by doc_id order by r) <= 12"""
)
def telling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling lines of each subtitle text, in order."""
    docs = table(spark, sf_dir, "documents").filter("source = 'subtitle'")
    return docs.select("doc_id", F.posexplode(evidence.telling_lines(evidence.spoken_lines(F.col("text")))).alias("pos", "line"))


# The forms of lines that name a title, as SQL has them; written out so that a slip in the engine's shows.
_LINE_FORMS = [
    r"(?i)^previously on\s+(.+)$", r"(?i)^last time on\s+(.+)$", r"(?i)^you(?:''re| are) watching\s+(.+)$", r"(?i)^watching\s+(.+)$", r"(?i)^from the series\s+(.+)$", r"(?i)^(.+?)\s*-\s*S\d{1,2}E\d{1,3}\b",
    r"(?i)^(.+?)\s+season\s+\d{1,2}\s+episode\s+\d{1,3}\b", r"(?i)^(.+?)\s+ep(?:isode)?\s+\d{1,3}\b", r"""^["''“《](.+?)["''”》]\s*(?:第\s*\d+\s*集|episode\s*\d+|ep\s*\d+|s\d{1,2}e\d{1,3})""",
    r"^(.+?)\s*[·:：]\s*(?:第\s*\d+\s*集|episode\s*\d+|ep\s*\d+|s\d{1,2}e\d{1,3})", r"^(.+?)\s*前情提要$", r"^(.+?)\s*上[一二三四五六七八九0-9]*集回顾$", r"^(.+?)\s*第\s*\d+\s*集$", r"^第\s*\d+\s*集\s*(.+)$",
]
_EXTRACTED = ", ".join(f"trim(regexp_extract(l, '{p}', 1))" for p in _LINE_FORMS)
_TITLE_FORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^[-:|"'']+|[-:|"'']+$', '', 'g'), '[._]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(
    _ITEM
    + rf""", c as (select id, content_evidence c from item where content_evidence is not null),
sub as (select id, unnest(c.subtitles) s, unnest(range(len(c.subtitles))) i from c), ln as (select id, i, unnest(s.sample_lines) l, unnest(range(len(s.sample_lines))) k from sub),
raw as (select id, 0 o, 0 i, 0 k, 0 m, coalesce(c.container.title, '') x from c union all select id, 1, unnest(range(len(c.container.chapters))), 0, 0, unnest(c.container.chapters) from c union all select id, 2, unnest(range(len(c.title_candidates))), 0, 0, unnest(c.title_candidates) from c
  union all select id, 3, i, unnest(range(len(s.title_candidates))), 0, unnest(s.title_candidates) from sub union all select id, 4, i, k, m, x from (select id, i, k, unnest([{_EXTRACTED}]) x, unnest(range({len(_LINE_FORMS)})) m from ln where l is not null) where x <> ''),
f as (select *, {_TITLE_FORM} t from raw where x is not null), g as (select *, trim(regexp_replace(regexp_replace(lower(t), '[·:：\-_''"“”‘’《》()\[\]]', ' ', 'g'), '\s+', ' ', 'g')) key from f where len(string_split(t, ' ')) <= 10 and strlen(t) <= 64),
d as (select *, row_number() over (partition by id, key order by o, i, k, m) r from g where key <> '')
select id, (row_number() over (partition by id order by o, i, k, m) - 1)::int pos, t title from d where r = 1"""
)
def content_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that an item's content names, each once: of its container, chapters, subtitles and lines."""
    c = F.col("content_evidence")
    none = F.array().cast("array<string>")
    subs = c["subtitles"]
    listed = F.flatten(F.transform(subs, lambda s: F.coalesce(s["title_candidates"], none)))
    spoken = F.flatten(F.transform(F.flatten(F.transform(subs, lambda s: F.coalesce(s["sample_lines"], none))), evidence.titles_in))
    every = F.concat(F.array(F.coalesce(c["container"]["title"], F.lit(""))), F.coalesce(c["container"]["chapters"], none), F.coalesce(c["title_candidates"], none), F.coalesce(listed, none), F.coalesce(spoken, none))
    rows = items(spark, sf_dir, "id", F.when(c.isNotNull(), evidence.title_aliases(F.array_compact(every))).alias("titles")).filter("titles is not null")
    return rows.select("id", F.posexplode("titles").alias("pos", "title"))


# -- plans and reports ---------------------------------------------------------------------------


def named_items(spark: SparkSession, sf_dir: str, *others: Column) -> DataFrame:
    """The items with all that names are made of."""
    more = [F.col("scraped.episode_name").alias("ep_name"), *[F.col(f"scraped.{c}").alias(c) for c in ("artist", "album", "author")], F.col("parsed.media_suffix").alias("media_suffix")]
    return dedup.judged(table(spark, sf_dir, "media_item"), *more, *others, scored=False)


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+-\s+', ' - ', 'g'), '\s+-\s*$', '', 'g'), '^\s*-\s+', '', 'g'), '  +', ' ', 'g')"


_RENAMES = (
    r""", n as (select id, path, regexp_extract(path, '[^/]\.([^./]*)$', 1) ext, regexp_replace(path, '/?[^/]*$', '') dir, lpad(sn::varchar, greatest(2, length(sn::varchar))::int, '0') s2, lpad(ep::varchar, greatest(2, length(ep::varchar))::int, '0') e2, title, y, s, media_type from pref),
m as (select *, case when media_type in ('TvShow', 'Strm') then coalesce(title, '') || ' - S' || coalesce(s2, '') || 'E' || coalesce(e2, '') || ' - ' || coalesce(s.episode_name, '')
    when media_type = 'Music' then coalesce(s.artist, '') || ' - ' || coalesce(s.album, '') || ' - ' || coalesce(title, '') when media_type = 'Novel' then coalesce(s.author, '') || ' - ' || coalesce(title, '') else coalesce(title, '') || ' (' || coalesce(y::varchar, '') || ')' end raw from n),
c as (select *, """
    + _CLEAN.format(_CLEAN.format(_CLEAN.format(r"regexp_replace(regexp_replace(regexp_replace(raw, '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '  +', ' ', 'g')")))
    + r""" x from m),
d as (select id, path old_path, dir || '/' || nullif(regexp_replace(regexp_replace(trim(replace(regexp_replace(x, '(^|[^A-Za-z0-9])S(E\d{2}\b)', '\1\2', 'g'), '..', '.')), '[\s.]+$', ''), '^[\s.]+', ''), '') || case when ext <> '' then '.' || ext else '' end new_path from c),
p as (select * from d where new_path is not null and new_path <> old_path)
"""
)


@query(
    _ITEM
    + _TRUST
    + _RENAMES
    + "select id, old_path, new_path, count(*) over (partition by new_path) wanted, new_path in (select path from item where path is not null) and new_path not in (select old_path from p where old_path is not null) occupied from p"
)
def rename_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names by the templates of each kind, with how many want each and whether it is taken."""
    return planning.conflicts(planning.rename_plan(named_items(spark, sf_dir)), items(spark, sf_dir, "path")).select("id", "old_path", "new_path", "wanted", "occupied")


_ORGANIZED = r"""
, ofrom as (select id, path, media_type, title, sn, s.artist artist from pref),
oto as (select *, '/library/' || case media_type when 'Movie' then 'Movies' when 'TvShow' then 'TV Shows' when 'Strm' then 'TV Shows' when 'Music' then 'Music' when 'Novel' then 'Books' else 'Other' end
  || case when media_type = 'Music' then coalesce('/' || nullif(trim(translate(artist, '<>:"/\|?*', '_________')), ''), '') else '' end || '/' || coalesce(nullif(trim(translate(title, '<>:"/\|?*', '_________')), ''), 'Unknown')
  || case when media_type = 'TvShow' and sn is not null then '/Season ' || lpad(sn::varchar, greatest(2, length(sn::varchar))::int, '0') else '' end dir from ofrom),
og as (select id, path old_path, dir || '/' || regexp_extract(path, '([^/]*)$', 1) new_path from oto)
"""


@query(_ITEM + _TRUST + _ORGANIZED + "select id, old_path, new_path, 'Move' action from og where new_path <> old_path")
def organize_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items belong in a library sorted by kind, title and season."""
    return planning.organize_plan(named_items(spark, sf_dir), "/library")


def _tag(name: str, value: str) -> str:
    escaped = f"({value})::varchar"
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        escaped = f"replace({escaped}, '{raw}', '{to}')"
    return f"'  <{name}>' || {escaped} || '</{name.split(' ')[0]}>'"


_EPISODE_TITLE = "case when epi then coalesce(s.episode_name, s.title) else s.title end"
_TAGS = [
    _tag("title", _EPISODE_TITLE), f"case when epi then {_tag('showtitle', 's.title')} end", _tag("originaltitle", "s.title_original"),
    *[f"case when epi then {_tag(t, f's.{t}_number')} end" for t in ("season", "episode")], *[f"case when music then {_tag(t, f's.{t}')} end" for t in ("artist", "album")],
    _tag("year", "s.year"), _tag("plot", "s.overview"), _tag("thumb", "s.poster_url"), *[_tag(f'uniqueid type="{t}"', f"s.{t}_id") for t in ("tmdb", "musicbrainz", "openlibrary")],
]


@query(
    _ITEM
    + """, t as (select id, scraped s, media_type = 'TvShow' and scraped.episode_number is not null epi, media_type = 'Music' music, case media_type when 'Movie' then 'movie' when 'TvShow' then case when scraped.episode_number is not null then 'episodedetails' else 'tvshow' end when 'Music' then 'music' end root from item where scraped is not null)
select id, concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', '<' || root || '>', """
    + ", ".join(_TAGS)
    + ", '</' || root || '>') as text from t where root is not null"
)
def sidecar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a metadata file for each looked-up item."""
    return items(spark, sf_dir, "id", planning.sidecar(F.col("media_type"), F.col("scraped")).alias("text")).filter("text is not null")


@query(
    _ITEM
    + """select count(*) items, count(parsed) parsed, count_if(media_type = 'TvShow') tv, count_if(parsed.parse_source = 'Context') from_context, count(scraped) scraped, count(hash) hashed, count(hash.full_hash) hashed_in_full,
  count(quality) probed, sum(file_size)::bigint bytes from item"""
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each stage of the pipeline has reached."""
    return planning.stage_report(table(spark, sf_dir, "media_item"))


@query(_ITEM + "select id, path from item where contains(lower(regexp_extract(path, '([^/]*)$', 1)), 'harbor') or contains(lower(coalesce(parsed.raw_title, '')), 'harbor') or contains(lower(coalesce(scraped.title, '')), 'harbor')")
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose name or titles hold a word."""
    rows = items(spark, sf_dir, "id", "path", F.col("parsed.raw_title").alias("a"), F.col("scraped.title").alias("b"))
    return planning.search(rows, "harbor", paths.file_name(F.col("path")), F.col("a"), F.col("b")).select("id", "path")


@query(_ITEM + "select regexp_replace(path, '/?[^/]*$', '') dir, count(*) files, sum(file_size)::bigint bytes, min(path) first, max(path) last from item group by 1")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders with what they hold."""
    return planning.tree(items(spark, sf_dir, "id", "path", "file_size"))
