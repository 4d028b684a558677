"""Queries over nested records and stored probe output, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import evidence, scoring
from corvane.operators.dedup import ranked
from corvane.operators.nested import groups_of, json_pieces, pivot, struct_pieces
from corvane.session import table

#: Group of the shredded record and the name of its rows in p1_found.
CHILDREN = {
    "quality": "quality",
    "scraped": "scraped",
    "rename_plan": "rename_plan",
    "scraped.evidence": "scraped_evidence",
    "rename_plan.subtitle_plans": "subtitle_plan",
    "rename_plan.directory_plans": "directory_plan",
    "rename_plan.rationale": "rationale",
    "rename_plan.conflicts": "conflict",
    "streams": "stream",
}

STREAM = [("index", T.LongType()), ("codec_type", T.StringType()), ("codec_name", T.StringType()), ("width", T.LongType()), ("height", T.LongType()), ("bit_rate", T.LongType()), ("tags.language", T.StringType()), ("tags.title", T.StringType()), ("disposition.default", T.LongType()), ("disposition.forced", T.LongType())]


def probe_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_pieces(table(spark, sf_dir, "probe_record"), "probe_id", "payload", anchor="streams", lone=("streams",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child of a record with its owner and place; repeated deliveries count once."""
    pieces = struct_pieces(table(spark, sf_dir, "media_item"), "id", ["quality", "scraped", "rename_plan"])
    names = F.create_map(*[F.lit(x) for pair in CHILDREN.items() for x in pair])
    rows = pieces.select("grp", "owner", "ords").unionByName(probe_pieces(spark, sf_dir).filter(F.col("grp") == "streams").select("grp", "owner", "ords"))
    pos = F.coalesce(F.try_element_at("ords", F.lit(-1)), F.lit(0)).cast("bigint")
    return rows.select(names[F.col("grp")].alias("child"), F.col("owner").alias("owner_id"), pos.alias("pos")).distinct()


def p1_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of streams: one row per stream of a probe, linked to it by probe_id and its place."""
    return pivot(probe_pieces(spark, sf_dir), "streams", STREAM).withColumnRenamed("owner", "probe_id").drop("parent_pos").distinct()


def p1_subtitle_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of planned subtitle renames, linked to its record by item_id and its place."""
    pieces = struct_pieces(table(spark, sf_dir, "media_item"), "id", ["rename_plan"])
    rows = pivot(pieces, "rename_plan.subtitle_plans", [("old_path", T.StringType()), ("new_path", T.StringType())])
    return rows.withColumnRenamed("owner", "item_id").drop("parent_pos").distinct()


def _tables(spark: SparkSession, sf_dir: str, column: str, group: str, lists: bool = False) -> DataFrame:
    """One table of the items' nested records, linked to its record by item_id, to its parent by parent_pos, and by its place."""
    rows = table(spark, sf_dir, "media_item")
    made = pivot(struct_pieces(rows, "id", [column]), group, groups_of(rows.schema, [column])[group]).withColumnRenamed("owner", "item_id")
    return (made if lists else made.drop("parent_pos")).distinct()


def p1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of technical qualities, one row per item that has one."""
    return _tables(spark, sf_dir, "quality", "quality")


def p1_scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of looked-up metadata, without its evidence."""
    return _tables(spark, sf_dir, "scraped", "scraped")


def p1_scraped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the evidence of looked-up metadata, by its place."""
    return _tables(spark, sf_dir, "scraped", "scraped.evidence")


def p1_rename_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of stored rename plans with their decisions."""
    return _tables(spark, sf_dir, "rename_plan", "rename_plan")


def p1_directory_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of planned folder renames, by their place."""
    return _tables(spark, sf_dir, "rename_plan", "rename_plan.directory_plans")


def p1_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the reasons of rename plans, by their place."""
    return _tables(spark, sf_dir, "rename_plan", "rename_plan.rationale")


def p1_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the conflicts of rename plans, by their place."""
    return _tables(spark, sf_dir, "rename_plan", "rename_plan.conflicts")


def p1_subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of sampled subtitle lines: a list in a list, linked to its subtitle by parent_pos."""
    rows = _tables(spark, sf_dir, "content_evidence", "content_evidence.subtitles.sample_lines", lists=True)
    return rows.select("item_id", F.col("parent_pos")[0].cast("bigint").alias("subtitle_pos"), "pos", "value")


FORMAT = [("format.format_name", T.StringType()), ("format.duration", T.DoubleType()), ("format.bit_rate", T.LongType()), ("format.tags.title", T.StringType()), ("format.tags.comment", T.StringType())]


def p1_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of probed containers, one row per probe that can be read."""
    return pivot(probe_pieces(spark, sf_dir), "", FORMAT).withColumnRenamed("owner", "probe_id").drop("parent_pos", "pos").distinct()


def p1_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of chapters, linked to their probe by probe_id and their place."""
    return pivot(probe_pieces(spark, sf_dir), "chapters", [("tags.title", T.StringType())]).withColumnRenamed("owner", "probe_id").drop("parent_pos").distinct()


def probed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each probe says of its file's quality: of the last video and the last audio stream, and the container."""
    pieces = probe_pieces(spark, sf_dir).filter("grp in ('', 'streams')")
    both = pivot(pieces.withColumn("grp", F.lit("x")), "x", [*STREAM, *FORMAT]).withColumn("root", F.col("pos"))
    at = F.when(F.col("codec_type") == "video", F.struct("pos", "width", "height", "codec_name", "bit_rate"))
    sound = F.when(F.col("codec_type") == "audio", F.struct("pos", "codec_name", "bit_rate"))
    rows = both.groupBy(F.col("owner").alias("probe_id")).agg(F.max(at).alias("v"), F.max(sound).alias("a"), F.max("format_duration").alias("duration"), F.max("format_bit_rate").alias("rate"))
    height = F.col("v.height")
    score = scoring.quality_score(height, F.col("v.codec_name"), F.coalesce("v.bit_rate", F.when(F.col("v").isNotNull(), F.col("rate"))), F.col("a.codec_name"))
    return rows.select("probe_id", F.col("v.width").alias("width"), height.alias("height"), scoring.resolution_label(height).alias("label"), F.col("v.codec_name").alias("video_codec"), F.coalesce("v.bit_rate", F.when(F.col("v").isNotNull(), F.col("rate"))).alias("video_bitrate"), F.col("a.codec_name").alias("audio_codec"), F.col("a.bit_rate").alias("audio_bitrate"), F.floor("duration").alias("duration_secs"), F.round(score, 6).alias("score"))


def probed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each probe says of its container: name, title, and how many chapters, languages and track titles it names."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    pieces = probe_pieces(spark, sf_dir)
    leaf = lambda path: some(F.get(F.filter("leaves", lambda x: x["path"] == path), F.lit(0))["value"])
    at = lambda grp, value: F.when(F.col("grp") == grp, value)
    return pieces.groupBy(F.col("owner").alias("probe_id")).agg(
        F.max(at("", leaf("format.format_name"))).alias("format_name"), F.max(at("", leaf("format.tags.title"))).alias("title"), F.count_distinct(at("chapters", F.when(leaf("tags.title").isNotNull(), F.col("ords")))).alias("chapters"),
        F.count_distinct(at("streams", leaf("tags.language"))).alias("languages"), F.count_distinct(at("streams", leaf("tags.title"))).alias("track_titles"),
    )


def subtitle_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three subtitle streams of each probe to read first: by language, kind of track, and marks."""
    streams = p1_streams(spark, sf_dir).filter("codec_type = 'subtitle'")
    order = evidence.subtitle_priority(F.col("tags_language"), F.col("tags_title"), F.col("disposition_default"), F.col("disposition_forced"))
    return ranked(streams.withColumn("order", order), ["probe_id"], [F.desc("order"), F.col("pos")], 3).select("probe_id", "pos", "rank", "tags_language")


_FLAT = """
with item as (select distinct * from media_item),
flat as (
  select 'quality' child, id owner_id, 0::bigint pos from item where quality is not null
  union all select 'scraped', id, 0 from item where scraped is not null
  union all select 'rename_plan', id, 0 from item where rename_plan is not null
"""
_ARRAYS = {"scraped_evidence": "scraped.evidence", "subtitle_plan": "rename_plan.subtitle_plans", "directory_plan": "rename_plan.directory_plans", "rationale": "rename_plan.rationale", "conflict": "rename_plan.conflicts"}
_STREAMS = """
body as (
  select probe_id, coalesce(json_extract(payload::json, '$.result'), json_extract(payload::json, '$.data'), payload::json) b
  from (select distinct probe_id, payload from probe_record where json_valid(payload))
),
raw as (select probe_id, json_extract(b, '$.streams') s from body),
parsed as (select probe_id, case when json_type(s) = 'VARCHAR' then json_extract_string(s, '$')::json else s end s from raw),
listed as (select probe_id, case json_type(s) when 'ARRAY' then json_extract(s, '$[*]') when 'OBJECT' then [s] else [] end a from parsed),
placed as (select probe_id, unnest(a) e, unnest(range(len(a))) pos from listed),
stream as (select distinct probe_id, pos, e from placed where json_type(e) <> 'NULL')
"""

def _list_sql(path: str, columns: str) -> str:
    return f"with item as (select distinct id, {path} p from media_item where len({path}) > 0), placed as (select id, unnest(p) e, unnest(range(len(p))) pos from item) select distinct id item_id, pos, {columns} from placed where e is not null"


ORACLE = {
    "p1_found": _FLAT
    + "".join(f"  union all select '{child}', id, unnest(range(len({path}))) from item where len({path}) > 0\n" for child, path in _ARRAYS.items())
    + "),\n"
    + "held as (select * from flat where child not in ('scraped_evidence', 'subtitle_plan', 'directory_plan', 'rationale', 'conflict')\n"
    + "".join(f"  union all select f.child, f.owner_id, f.pos from flat f join item i on i.id = f.owner_id where f.child = '{child}' and i.{path}[f.pos + 1] is not null\n" for child, path in _ARRAYS.items())
    + "),"
    + _STREAMS
    + "select distinct child, owner_id, pos from held union select 'stream', probe_id, pos from stream",
    "p1_streams": "with "
    + _STREAMS
    + """select probe_id, pos, try_cast(e->>'index' as bigint) "index", e->>'codec_type' codec_type, e->>'codec_name' codec_name,
  try_cast(e->>'width' as bigint) width, try_cast(e->>'height' as bigint) height, try_cast(e->>'bit_rate' as bigint) bit_rate,
  coalesce(e->>'$.tags.language', e->>'$.tags.LANGUAGE') tags_language, coalesce(e->>'$.tags.title', e->>'$.tags.TITLE') tags_title,
  try_cast(e->>'$.disposition.default' as bigint) disposition_default, try_cast(e->>'$.disposition.forced' as bigint) disposition_forced from stream""",
    "subtitle_choices": "with "
    + _STREAMS
    + """, s as (select probe_id, pos, coalesce(e->>'$.tags.language', e->>'$.tags.LANGUAGE') lang, lower(coalesce(e->>'$.tags.title', e->>'$.tags.TITLE', '')) title, coalesce(try_cast(e->>'$.disposition.default' as int), 0) d, coalesce(try_cast(e->>'$.disposition.forced' as int), 0) f from stream where e->>'codec_type' = 'subtitle')
select probe_id, pos, rank, lang tags_language from (select *, row_number() over (partition by probe_id order by case when lower(lang) in ('chi', 'zho', 'zh', 'chs', 'cht') then 3 when lower(lang) in ('eng', 'en') then 2 else 1 end desc,
  case when title like '%forced%' or title like '%commentary%' then 0 when title like '%full%' then 2 else 1 end desc, d desc, 1 - f desc, pos) rank from s) where rank <= 3""",
    "p1_quality": "select distinct id item_id, 0::bigint pos, unnest(quality) from media_item where quality is not null",
    "p1_scraped": "select * exclude (evidence) from (select distinct id item_id, 0::bigint pos, unnest(scraped) from media_item where scraped is not null)",
    "p1_scraped_evidence": _list_sql("scraped.evidence", "e as value"),
    "p1_rename_plans": """select distinct id item_id, 0::bigint pos, r.old_path old_path, r.new_path new_path, d.template decision_template, d.template_uses_ext decision_template_uses_ext, d.preserve_media_suffix decision_preserve_media_suffix,
  d.title_origin decision_title_origin, d.title_confidence decision_title_confidence, d.year_origin decision_year_origin, d.year_confidence decision_year_confidence, d.season_origin decision_season_origin, d.season_confidence decision_season_confidence,
  d.episode_origin decision_episode_origin, d.episode_confidence decision_episode_confidence, d.subtitle_count decision_subtitle_count, d.directory_count decision_directory_count from (select id, rename_plan r, rename_plan.decision d from media_item where rename_plan is not null)""",
    "p1_directory_plans": _list_sql("rename_plan.directory_plans", "e.old_path old_path, e.new_path new_path"),
    "p1_rationales": _list_sql("rename_plan.rationale", "e as value"),
    "p1_conflicts": _list_sql("rename_plan.conflicts", "e as value"),
    "p1_subtitle_lines": """with s as (select distinct id, unnest(content_evidence.subtitles).sample_lines l, unnest(range(len(content_evidence.subtitles))) subtitle_pos from media_item),
p as (select id, subtitle_pos, unnest(l) x, unnest(range(len(l))) pos from s) select distinct id item_id, subtitle_pos, pos, x as value from p where x is not null""",
    "p1_formats": "with " + _STREAMS + """select distinct probe_id, b->>'$.format.format_name' format_format_name, try_cast(b->>'$.format.duration' as double) format_duration, try_cast(b->>'$.format.bit_rate' as bigint) format_bit_rate, b->>'$.format.tags.title' format_tags_title, b->>'$.format.tags.comment' format_tags_comment from body""",
    "p1_chapters": "with " + _STREAMS + """, c as (select probe_id, json_extract(b, '$.chapters[*]') a from body), x as (select probe_id, unnest(a) e, unnest(range(len(a))) pos from c) select distinct probe_id, pos, e->>'$.tags.title' tags_title from x where json_type(e) <> 'NULL'""",
    "probed_quality": "with " + _STREAMS + """, f as (select distinct probe_id, try_cast(b->>'$.format.duration' as double) dur, try_cast(b->>'$.format.bit_rate' as bigint) rate from body),
v as (select probe_id, pos, try_cast(e->>'width' as bigint) w, try_cast(e->>'height' as bigint) h, e->>'codec_name' c, try_cast(e->>'bit_rate' as bigint) r from stream where e->>'codec_type' = 'video' qualify row_number() over (partition by probe_id order by pos desc) = 1),
s as (select probe_id, e->>'codec_name' c, try_cast(e->>'bit_rate' as bigint) r from stream where e->>'codec_type' = 'audio' qualify row_number() over (partition by probe_id order by pos desc) = 1),
j as (select f.probe_id, v.w, v.h, v.c vc, case when v.probe_id is not null then coalesce(v.r, f.rate) end vr, s.c ac, s.r ar, f.dur from f left join v using (probe_id) left join s using (probe_id))
select probe_id, w width, h height, case when h is null then 'unknown' when h >= 2160 then '4K' when h >= 1080 then '1080p' when h >= 720 then '720p' when h >= 480 then '480p' else h || 'p' end label, vc video_codec, vr video_bitrate, ac audio_codec, ar audio_bitrate, floor(dur)::bigint duration_secs,
  round(0.4::double * case when h is null then 50 when h >= 2160 then 100 when h >= 1080 then 80 when h >= 720 then 60 else 40 end + 0.3::double * case vc when 'AV1' then 95 when 'H.265' then 90 when 'HEVC' then 90 when 'H.264' then 70 else 50 end + 0.2::double * case when vr is null then 50 else least(100, vr::double / 50e6::double * 100) end
  + 0.1::double * case ac when 'DTS' then 95 when 'Atmos' then 95 when 'FLAC' then 90 when 'AAC' then 65 else 50 end, 6) score from j""",
    "probed_containers": "with " + _STREAMS + """, c as (select distinct probe_id, e->>'$.tags.title' t, pos from (select probe_id, unnest(a) e, unnest(range(len(a))) pos from (select probe_id, json_extract(b, '$.chapters[*]') a from body))),
s as (select probe_id, coalesce(e->>'$.tags.language', e->>'$.tags.LANGUAGE') l, coalesce(e->>'$.tags.title', e->>'$.tags.TITLE') t from stream), f as (select distinct probe_id, nullif(trim(b->>'$.format.format_name'), '') format_name, nullif(trim(b->>'$.format.tags.title'), '') title from body)
select probe_id, format_name, title, (select count(*) from c where c.probe_id = f.probe_id and trim(t) <> '') chapters, (select count(distinct trim(l)) from s where s.probe_id = f.probe_id and trim(l) <> '') languages, (select count(distinct trim(t)) from s where s.probe_id = f.probe_id and trim(t) <> '') track_titles from f""",
    "p1_subtitle_plans": """with item as (select distinct id, rename_plan.subtitle_plans p from media_item where len(rename_plan.subtitle_plans) > 0),
placed as (select id, unnest(p) e, unnest(range(len(p))) pos from item)
select distinct id item_id, pos, e.old_path old_path, e.new_path new_path from placed where e is not null""",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_quality, p1_scraped, p1_scraped_evidence, p1_rename_plans, p1_subtitle_plans, p1_directory_plans, p1_rationales, p1_conflicts, p1_subtitle_lines,
        p1_streams, p1_formats, p1_chapters, probed_quality, probed_containers, subtitle_choices,
    )
}
